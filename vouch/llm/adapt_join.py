"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes.

Shingles have one global order, rare ones first (by a count sketch over all
documents).  With overlap need a = ceil(t * n) for a set of n shingles, two
sets that link share at least l shingles within their first n - a + l ones.
Each document picks its own l: a longer prefix is met by more documents, but
asks for more shared shingles, so fewer pairs are verified.  It takes the l of
least estimated cost (documents met in the prefix, plus verification of those
that can share l).  A pair is a candidate when it shares at least
min(l of both) prefix shingles, which loses no link.

Documents with the same set are one class, so copies never meet each other.
Linking needs components only, and a group of near copies must not be paired
within itself.  So every class is first compared with one hub: of the most
central classes of its prefix shingles (those whose shingles are met most
often), the one that shares most.  The comparison gives the link to the hub
and the difference d from it (shingles that only one of the two has).

* Two classes of one hub: the size of their difference is
  |d1| + |d2| - 2 |d1 & d2|.  Where one of them does not link to the hub, a
  link needs so many common shingles in d1 and d2 that they also meet in
  prefixes of the differences, which hold few shingles that others have.
  Where both link to the hub, they are in one component already.
* Two classes of different hubs meet in their prefixes as above.

All pairs met with enough matches are verified on the whole sets, so no link
between components is lost.

Results: a text without words has an empty set and links with nothing; fewer
words than a shingle make one shingle of all of them; a null text is empty;
repeated rows are one class; ids are cast to bigint; a null doc_id names a component only where every
row of it has none; no documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from vouch.functions.canonical import row_hashes
from vouch.llm.common import connected_components, join_on, small_batches, written
from vouch.llm.shingles import shingle_set

#: The sketch is summed in pieces of this many counters.
_PIECE = 1 << 14
_MAX_MATCHES = 8
#: Slices that the classes of a hot shingle are dealt over.
_SLICES = 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def signature(tokens: np.ndarray) -> int:
    return _signed(xxh3_64_intdigest(tokens.tobytes()))


def need(n: int, percent: int) -> int:
    """Shingles that a set of n has to share to link: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def choose_matches(counts: np.ndarray, n: int, percent: int, noise: float) -> int:
    """The number l of matches that a set asks for.

    ``counts``: sketch counts of its shingles in global order.  The documents
    met in the l-prefix are at most the sum s of the counts above the sketch's
    noise; at most s / l of them share l shingles and are verified, at a cost
    of about n each.
    """
    a = need(n, percent)
    most = min(_MAX_MATCHES, a)
    met = np.cumsum(np.maximum(counts[:n - a + most] - noise, 0.0))
    best, cost = 1, None
    for l in range(1, most + 1):
        s = float(met[n - a + l - 1])
        c = s + n * s / l
        if cost is None or c < cost:
            best, cost = l, c
    return best


def _describe(width: int, bits: int):
    """Pass 1: (doc_id, text_hash, sig, n) per document and the task's counters per piece."""
    names = ["doc_id", "text_hash", "sig", "n", "piece", "counts"]

    def run(batches):
        counts = np.zeros(1 << bits, np.int64)
        for b in batches:
            ids, keys, sigs, ns, seen = b.column("doc_id"), b.column("text_hash"), [], [], []
            for text in b.column("text"):
                t = shingle_set(text.as_py(), width)
                sigs.append(signature(t) if len(t) else None)
                ns.append(len(t))
                seen.append(t)
            if seen:
                every = np.concatenate(seen).view(np.uint64) >> np.uint64(64 - bits)
                counts += np.bincount(every.astype(np.int64), minlength=1 << bits)
            k = len(ns)
            yield pa.RecordBatch.from_arrays(
                [ids, keys, pa.array(sigs, pa.int64()), pa.array(ns, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        step = min(_PIECE, 1 << bits)
        for i in range(0, 1 << bits, step):
            part = counts[i:i + step]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [*[pa.nulls(1, pa.int64())] * 4, pa.array([i // step], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], names)

    return run


def _add_pieces(batches):
    """Sum the counters of each piece; the input is sorted by piece."""
    at, total = None, None
    names = ["piece", "counts"]
    for b in batches:
        for piece, raw in zip(b.column("piece").to_pylist(), b.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(raw, "<i8")
            if piece != at:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names)
                at, total = piece, part.copy()
            else:
                total += part
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names)


def _prefixes(width: int, percent: int, bits: int, sketch, noise: float, hot: float):
    """Pass 2: the ordered prefix of each class, once in a task.  Its last
    ``n_hot`` shingles have sketch counts above ``hot``."""

    def run(batches):
        counts = sketch.value
        done: set[int] = set()
        for b in batches:
            sigs, ns, ls, hots, flat, ends = [], [], [], [], [], [0]
            for text in b.column("text"):
                t = shingle_set(text.as_py(), width)
                n = len(t)
                if not n or (sig := signature(t)) in done:
                    continue
                done.add(sig)
                c = counts[(t.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.lexsort((t, c))
                l = choose_matches(c[order], n, percent, noise)
                c = c[order[:n - need(n, percent) + l]]
                p = t[order[:len(c)]]
                sigs.append(sig)
                ns.append(n)
                ls.append(l)
                hots.append(int((c > hot).sum()))
                flat.append(p)
                ends.append(ends[-1] + len(p))
            if sigs:
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sigs, pa.int64()), pa.array(ns, pa.int32()), pa.array(ls, pa.int32()), pa.array(hots, pa.int32()), tokens],
                    ["sig", "n", "l", "n_hot", "tokens"])

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            flat = [shingle_set(text.as_py(), width) for text in b.column("text")]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in flat])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64), pa.int64()))
            sigs = pa.array([signature(t) if len(t) else None for t in flat], pa.int64())
            yield pa.RecordBatch.from_arrays([sigs, tokens], ["sig", "tokens"])

    return run


def _bit_pieces(batches):
    """One bitmap of 2^17 bits per piece; the input is sorted by piece."""
    at, bits = None, None
    for b in batches:
        for piece, bit in zip(b.column("piece").to_pylist(), b.column("bit").to_pylist(), strict=True):
            if piece != at:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["piece", "bits"])
                at, bits = piece, np.zeros(1 << 17, bool)
            bits[bit] = True
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["piece", "bits"])


def _maybe_in(ids: DataFrame, name: str, bits: int):
    """A filter on a bigint column that passes every value of ``ids`` and few
    others: a bitmap of 2^bits hash values (so many bits to the driver and to
    each executor, whatever the data).  An exact join has to follow.
    """
    slot = F.shiftrightunsigned(F.xxhash64(name), 64 - bits)
    found = ids.select(F.shiftrightunsigned(slot, 17).cast("int").alias("piece"), slot.bitwiseAND(F.lit((1 << 17) - 1)).cast("int").alias("bit")).distinct()
    found = found.repartition("piece").sortWithinPartitions("piece").mapInArrow(_bit_pieces, "piece int, bits binary")
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for row in found.collect():
        bitmap[row["piece"] << 14:(row["piece"] + 1) << 14] = np.frombuffer(row["bits"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def known(slots: pd.Series) -> pd.Series:
        s = slots.to_numpy()
        return pd.Series((shared.value[s >> 3] >> (7 - (s & 7)) & 1).astype(bool))

    return known(slot)


def _fits(n1: str, n2: str, percent: int):
    """Sizes alone allow a link."""
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the sets ta and tb of two of its columns.

    A set may be stored for several rows of one class; the light (sig, row)
    columns choose one, and the arrays are joined by row.
    """
    rows = sets.groupBy("sig").agg(F.min("row").alias("_r"))
    for c, r in ((a, "_ra"), (b, "_rb")):
        pairs = pairs.join(rows.select(F.col("sig").alias(c), F.col("_r").alias(r)), c)
    left = sets.select(F.col("row").alias("_ra"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("row").alias("_rb"), F.col("tokens").alias("tb"))
    return pairs.join(left, "_ra").join(right, "_rb").drop("_ra", "_rb")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose sets link, by exact intersection."""
    both = _with_sets(pairs, sets, "a", "b").withColumn("i", F.size(F.array_intersect("ta", "tb")))
    return both.filter(100 * F.col("i") >= percent * (F.size("ta") + F.size("tb") - F.col("i"))).select("a", "b")


def _hubs(met: DataFrame, percent: int) -> DataFrame:
    """(sig, hub): the hub that shares most of the class's prefix; a token's hub
    is the class whose tokens are met most often.  Only classes that share a
    quarter of their prefix with it, or whose tokens are met more often than
    the class has shingles (so that comparing it is cheaper), have a hub."""
    central = met.join(met.groupBy("token").agg(F.count(F.lit(1)).alias("_m")), "token").groupBy("sig").agg(F.sum("_m").alias("_central"))
    rows = written(met.join(central, "sig"), "join-central")
    top = rows.groupBy("token").agg(F.max("_central").alias("_central"))
    hubs = rows.join(top, ["token", "_central"]).groupBy("token").agg(F.min("sig").alias("hub"))
    tries = rows.join(hubs, "token").groupBy("sig", "n", "l", rows["_central"], "hub").agg(F.count(F.lit(1)).alias("c"))
    prefix = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + F.col("l")
    tries = tries.filter((F.col("sig") == F.col("hub")) | (4 * F.col("c") >= prefix) | (F.col("_central") >= F.col("n")))
    best = F.max(F.struct(F.col("c"), (F.col("sig") == F.col("hub")).alias("own"), F.col("hub")))
    chosen = tries.groupBy("sig").agg(best.alias("_b")).select("sig", F.col("_b.hub").alias("hub"))
    used = chosen.filter("sig <> hub").select("hub").distinct()
    return chosen.join(used, "hub", "left_semi").select("sig", "hub")


def _compared(hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(sig, hub, n, size, linked, half, long): the comparison of each class with its hub.

    With r = (100 - percent) / (100 + percent), x and y link when their
    difference is at most r (nx + ny).  If y does not link to the hub, a link
    of x and y needs more than |dx| (1 - r) / 2 common shingles of dx and dy,
    which bounds the prefix ``half`` of dx; and at least
    |dy| - r ny (1 + 100 / percent), which bounds the prefix ``long`` of dy.
    Shingles that the hub lacks come first.
    """
    both = _with_sets(hubs, sets, "sig", "hub").withColumnsRenamed({"ta": "tx", "tb": "th"})
    both = both.select("sig", "hub", F.size("tx").alias("n"), F.size("th").alias("nh"),
                       F.concat(F.array_sort(F.array_except("tx", "th")), F.array_sort(F.array_except("th", "tx"))).alias("d"))
    size = F.size("d")
    linked = size * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("nh"))
    # floor(|d| (1 - r) / 2) + 1 with (1 - r) / 2 = percent / (100 + percent), in whole numbers.
    half = size - F.expr(f"cast((size(d) * {percent}) div {100 + percent} as int)")
    rest = F.expr(f"cast(ceil(size(d) - n * {100 - percent} / {percent}) as int)")
    long = F.when(linked, 0).otherwise(F.greatest(half, size - F.greatest(rest, F.lit(1)) + 1))
    both = both.withColumn("_h", F.least(half, size)).withColumn("_l", F.least(long, size))
    return both.select("sig", "hub", "n", size.alias("size"), linked.alias("linked"), F.slice("d", F.lit(1), F.col("_h")).alias("half"),
                       F.slice("d", F.lit(1), F.col("_l")).alias("long"))


def _same_hub_pairs(compared: DataFrame, percent: int) -> DataFrame:
    """(a, b) of one hub, a not linked to it, that share a token of long(a) and
    half(b) and whose differences from the hub are near enough in size."""
    a = compared.filter("not linked").select(F.col("hub").alias("h"), F.col("sig").alias("a"), F.col("n").alias("an"), F.col("size").alias("ad"), F.explode("long").alias("t"))
    b = compared.select(F.col("hub").alias("h"), F.col("sig").alias("b"), F.col("n").alias("bn"), F.col("size").alias("bd"), F.explode("half").alias("t"))
    near = F.abs(F.col("ad") - F.col("bd")) * (100 + percent) <= (100 - percent) * (F.col("an") + F.col("bn"))
    return a.join(b, ["h", "t"]).filter((F.col("a") != F.col("b")) & near & _fits("an", "bn", percent)).select("a", "b").distinct()


def _prefix_pairs(met: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different hubs that share enough prefix tokens.

    Sets of nx and ny link with at least o = t (nx + ny) / (1 + t) common
    shingles; outside the prefix that ends first they have at most
    need(n) - l, so the prefixes share at least o minus the larger of these.
    """
    rows = met.join(hubs, "sig", "left").withColumn("hub", F.coalesce("hub", "sig"))
    split = rows.groupBy("token").agg(F.min("hub").alias("_lo"), F.max("hub").alias("_hi")).filter("_lo <> _hi")
    rows = written(rows.join(split.select("token"), "token", "left_semi"), "join-open")
    x = rows.select("token", F.col("sig").alias("a"), F.col("n").alias("an"), F.col("l").alias("al"), F.col("hub").alias("ah"))
    y = rows.select("token", F.col("sig").alias("b"), F.col("n").alias("bn"), F.col("l").alias("bl"), F.col("hub").alias("bh"))
    pairs = x.join(y, "token").filter((F.col("ah") != F.col("bh")) & (F.col("a") < F.col("b")) & _fits("an", "bn", percent))
    pairs = pairs.groupBy("a", "b", "an", "bn", "al", "bl").agg(F.count(F.lit(1)).alias("c"))
    overlap = F.expr(f"({percent} * (an + bn) + {99 + percent}) div {100 + percent}")
    outside = F.greatest(F.expr(f"(an * {percent} + 99) div 100 - al"), F.expr(f"(bn * {percent} + 99) div 100 - bl"))
    return pairs.filter(F.col("c") >= F.greatest(F.least("al", "bl"), overlap - outside)).select("a", "b")


def classes_of(docs: DataFrame, width: int, percent: int, sketch_bits: int = 20, filter_bits: int = 24) -> DataFrame:
    """(doc_id, text_hash, sig, n, component) of every row of ``docs``: the class
    of its shingle set and one class that names the component (null when the
    set is empty).

    Two documents link when 100 * intersection >= percent * union of their
    ``width``-word shingle sets.  ``sketch_bits`` sizes the count sketch
    (8 bytes << bits, broadcast); it orders shingles and estimates costs and
    never decides a link.  ``filter_bits`` sizes the bitmap that keeps texts
    of no candidate out of the shuffle before verification.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    first = hashed.mapInArrow(_describe(width, sketch_bits), "doc_id bigint, text_hash bigint, sig bigint, n bigint, piece int, counts binary")
    first = written(first, "join-sets")
    members = first.filter("piece IS NULL").select("doc_id", "text_hash", "sig", "n")
    pieces = first.filter("piece IS NOT NULL").select("piece", "counts")
    pieces = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(_add_pieces, "piece int, counts binary")
    sketch = np.zeros(1 << sketch_bits, np.int64)
    for row in pieces.collect():  # as many bytes as the sketch, whatever the data
        part = np.frombuffer(row["counts"], "<i8")
        sketch[row["piece"] * len(part):(row["piece"] + 1) * len(part)] = part
    mean = float(sketch.sum()) / len(sketch)
    shared_sketch = spark.sparkContext.broadcast(sketch)
    prefixes = texts.select("text").mapInArrow(
        _prefixes(width, percent, sketch_bits, shared_sketch, mean + 3 * mean ** 0.5 + 1, max(1024.0, 8 * mean)),
        "sig bigint, n int, l int, n_hot int, tokens array<bigint>")
    # A token's classes meet in one window.  The sketch never counts too low, so the window of a token that
    # is not hot is bounded; a hot token's classes are dealt over slices and all stay.
    rows = prefixes.select("sig", "n", "l", F.expr("size(tokens) - n_hot").alias("_cold"), F.posexplode("tokens").alias("_pos", "token"))
    rows = rows.select("token", F.when(F.col("_pos") < F.col("_cold"), -1).otherwise(F.pmod("sig", F.lit(_SLICES)).cast("int")).alias("slice"), "sig", "n", "l")
    w = Window.partitionBy("token", "slice")
    met = rows.withColumn("_first", F.min("sig").over(w)).withColumn("_last", F.max("sig").over(w))
    met = met.filter("slice >= 0 OR _first <> _last").select("token", "sig", "n", "l").distinct()
    met = written(met, "join-met")
    hubs = written(_hubs(met, percent), "join-hubs")
    apart = written(_prefix_pairs(met, hubs, percent), "join-pairs")
    classes = hubs.select("sig").union(apart.select("a")).union(apart.select("b")).distinct()

    owner = members.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    wanted = written(owner.join(classes, "sig", "left_semi").select("sig", "doc_id"), "join-wanted")
    ids = wanted.select("doc_id").distinct()
    likely = texts.filter(_maybe_in(ids, "doc_id", filter_bits))
    chosen = likely.join(ids, "doc_id", "left_semi").union(texts.filter("doc_id IS NULL")).select("text")
    sets = chosen.mapInArrow(_sets(width), "sig bigint, tokens array<bigint>").withColumn("row", F.monotonically_increasing_id())
    sets = written(sets, "join-candidates")

    compared = written(_compared(hubs, sets, percent), "join-compared")
    pairs = _same_hub_pairs(compared, percent).union(apart)
    links = verified(pairs, sets, percent).union(compared.filter("linked AND sig <> hub").select("sig", "hub"))
    comp = connected_components(links, "join-parts").select(F.col("node").alias("sig"), "component")

    named = members.join(comp, "sig", "left").select("doc_id", "text_hash", "sig", "n", F.coalesce("component", "sig").alias("component"))
    return written(named, "join-named")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, sketch_bits: int = 20, filter_bits: int = 24) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component) for
    every row of ``docs`` (doc_id, text)."""
    named = classes_of(docs, width, percent, sketch_bits, filter_bits)
    names = named.filter("sig IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = named.filter("sig IS NOT NULL").join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(named.filter("sig IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_per_component(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, one for each component.

    The row of the smallest doc_id stays (rows without an id come last), of
    several rows of this id the one of least text hash, and of rows equal in
    both the one of least row hash.  A text without words links with nothing,
    so all its rows stay.
    """
    named = classes_of(docs, width, percent).filter("sig IS NOT NULL")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("_b")
    kept = named.groupBy("component").agg(best).select("_b.doc_id", "_b.text_hash")
    rows = docs.select(F.struct("*").alias("_row"), row_hashes(docs, docs.columns)[0].alias("_hash"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wordless = F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    rows = rows.select("_row", "_hash", "doc_id", F.xxhash64("text").alias("text_hash"), wordless.alias("_wordless"))
    chosen = join_on(rows.filter("NOT _wordless"), kept, ["doc_id", "text_hash"], "left_semi")
    chosen = chosen.groupBy("doc_id", "text_hash").agg(F.min_by("_row", "_hash").alias("_row"))
    return chosen.select("_row.*").union(rows.filter("_wordless").select("_row.*"))
