"""SimHash document fingerprints and search within a Hamming radius.

Every run of ``width`` words is a term; its 64-bit hash votes once per
occurrence (the term's frequency is its weight), up for a set bit and down for
a clear one.  A bit of the fingerprint is set when more votes go up than down.

The votes are sums in one aggregation: the lanes ``(h >>> i) & 0x100000001``
count bit i in the low and bit i + 32 in the high half of a long, which a text
of at most 2^31 bytes cannot overflow.

The search cuts fingerprints in ``blocks`` > radius pieces.  Two fingerprints
within the radius agree on at least blocks - radius pieces, so a table for
every choice of that many pieces (the permuted tables), joined on the chosen
pieces, meets every such pair; the distance of each pair met is then checked.

Built-in functions only.  Defined results: a null text is empty; a text without
a word has fingerprint 0; rows equal in doc_id and text are one document for
"the next document" and all get its result; a null doc_id sorts first; no
documents give no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vouch.llm.common import SPACE_CLASS, join_on, let, text_key, text_or_empty, written

_LANES = (1 << 32) | 1
_LOW = (1 << 32) - 1


def terms(text: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words (all words, when there are fewer)."""
    words = F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r")), f"[{SPACE_CLASS}]+")
    hashes = let(words, lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)])))
    return F.when(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) == "", F.array().cast("array<bigint>")).otherwise(hashes)


def _bits(n: Column, lanes: list[Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for i, lane in enumerate(lanes):
        low, high = lane.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(lane, 32)
        out = out.bitwiseOR(F.when(low * 2 > n, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
        bit = F.lit((1 << (i + 32)) - ((1 << 64) if i == 31 else 0))
        out = out.bitwiseOR(F.when(high * 2 > n, bit).otherwise(F.lit(0)).cast("bigint"))
    return out


def fingerprints(texts: DataFrame, keys: list[str], width: int = 3) -> DataFrame:
    """keys + fingerprint (bigint), one row per distinct ``keys`` of (keys, text) rows."""
    t = texts.select(*keys, F.explode_outer(terms(F.col("text"), width)).alias("_h"))
    lanes = [F.coalesce(F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(_LANES))), F.lit(0).cast("bigint")).alias(f"_l{i}") for i in range(32)]
    sums = t.groupBy(*keys).agg(F.count("_h").alias("_n"), *lanes)
    return sums.select(*keys, _bits(F.col("_n"), [F.col(f"_l{i}") for i in range(32)]).alias("fingerprint"))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def next_documents(keyed: DataFrame, key: list[str]) -> DataFrame:
    """key, n_chars and the key of the next row in ascending key order.

    ``keyed`` rows are ranged over partitions and written with their partition
    number; the next row is found inside a partition by a window, and for a
    partition's last row from the first rows of the partitions (one each).
    The last of all is followed by the first.
    """
    ranged = keyed.groupBy(*key).agg(F.first("n_chars").alias("n_chars")).repartitionByRange(*key).sortWithinPartitions(*key)
    ids = written(ranged.withColumn("_part", F.spark_partition_id()), "next-docs")
    own = F.struct(*key)
    firsts = ids.groupBy("_part").agg(F.min(own).alias("_first"))
    after = F.lead("_first").over(Window.orderBy("_part"))
    firsts = firsts.select("_part", F.coalesce(after, F.min("_first").over(Window.partitionBy())).alias("_after"))
    inside = F.lead(own).over(Window.partitionBy("_part").orderBy(*key))
    rows = ids.select(*key, "n_chars", "_part", inside.alias("_inside")).join(F.broadcast(firsts), "_part")
    nxt = F.coalesce("_inside", "_after")
    return written(rows.select(*key, "n_chars", *[nxt[c].alias(f"next_{c}") for c in key]), "next-links")


def near_fingerprints(classes: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query fingerprint, fingerprint, distance) for all pairs within ``radius``.

    ``classes`` and ``queries`` have one row per distinct fingerprint, so equal
    fingerprints meet once however many documents share one.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be below the number of blocks, which is at most 64")
    edges = [64 * i // blocks for i in range(blocks + 1)]

    def piece(c: Column, i: int) -> Column:
        width = edges[i + 1] - edges[i]
        if width == 64:
            return c
        return F.shiftrightunsigned(c, edges[i]).bitwiseAND(F.lit((1 << width) - 1))

    def tables(df: DataFrame, fp: str) -> DataFrame:
        rows = [F.struct(F.lit(t).alias("t"), F.xxhash64(*[piece(F.col(fp), i) for i in chosen]).alias("k"))
                for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
        return df.select(F.col(fp), F.explode(F.array(*rows)).alias("_b")).select(fp, "_b.t", "_b.k")

    q = tables(queries.select(F.col("fingerprint").alias("query")), "query")
    c = tables(classes.select("fingerprint"), "fingerprint")
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    met = q.join(c, ["t", "k"]).withColumn("distance", distance).filter(F.col("distance") <= radius)
    return met.select("query", "fingerprint", "distance").distinct()


def edited_fingerprints(docs: DataFrame, width: int = 3, radius: int = 3, blocks: int = 6, query_step: int = 100) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many of the next document.  ``n_near``, for ids divisible by
    ``query_step`` (the stated query set; null for others), counts the other
    documents within ``radius`` of the document's fingerprint.
    """
    k1, k2 = text_key(F.col("text"))
    whole = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", "text", k1.alias("_t1"), k2.alias("_t2"))
    key = ["doc_id", "_t1", "_t2"]
    links = next_documents(whole.select(*key, F.char_length("text").cast("bigint").alias("n_chars")), key)
    ahead = links.select(*[F.col(c).alias(f"of_{c}") for c in key], F.floor(F.col("n_chars") / 4).cast("int").alias("_need"),
                         *[F.col(f"next_{c}").alias(c) for c in key])
    heads = join_on(whole, ahead, key).select(
        *[F.col(f"of_{c}").alias(c) for c in key], F.col("text").substr(F.lit(1), F.col("_need")).alias("_head"))
    heads = heads.groupBy(*key).agg(F.max("_head").alias("_head"))
    n = F.char_length("text")
    both = join_on(whole, heads, key).select(
        *key, n.cast("bigint").alias("n_chars"), "text",
        F.concat(F.col("text").substr(F.lit(1), n - F.floor(n / 4).cast("int")), F.col("_head")).alias("_edited"))
    sides = both.select(*key, "n_chars", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.lit(None).cast("string").alias("sha"), F.col("text").alias("text")),
        F.struct(F.lit(1).alias("side"), F.sha2(F.col("_edited"), 256).alias("sha"), F.col("_edited").alias("text")))).alias("_s"))
    sides = sides.select(*key, "n_chars", "_s.side", "_s.sha", "_s.text")
    fps = fingerprints(sides, [*key, "n_chars", "side", "sha"], width)
    wide = fps.groupBy(*key).agg(
        F.max("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"),
        F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("_fp"),
        F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("_efp"))
    wide = written(wide, "fingerprints")
    rows = whole_rows(docs)
    all_rows = join_on(rows, wide, key)
    nxt = wide.select(*[F.col(c).alias(f"next_{c}") for c in key], F.col("_fp").alias("_nfp"))
    step = join_on(links.select(*key, *[f"next_{c}" for c in key]), nxt, [f"next_{c}" for c in key]).select(*key, "_nfp")
    out = written(join_on(all_rows, step, key), "fingerprint-rows")
    classes = out.groupBy(F.col("_fp").alias("fingerprint")).agg(F.count(F.lit(1)).alias("_docs"))
    queries = out.filter(F.col("doc_id") % query_step == 0).select(F.col("_fp").alias("fingerprint")).distinct()
    near = near_fingerprints(classes, queries, radius, blocks).join(classes, "fingerprint")
    near = near.groupBy(F.col("query").alias("_fp")).agg((F.sum("_docs") - 1).alias("_near"))
    out = out.join(near, "_fp", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("_fp")).alias("fingerprint"), as_hex(F.col("_efp")).alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_efp")).alias("near_edited"), likeness(F.col("_fp"), F.col("_nfp")).alias("near_next"),
        F.when(F.col("doc_id") % query_step == 0, F.col("_near")).alias("n_near"))


def whole_rows(docs: DataFrame) -> DataFrame:
    k1, k2 = text_key(text_or_empty())
    return docs.select("doc_id", k1.alias("_t1"), k2.alias("_t2"))
