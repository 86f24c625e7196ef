"""Groups of near duplicates: SimHash links found by the generalised pigeonhole.

The fingerprint of a text has bit b set when more than half of its shingle
hashes (XXH64, seed 42, repeats counted) have it set.  Two fingerprints link
when they differ in at most ``radius`` bits.

Search.  The 64 bits are cut into partitions of at most 16 bits, bits that go
together (by their correlation over all fingerprints) in one partition.  If
partition i gets a threshold T_i >= -1 and the T_i sum to radius - m + 1, two
linked fingerprints agree up to T_i bits in at least one partition i.  Each
fingerprint picks its own thresholds: the number of fingerprints within t bits
of its part is known for every part and t from a histogram (one counter for
each of the at most 2^16 values of a partition), and dynamic programming over
partitions finds the thresholds of least cost (values probed plus candidates).
It then probes the index of exact parts with all values within T_i; pairs met
are verified on all 64 bits.

A fingerprint in a crowd, whose cheapest probes would meet more fingerprints
than a ball of half the radius has points, does not probe.  It writes the
points of this ball, and fingerprints that share a point are linked to the
least of them: sharing a point means a link, and two linked fingerprints share
a point.  A pair is missed by the probes only if both sides are in a crowd,
where the balls find it; a pair with one side outside is met by that side's
probes, for the index holds every part that can be probed.  So every
fingerprint costs a bounded number of rows, whatever crowd it is in.

Results: a null or empty text and one without words have fingerprint 0, which
links like any other; equal fingerprints are one class and meet once; a null
doc_id names a component only where every row of it has none; rows are kept as
they are, repeated ones too; no documents give no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from vouch.llm.common import by_class, connected_components, small_batches, written
from vouch.llm.shingles import split_words
from vouch.llm.simhash import as_hex

#: Widest partition: its histogram has 2^16 counters.
_WIDEST = 16
#: An index bucket of more fingerprints is copied into slices, and probes are dealt over them.
_SPLIT, _SLICES = 256, 8
_SEED = 42


def fingerprint(text: str | None, width: int) -> int:
    """64 majority bits over the ``width``-word shingles of a text (0 without words)."""
    words = split_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    last = min(width, len(words)) - 1
    votes, n = np.zeros(64, np.int64), len(words) - last
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at:min(at + (1 << 16), n)].tolist(), ends[at + last:at + last + (1 << 16)].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b - 1], _SEED) for a, b in spans], "<u8")
        votes += _bits(hashes).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _bits(values: np.ndarray) -> np.ndarray:
    """n x 64 zeros and ones, bit 0 first."""
    return np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _fingerprint_rows(width: int):
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return run


def _unsigned(batch) -> np.ndarray:
    return batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _pair_counts(batches):
    """How often bits i and j are set together, summed over the task; (-1, -1) counts fingerprints."""
    both, n = np.zeros((64, 64), np.int64), 0
    for b in batches:
        bits = _bits(_unsigned(b)).astype(np.float32)
        both += (bits.T @ bits).astype(np.int64)
        n += len(bits)
    if n:
        i, j = np.indices((64, 64)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()),
                                          pa.array(np.append(both.reshape(-1), n), pa.int64())], ["i", "j", "c"])


def correlated_groups(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of nearly equal size; a group starts with the
    bit most tied to the bits left and grows by the bit most tied to the group."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0.0)
    left, groups = list(range(64)), []
    for g in range(parts):
        size = 64 * (g + 1) // parts - 64 * g // parts
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (tie[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _parts(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """n x m values of the partitions."""
    out = np.zeros((len(fps), len(groups)), np.int64)
    for g, bits in enumerate(groups):
        for k, b in enumerate(bits):
            out[:, g] |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _part_counts(groups: list[list[int]]):
    def run(batches):
        counts = [np.zeros(1 << len(g), np.int64) for g in groups]
        for b in batches:
            parts = _parts(_unsigned(b), groups)
            for g, c in enumerate(counts):
                c += np.bincount(parts[:, g], minlength=len(c))
        for g, c in enumerate(counts):
            v = np.flatnonzero(c)
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), g), pa.int32()), pa.array(v, pa.int32()), pa.array(c[v], pa.int64())], ["part", "value", "c"])

    return run


def _masks(width: int, most: int) -> list[np.ndarray]:
    """For t = 0..most, the values of ``width`` bits with at most t ones."""
    out, values = [], [0]
    for t in range(most + 1):
        if t:
            values = values + [sum(1 << b for b in c) for c in combinations(range(width), t)]
        out.append(np.array(values, np.int64))
    return out


def _met(hist: np.ndarray, width: int, most: int) -> np.ndarray:
    """(most + 1) x 2^width: fingerprints whose part is within t bits of the value."""
    exact = np.zeros((most + 1, len(hist)))
    exact[0] = hist
    at = np.arange(len(hist))
    for b in range(width):  # bit by bit: equal here, or one of the t differing bits
        exact[1:] = exact[1:] + exact[:-1][:, at ^ (1 << b)]
    return np.cumsum(exact, axis=0)


class Plan:
    """What a task needs to choose thresholds: partitions and their histograms."""

    def __init__(self, groups: list[list[int]], hists: list[np.ndarray], radius: int, crowd: int) -> None:
        self.groups, self.hists, self.radius, self.crowd = groups, hists, radius, crowd
        self._tables: list | None = None

    def tables(self) -> list:
        """(masks, cost of T = -1, 0, ... for every value) of each partition, made once in a process."""
        if self._tables is None:
            self._tables = []
            for g, h in zip(self.groups, self.hists, strict=True):
                most = min(self.radius, len(g))
                masks, met = _masks(len(g), most), _met(h, len(g), most)
                cost = np.vstack([np.zeros(len(h)), *[met[t] + len(masks[t]) for t in range(most + 1)]])
                self._tables.append((masks, cost))
        return self._tables

    def thresholds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x m thresholds of least cost, and that cost.  With u_i = T_i + 1 the
        u_i are at least 0 and sum to radius + 1, dealt partition by partition."""
        n, units, tables = len(parts), self.radius + 1, self.tables()
        best = np.full((units + 1, n), np.inf)
        best[0] = 0.0
        picks = []
        for g, (_masks_of, cost) in enumerate(tables):
            mine = cost[:, parts[:, g]]
            now, pick = np.full_like(best, np.inf), np.zeros((units + 1, n), np.int64)
            for s in range(units + 1):
                for u in range(min(s, len(mine) - 1) + 1):
                    c = best[s - u] + mine[u]
                    better = c < now[s]
                    now[s][better], pick[s][better] = c[better], u
            best = now
            picks.append(pick)
        left, out, rows = np.full(n, units), np.zeros((n, len(tables)), np.int64), np.arange(n)
        for g in range(len(tables) - 1, -1, -1):
            u = picks[g][left, rows]
            out[:, g] = u - 1
            left = left - u
        return out, best[units]

    def bucket(self, part: int, values: np.ndarray, fps: np.ndarray) -> np.ndarray:
        """The join key of probes: partition, value and, in a large bucket, a slice."""
        slices = np.where(self.hists[part][values] > _SPLIT, (fps % np.uint64(61)).astype(np.int64) % _SLICES, 0)
        return (part << 40) | (values << 8) | slices

    def ball(self) -> list[int]:
        """Flips that lead from a fingerprint to the points within half the radius."""
        return [sum(1 << b for b in c) for k in range(self.radius // 2 + 1) for c in combinations(range(64), k)]


def points_of(radius: int) -> int:
    """Rows that a fingerprint of a crowd writes."""
    ball = sum(comb(64, k) for k in range(radius // 2 + 1))
    return ball * 64 if radius % 2 else ball


def _probes(plan):
    """(kind 0, bucket, fp) for each value probed."""

    def run(batches):
        p = plan.value
        for b in batches:
            fps = _unsigned(b)
            parts = _parts(fps, p.groups)
            chosen, cost = p.thresholds(parts)
            quiet = cost <= p.crowd
            for g, (masks, _cost) in enumerate(p.tables()):
                for t in range(len(masks)):
                    rows = np.flatnonzero(quiet & (chosen[:, g] == t))
                    step = max(1, (1 << 18) // len(masks[t]))
                    for at in range(0, len(rows), step):
                        own = parts[rows[at:at + step], g]
                        values = (own[:, None] ^ masks[t][None, :]).reshape(-1)
                        who = np.repeat(fps[rows[at:at + step]], len(masks[t]))
                        # A bucket that is empty or holds the fingerprint alone has nothing to meet.
                        use = p.hists[g][values] > (values == np.repeat(own, len(masks[t])))
                        yield pa.RecordBatch.from_arrays([pa.array(p.bucket(g, values[use], who[use])), pa.array(who[use].view(np.int64))], ["bucket", "a"])

    return run


def _index(plan):
    """(bucket, fp) of every part that can be probed: a bucket with more than
    ``crowd`` fingerprints makes any probe of it dearer than the ball."""

    def run(batches):
        p = plan.value
        for b in batches:
            fps = _unsigned(b)
            parts = _parts(fps, p.groups)
            for g, hist in enumerate(p.hists):
                size = hist[parts[:, g]]
                for wide in (False, True):
                    use = (size <= p.crowd) & ((size > _SPLIT) == wide)
                    base = (g << 40) | (parts[use, g] << 8)
                    for s in range(_SLICES if wide else 1):
                        yield pa.RecordBatch.from_arrays([pa.array(base | s), pa.array(fps[use].view(np.int64))], ["bucket", "b"])

    return run


def _points(plan):
    """The ball points (x, y) of the fingerprints in a crowd.  An odd radius takes
    the edges of the cube that touch the ball: y is the edge's bit, else -1."""

    def run(batches):
        p = plan.value
        flips = np.array(p.ball(), np.uint64)
        for b in batches:
            fps = _unsigned(b)
            _t, cost = p.thresholds(_parts(fps, p.groups))
            for fp in fps[cost > p.crowd]:
                for bit in range(64) if p.radius % 2 else (-1,):
                    x = fp ^ flips
                    if bit >= 0:
                        x = np.unique(x & np.uint64(~(1 << bit) & (1 << 64) - 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)), pa.array(np.full(len(x), bit), pa.int32()), pa.array(np.full(len(x), fp).view(np.int64))], ["x", "y", "fp"])

    return run


def make_plan(classes: DataFrame, radius: int, parts: int, crowd: int | None = None) -> Plan:
    """Partitions from the bits' correlation over all fingerprints and a histogram
    of each: 64 x 64 sums and at most ``parts`` x 2^16 counters reach the driver."""
    if not -(-64 // parts) <= _WIDEST or parts > 64:
        raise ValueError(f"between {64 // _WIDEST} and 64 partitions")
    if not 0 <= radius < 64:
        raise ValueError("radius must be in 0..63")
    both, n = np.zeros((64, 64), np.int64), 0
    sums = classes.select("fp").mapInArrow(_pair_counts, "i int, j int, c bigint").groupBy("i", "j").agg(F.sum("c").alias("c"))
    for r in sums.collect():
        if r["i"] < 0:
            n = r["c"]
        else:
            both[r["i"], r["j"]] = r["c"]
    groups = correlated_groups(both, n, parts)
    hists = [np.zeros(1 << len(g), np.int64) for g in groups]
    counts = classes.select("fp").mapInArrow(_part_counts(groups), "part int, value int, c bigint").groupBy("part", "value").agg(F.sum("c").alias("c"))
    for b in counts.toArrow().to_batches():
        part, value, c = (b.column(x).to_numpy(zero_copy_only=False) for x in ("part", "value", "c"))
        for g, h in enumerate(hists):
            h[value[part == g]] = c[part == g]
    return Plan(groups, hists, radius, points_of(radius) if crowd is None else crowd)


def links_within(classes: DataFrame, radius: int = 4, parts: int = 4, crowd: int | None = None) -> DataFrame:
    """(a, b) links that connect all fingerprints (column fp, distinct rows) which
    differ in at most ``radius`` bits; pairs inside a crowd come as a star."""
    spark = classes.sparkSession
    plan = spark.sparkContext.broadcast(make_plan(classes, radius, parts, crowd))
    probes = classes.select("fp").mapInArrow(_probes(plan), "bucket bigint, a bigint")
    index = classes.select("fp").mapInArrow(_index(plan), "bucket bigint, b bigint")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    found = probes.join(index, (probes["bucket"] == index["bucket"]) & (F.col("a") != F.col("b")) & near).select("a", "b")
    points = classes.select("fp").mapInArrow(_points(plan), "x bigint, y int, fp bigint")
    # At most as many fingerprints share a point as a ball has points.
    least = F.min("fp").over(Window.partitionBy("x", "y"))
    star = points.select(F.col("fp").alias("a"), least.alias("b")).filter("a <> b")
    return found.union(star)


def simhash_components(docs: DataFrame, width: int = 5, radius: int = 4, parts: int = 4, crowd: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable
    by links) for every row of ``docs`` (doc_id, text).

    ``parts`` partitions the bits.  ``crowd``: estimated cost from which a
    fingerprint writes its ball instead of probing (as many rows as the ball has).
    """
    small_batches(docs.sparkSession, 256)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(texts.mapInArrow(_fingerprint_rows(width), "doc_id bigint, fp bigint"), "simhash-rows")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n")), "simhash-classes")
    links = links_within(classes, radius, parts, crowd)
    comp = connected_components(links, "simhash-parts").withColumnRenamed("node", "fp")
    placed = written(classes.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-placed")
    names = placed.groupBy("component").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    named = by_class(placed.select("fp", "component", F.col("_n").alias("_rows")), written(names, "simhash-names"), "component", "_n")
    named = written(named.select("fp", "component_id", F.col("_rows").alias("_n")), "simhash-named")
    out = by_class(rows, named, "fp", "_n")
    return out.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
