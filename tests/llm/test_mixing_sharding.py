import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import edge
from vouch.llm import mixing as M
from vouch.llm import rendezvous as R


def fill(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by the rounds of the definition: capped sources leave, the rest share again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed,block", [(1, 8), (2, 64), (3, 1024)])
def test_targets_and_takes(spark, seed, block):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(7)] + [None, "Z", "é"]
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(names[:3] if i % 3 else names)) for i in range(600)]
    out = M.mix_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), block_words=block).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = fill(dict(sizes))
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    assert len(out) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_slots_follow_the_weights_at_every_point(spark):
    plan = spark.createDataFrame([("a", 4000, 3000.0), ("b", 4000, 1000.0), ("c", 4000, 2000.0)], "source string, source_size bigint, target double")
    slots = M.schedule(plan, 10).orderBy("position").collect()
    assert len(slots) == 600 and len({(s["source"], s["block"], s["epoch"]) for s in slots}) == 600
    seen = Counter()
    for i, s in enumerate(slots[:550], 1):
        seen[s["source"]] += 1
        assert abs(seen["a"] - i / 2) <= 5 and abs(seen["b"] - i / 6) <= 5


def test_discrepancy_of_every_prefix_is_logarithmic(spark):
    words = {"a": 300_000, "b": 100_000, "c": 37_000, "d": 163_000, "e": 1_000}
    plan = spark.createDataFrame([(s, 2 * n, float(n)) for s, n in words.items()], "source string, source_size bigint, target double")
    slots = M.schedule(plan, 10).orderBy("position").collect()
    total, seen = sum(words.values()) // 10, Counter()
    assert len(slots) == total and all(Counter(s["source"] for s in slots)[n] == w // 10 for n, w in words.items())
    drawn = [s for s in slots if s["position"] < total]
    assert len(slots) - len(drawn) <= 20  # those that close the mix
    for i, s in enumerate(drawn, 1):
        seen[s["source"]] += 1
        assert all(abs(seen[n] - i * w / 10 / total) <= 3 + 3 * math.log2(i + 1) for n, w in words.items()), (i, seen)


def test_points_are_exact_at_any_position(spark):
    ks = [0, 1, 2, 10**6, 10**10, 2**44 + 12345, 2**45 - 1]
    got = spark.createDataFrame([(k,) for k in ks], "k bigint").select("k", M.golden_point(F.col("k")).alias("x")).collect()
    root = math.isqrt(5 << 200)
    for r in got:
        exact = ((2 * r["k"] + 1) * (root - (1 << 100)) // 4) % (1 << 100)  # 100 bits of frac((k + 1/2) phi)
        gap = abs(r["x"] - exact / 2.0 ** 100)
        assert min(gap, 1 - gap) < 1e-15 + r["k"] * 2.0 ** -53, r


def test_mixing_edge_rows(spark):
    docs = edge.documents(spark)
    out = M.mix_documents(docs)
    assert out.count() == docs.count() and out.filter("size = 0 AND taken > 0").count() == 0
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.groupBy("doc_id", "text").count().filter("count > 4").count() == 0
    again = M.mix_documents(docs)
    assert edge.rows(out, *out.columns) == edge.rows(again, *out.columns)
    assert M.mix_documents(edge.empty(spark)).count() == 0 and M.mixed_documents(edge.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert [r["target"] for r in M.mix_documents(blank).collect()] == [0.0, 0.0]


def test_shards_slots_and_growth(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}" * (i % 5)) for i in range(4000)], "doc_id bigint, text string")
    out = R.shard_documents(docs, [1.0] * 8).collect()
    text = {i: f"text {i % 7}" * (i % 5) for i in range(4000)}
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and 350 < len(slots) < 650
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["size"] == len(text[r["doc_id"]]) + 1 for r in out)
    moved = [r for r in out if r["grown_shard"] != r["shard"]]
    assert moved and all(r["grown_shard"] == 8 for r in moved) and len(moved) < 700
    nine = {r["doc_id"]: r["shard"] for r in R.shard_documents(docs, [1.0] * 9).collect()}
    assert all(nine[r["doc_id"]] == r["grown_shard"] for r in out)


def test_shards_follow_weights_and_files_hold_all_rows(spark, tmp_path):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r["shard"] for r in R.shard_documents(docs, [1.0, 2.0, 3.0]).collect())
    assert all(abs(n[s] - 1000 * (s + 1)) < 200 for s in range(3))
    R.write_shards(docs, str(tmp_path / "shards"), [1.0, 2.0, 3.0])
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 6000


def test_sharding_edge_rows(spark):
    docs = edge.documents(spark)
    out = R.shard_documents(docs, [1.0] * 8)
    assert out.count() == docs.count()
    assert out.filter("doc_id = 1").first()["size"] == 1 and out.filter("doc_id = 1").first()["text_crc32"] == 0
    assert R.shard_documents(edge.empty(spark), [1.0] * 8).count() == 0
