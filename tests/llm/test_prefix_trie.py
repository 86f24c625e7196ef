import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from vouch.llm import prefix_trie as P

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _n, _t, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for seq, members in nodes.items():
        kids = [s for s in nodes if len(s) == len(seq) + 1 and s[:-1] == seq]
        sub = [s for s in nodes if s[:len(seq)] == seq]
        leaves = sum(not any(len(t) == len(s) + 1 and t[:-1] == s for t in sub) for s in sub)
        saved = sum((len(nodes[s]) - 1) * len(s[-1][1]) for s in sub if s)
        ends = sorted(c for c in members if len(convs[c]) == len(seq))
        out.append((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(kids), leaves, saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def same(df, rows):
    got = sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def conversations(rng, n):
    said = [f"text {i} ü" * (i % 3) for i in range(4)]
    rows = []
    for c in rng.sample(range(-150, 400), n):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(said)))
    return rows


def test_trie_equals_brute_force_over_shards(spark):
    rng = random.Random(6)
    rows = conversations(rng, 90)
    rows += [(c, t, "user", "copy") for c in (500, 501, 502, 503, 504, 505) for t in range(9)]
    rows += [(7, None, None, None), (None, 1, "user", "no conversation"), (8, 2, "user", "twice"), (8, 2, "user", "twice"), (9000, 0, "user", "absent base")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "depth", "part", "path", "n", "a.b"):
        df = df.withColumn(name, F.lit(name))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for on in ("false", "true"):  # eight shards, and one
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", on)
            same(P.prefix_trie(df), rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_one_path_shared_by_all_nested_and_turnless(spark):
    nested = [(c, t, "user", f"t{t}") for c in range(1, 30) for t in range(c)]
    same(P.prefix_trie(spark.createDataFrame(nested, SCHEMA)), nested)
    alone = [(3, t, "user", f"long {t}") for t in range(400)]
    same(P.prefix_trie(spark.createDataFrame(alone, SCHEMA).repartition(6)), alone)
    turnless = [(c, 0, "user", "x") for c in range(1, 60)]  # no base: those with h > 0 have no turn left
    same(P.prefix_trie(spark.createDataFrame(turnless, SCHEMA)), turnless)
    only = [(c, 0, "user", "x") for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6]
    same(P.prefix_trie(spark.createDataFrame(only, SCHEMA)), only)
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_findclose_and_pairs_equal_a_stack():
    rng = random.Random(2)
    for n in (1, 2, 40, 700, 4000):
        bits, left, open_ = [True], n - 1, 1
        while left or open_ > 1:
            if left and (open_ == 1 or rng.random() < 0.5):
                bits.append(True)
                left, open_ = left - 1, open_ + 1
            else:
                bits.append(False)
                open_ -= 1
        bits.append(False)
        tree, stack, want = P.Parentheses(np.array(bits)), [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        for i, j in want.items():
            assert tree.findclose(i) == j
            assert tree.pairs(i, j) == sum(bits[k] and not bits[k + 1] for k in range(i, j))


def test_digests_of_many_pieces(spark):
    df = spark.range(30_000).select(F.lit(3).alias("depth"), (F.col("id") % 2).alias("k1"), F.lit(5).cast("bigint").alias("k2"), F.col("id").alias("conv"))
    got = {r["k1"]: r["digest"] for r in P._digests(df).collect()}
    for k in (0, 1):
        assert got[k] == hashlib.sha256(",".join(str(i) for i in range(k, 30_000, 2)).encode()).hexdigest()
