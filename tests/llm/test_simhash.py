import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

import edge
from vouch.llm import simhash as S


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(text, width=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    votes, n = [0] * 64, 0
    for i in range(max(len(words) - width, 0) + 1 if words else 0):
        h = 42
        for w in words[i:i + width]:
            h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed=h)
        n += 1
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > n)


def test_fingerprints_and_edited_texts_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i * 3, " ".join(rng.choice("alpha Beta gamma delta epsilon".split()) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(None, "a null id comes first"), (500, None), (501, ""), (700, rows[5][1]), (800, rows[5][1]), (900, "")]
    got = {r["doc_id"]: r for r in S.edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (i, text), (j, following) in zip(order, order[1:] + order[:1]):
        t, f = text or "", following or ""
        n = len(t) // 4
        edited = t[:len(t) - n] + f[:n]
        a, b, c = brute(t), brute(edited), brute(f)
        r = got[i]
        assert r["n_chars"] == len(t)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{a:016x}", f"{b:016x}")
        assert r["near_edited"] == 1 - (a ^ b).bit_count() / 64
        assert r["near_next"] == 1 - (a ^ c).bit_count() / 64
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        near = sum((a ^ brute(other)).bit_count() <= 3 for _id, other in rows) - 1
        assert r["n_near"] == (near if i is not None and i % 100 == 0 else None)


def test_block_tables_find_every_pair_within_the_radius(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {signed(b) for b in base}
    for b in base:
        for k in range(6):
            fps.add(signed(b ^ sum(1 << x for x in rng.sample(range(64), k))))
    df = spark.createDataFrame([(f,) for f in fps], "fingerprint bigint")
    for radius, blocks in ((3, 6), (0, 1), (2, 3)):
        got = {(r["query"], r["fingerprint"]) for r in S.near_fingerprints(df, df, radius, blocks).collect()}
        assert got == {(a, b) for a in fps for b in fps if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}


def test_edge_rows_and_empty_tables(spark):
    out = S.edited_fingerprints(edge.documents(spark))
    assert out.count() == len(edge.ROWS)
    same = out.filter(F.col("doc_id").isin(7, 8)).select("fingerprint").distinct()
    assert same.count() == 1
    assert S.edited_fingerprints(edge.empty(spark)).count() == 0
