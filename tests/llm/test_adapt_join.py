import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import edge
from vouch.llm import adapt_join as A
from vouch.llm.common import connected_components


def sets(text, width):
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(len(words) - width, 0) + 1)}


def brute(rows, width, percent):
    s = [sets(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(s[i] & s[j])
            if k and 100 * k >= percent * (len(s[i]) + len(s[j]) - k):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(s[i]), low.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at:at + 1] = rng.choice([[], [f"new{rng.randrange(50)}"], [words[at], "again"]])
    return words


@pytest.mark.parametrize("width,percent,seed", [(4, 85, 1), (5, 80, 2), (2, 60, 3), (3, 100, 4), (1, 50, 5)])
def test_components_equal_brute_force(spark, width, percent, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):  # families of near copies with 0 to 9 edits, one of them large
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        rows += [" ".join(edited(rng, base, rng.randint(0, 9))) for _ in range(60 if not rows else rng.randint(2, 14))]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    rows += ["one", "One", "one two", "", None, rows[0], rows[0]]
    rows = [(i, t) for i, t in enumerate(rows)] + [(None, rows[3]), (3, rows[3])]
    rng.shuffle(rows)
    out = A.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), width, percent, sketch_bits=10)
    assert edge.rows(out, "doc_id", "n_shingles", "component_id") == brute(rows, width, percent)


def test_matches_grow_with_the_cost():
    n, percent = 100, 85
    assert A.choose_matches(np.ones(n), n, percent, noise=1.0) == 1
    heavy = np.concatenate([np.ones(10), np.full(n - 10, 1e6)])
    assert A.choose_matches(heavy, n, percent, noise=1.0) > 1


def test_components_of_graphs(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()}
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {x: c for x, c in low.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_one_stays_of_each_component_with_all_columns(spark):
    docs = edge.documents(spark)
    kept = A.one_per_component(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7, 9, 10] and ids.count(None) == 1
    assert A.one_per_component(edge.empty(spark)).count() == 0
    assert A.jaccard_components(docs).filter(F.col("doc_id") == 1).first()["n_shingles"] == 0
