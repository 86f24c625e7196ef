import random
import re

import numpy as np
import xxhash

import edge
from vouch.llm import simhash_groups as S


def brute(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    runs = [words[i:i + width] for i in range(max(len(words) - width, 0) + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode("utf-8", "surrogatepass"), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    left, out = set(fps), {}
    while left:
        seed = left.pop()
        group, todo = [seed], [seed]
        while todo:
            x = todo.pop()
            near = [y for y in left if (x ^ y).bit_count() <= radius]
            left.difference_update(near)
            group += near
            todo += near
        for x in group:
            out[x] = frozenset(group)
    return out


def clustered(rng, n, flips):
    base = [rng.getrandbits(64) for _ in range(6)]
    return sorted({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips))) for _ in range(n)})


def test_links_connect_what_brute_force_connects_with_and_without_crowds(spark):
    rng = random.Random(3)
    fps = clustered(rng, 400, 7) + [0]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in set(fps)], "fp bigint").repartition(5)
    for radius, parts, crowd in ((4, 4, None), (4, 5, 0), (4, 4, 60), (3, 6, 60), (1, 4, 0), (0, 4, None)):
        links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in S.links_within(df, radius, parts, crowd).collect()]
        assert all((a ^ b).bit_count() <= radius for a, b in links)
        want = components(set(fps), radius)
        joined = {x: x for x in want}

        def root(x):
            while joined[x] != x:
                x = joined[x]
            return x

        for a, b in links:
            joined[root(a)] = root(b)
        assert all(({y for y in want if root(y) == root(x)}) == set(g) for x, g in want.items()), (radius, parts, crowd)


def test_thresholds_sum_and_cost_are_the_least(spark):
    rng = np.random.default_rng(1)
    groups = S.correlated_groups(np.ones((64, 64), np.int64), 1, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    hists = [rng.integers(0, 9, 1 << 16) for _ in groups]
    plan = S.Plan(groups, hists, 4, 10**9)
    parts = S._parts(rng.integers(0, 1 << 63, 20).astype(np.uint64), groups)
    chosen, cost = plan.thresholds(parts)
    assert (chosen.sum(axis=1) == 4 - 4 + 1).all() and (chosen >= -1).all()
    for p, c in zip(parts, cost):
        every = [sum(plan.tables()[g][1][u, p[g]] for g, u in enumerate(us)) for us in np.ndindex(6, 6, 6, 6) if sum(us) == 5]
        assert c == min(every)
    v = int(parts[0, 0])
    for t in range(3):
        assert S._met(hists[0], 16, 4)[t, v] == sum(hists[0][v ^ int(m)] for m in S._masks(16, 4)[t])


def test_components_of_documents_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(25)]
    rows = []
    for i in range(160):
        t = list(rng.choice(base))
        if rng.random() < 0.6:
            t[rng.randrange(len(t))] = "Edit"
        rows.append((1000 - 3 * i, " ".join(t)))
    rows += [(5000, None), (None, ""), (4000, " \t\n"), (None, "alone and without id here"), (6000, "one two"), (6001, "ONE\x0btwo")]
    got = S.simhash_components(spark.createDataFrame(rows, "doc_id bigint, text string"), width=4).collect()
    fps = [brute(t, 4) for _i, t in rows]
    groups = components(set(fps), 4)
    want = []
    for (i, _t), f in zip(rows, fps):
        ids = [j for (j, _u), g in zip(rows, fps) if g in groups[f] and j is not None]
        want.append((i, f"{f:016x}", min(ids, default=None)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_edge_rows_and_empty_tables(spark):
    out = S.simhash_components(edge.documents(spark)).collect()
    assert len(out) == len(edge.ROWS)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[7]["component_id"] == by_id[8]["component_id"] == 7
    assert {by_id[i]["fingerprint"] for i in (1, 2, 3)} == {"0" * 16} and by_id[3]["component_id"] == 1
    assert S.simhash_components(edge.empty(spark)).count() == 0
