"""Dependency skips against a brute-force run of the reference rule."""

import random

from pyspark.sql import functions as F

from vouch.operators.graph import explode_dependencies, skip_by_chain, skip_by_graph


def brute(checks):
    """checks: list of (suite, id, seq, passed, deps) in seq order per suite."""
    out = {}
    failed = set()
    for suite, cid, seq, ok, deps in sorted(checks, key=lambda c: (c[0], c[2])):
        skip = any(d in failed for d in deps)
        status = "skipped" if skip else ("passed" if ok else "failed")
        if status != "passed":
            failed.add(cid)
        out[cid] = skip
    return out


def random_checks(rng, suites=3, per_suite=40, p_fail=0.08):
    rows = []
    for s in range(suites):
        ids = [f"s{s}-{i}" for i in range(per_suite)]
        for i, cid in enumerate(ids):
            deps = rng.sample(ids, k=rng.randint(0, 3))  # may point later or to itself: never skips then
            rows.append((f"s{s}", cid, i, rng.random() > p_fail, deps))
    return rows


def test_graph_matches_brute_force(spark):
    rng = random.Random(7)
    for trial in range(3):
        rows = random_checks(rng)
        df = spark.createDataFrame(rows, "suite string, test_id string, seq long, raw_passed boolean, depends_on array<string>")
        got = {r.test_id: r.skipped for r in skip_by_graph(df.drop("depends_on"), explode_dependencies(df)).collect()}
        assert got == brute(rows), trial
        got2 = {r.test_id: r.skipped for r in skip_by_graph(df, depends_on="depends_on").collect()}
        assert got2 == brute(rows), trial


def test_chain_matches_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for s in range(5):
        prev = "-n/a-"
        for i in range(30):
            cid = f"s{s}-{i}"
            rows.append((f"s{s}", cid, i, rng.random() > 0.1, [prev]))
            prev = cid
    df = spark.createDataFrame(rows, "suite string, test_id string, seq long, raw_passed boolean, depends_on array<string>")
    got = {r.test_id: r.skipped for r in skip_by_chain(df).collect()}
    assert got == brute(rows)


def test_graph_without_failures(spark):
    df = spark.createDataFrame([("s", "a", 1, True), ("s", "b", 2, True)], "suite string, test_id string, seq long, raw_passed boolean")
    edges = spark.createDataFrame([("b", "a")], "test_id string, dep_id string")
    assert [r.skipped for r in skip_by_graph(df, edges).collect()] == [False, False]


def test_null_suite_and_equal_ids(spark):
    rows = [(None, "a", 1, False, []), (None, "b", 2, True, ["a"]), (None, "c", 3, True, ["b"]), ("s", "a", 1, True, []), ("s", "b", 2, True, ["a"])]
    df = spark.createDataFrame(rows, "suite string, test_id string, seq long, raw_passed boolean, depends_on array<string>")
    want = {(None, "a"): False, (None, "b"): True, (None, "c"): True, ("s", "a"): False, ("s", "b"): False}
    assert {(r.suite, r.test_id): r.skipped for r in skip_by_graph(df).collect()} == want
    assert {(r.suite, r.test_id): r.skipped for r in skip_by_chain(df).collect()} == want


def test_chain_of_ten_thousand_in_few_small_jobs(spark, monkeypatch):
    from vouch.operators import graph

    plans, keep = [], graph._Rounds.keep

    def counted(self, df, wanted=None):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return keep(self, df, wanted)

    monkeypatch.setattr(graph._Rounds, "keep", counted)
    raw = spark.range(1, 10_001).selectExpr("'S' AS suite", "concat('t', id) AS test_id", "id AS seq", "id <> 5 AS raw_passed", "array(concat('t', id - 1)) AS depends_on")
    assert skip_by_graph(raw).where("skipped").count() == 9_995
    assert len(plans) <= 20 and max(plans) <= 3, plans


def test_ladders_and_shared_dependencies_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for s, deps in (("two", lambda i: [i - 1, i - 2]), ("half", lambda i: [i // 2, i // 3]), ("hub", lambda i: [7, i - 9]), ("later", lambda i: [i + 1, rng.randint(0, max(i - 1, 0))])):
        for i in range(120):
            rows.append((s, f"{s}{i}", i, i not in (3, 50, 90), [f"{s}{d}" for d in deps(i) if 0 <= d < 120 and d != i]))
    df = spark.createDataFrame(rows, "suite string, test_id string, seq long, raw_passed boolean, depends_on array<string>")
    assert {r.test_id: r.skipped for r in skip_by_graph(df).collect()} == brute(rows)
