"""Suite semantics: ids, dependencies, points, score, and one scan per table."""

import pytest
from pyspark.sql import functions as F

from vouch import Suite
from vouch.plans import scoring

DESCRIPTION = "Testing 123."


def statuses(suite):
    return {r.test_id.split("-", 1)[1]: (r.status, r.points) for r in suite.results().collect()}


def test_empty_suite_not_passed(spark):
    s = Suite("Whatever", spark)
    res = s.results()
    score = scoring.suite_score(res).collect()
    assert score == []  # no rows: nothing scored
    roll = scoring.rollup(res).first()
    assert roll.percentage == 0 and roll.passed is False


@pytest.mark.parametrize("value,expect_null_passes", [(None, True), ("Bananas", False)])
def test_is_none_and_not_none(spark, value, expect_null_passes):
    df = spark.createDataFrame([(value,)], "v string")
    for method, passes in (("expect_null", expect_null_passes), ("expect_not_null", not expect_null_passes)):
        s = Suite("Whatever", spark)
        getattr(s, method)(df, F.max("v"), DESCRIPTION, hint="Found, [[ACTUAL_VALUE]]", per_row=False)
        assert s.results().first().hint == f"Found, {value}"
        r = s.results().first()
        assert r.description == DESCRIPTION
        assert (r.status == "passed") == passes
        assert scoring.rollup(s.results()).first().passed == passes


def test_value_hint(spark):
    df = spark.createDataFrame([("Bananas",)], "v string")
    s = Suite("Whatever", spark)
    s.expect_not_null(df, F.max("v"), DESCRIPTION, per_row=False, hint="Found, [[ACTUAL_VALUE]]")
    s.expect_value(df, F.max("v") == "Bananas", DESCRIPTION, actual=F.max("v"), hint="Found, [[ACTUAL_VALUE]]")
    hints = [r.hint for r in s.results().orderBy("seq").collect()]
    assert hints == ["Found, Bananas", "Found, Bananas"]


def test_length_hint_and_escaped_report(spark):
    df = spark.createDataFrame([("<b>",)], "v string")
    s = Suite("Whatever", spark)
    s.expect_length(df, F.max("v"), 5, "<i> & co", per_row=False, hint="[[ACTUAL_VALUE]] has [[LEN_ACTUAL_VALUE]]", escape_html=True)
    s.expect_length(df, F.max("v"), 5, "<i> & co", per_row=False, hint="[[ACTUAL_VALUE]] has [[LEN_ACTUAL_VALUE]]", depends_on=["-n/a-"])
    rows = scoring.report(s.results()).orderBy("seq").collect()
    assert [r.description for r in rows] == ["&lt;i&gt; &amp; co", "<i> & co"]
    assert [r.hint for r in rows] == ["&amp;lt;b&amp;gt; has 3", "&lt;b&gt; has 3"]


def test_runtime_errors_fail_only_their_check(spark):
    df = spark.createDataFrame([("a", 0), ("1", 2)], "v string, n int")
    s = Suite("Run", spark)
    none = ["-n/a-"]
    s.expect(df, F.col("n") >= 0, "fine", test_id="fine", depends_on=none)
    s.expect(df, F.col("v").cast("int") > 0, "cast", test_id="cast", depends_on=none)
    s.expect(df, (F.lit(1) / F.col("n")) > 0, "division", test_id="division", depends_on=none)
    s.expect(df, F.col("v").cast("int") > 5, "skipped", test_id="skipped", depends_on=["cast"])
    s.expect_value(df, F.count(F.lit(1)) == 2, "count", test_id="count", depends_on=none)
    rows = {r.test_id: r for r in s.materialise().collect()}
    assert {k: r.status for k, r in rows.items()} == {
        "Run-fine": "passed", "Run-cast": "failed", "Run-division": "failed", "Run-skipped": "skipped", "Run-count": "passed"}
    assert "CAST_INVALID_INPUT" in rows["Run-cast"].message and "DIVIDE_BY_ZERO" in rows["Run-division"].message


def test_two_objects_of_one_table_are_scanned_once(spark):
    path = "/root/testdata/sf0.001/lineitem.parquet"
    s = Suite("One", spark)
    s.expect(spark.read.parquet(path), F.col("l_quantity") > 0, "a", test_id="a")
    s.expect_in(spark.read.parquet(path), "l_returnflag", ["A", "N", "R"], "b", test_id="b")
    other = spark.read.parquet(path)
    s.expect(other, other["l_tax"] >= 0, "c", test_id="c")
    assert {r.status for r in s.results().collect()} == {"passed"}


def test_none_operands(spark):
    df = spark.range(2)
    s = Suite("None", spark)
    none = ["-n/a-"]
    s.expect_tables_equal(None, None, "both", depends_on=none)
    s.expect_tables_equal(df, None, "one", depends_on=none)
    s.expect_rows_equal(None, None, ["id"], "rows", depends_on=none)
    s.expect_schemas_equal(None, None, "schemas", depends_on=none)
    assert [r.status for r in s.results().orderBy("seq").collect()] == ["passed", "failed", "passed", "passed"]


def test_duplicate_id_raises(spark):
    df = spark.range(3)
    s = Suite("s", spark)
    s.expect(df, F.col("id") >= 0, "a", test_id="x")
    with pytest.raises(ValueError):
        s.expect(df, F.col("id") >= 0, "b", test_id="x")


def test_default_chain_and_explicit_edges(spark):
    df = spark.range(10)
    s = Suite("s", spark)
    s.expect(df, F.col("id") >= 0, "ok", test_id="a")                      # passes
    s.expect(df, F.col("id") > 100, "bad", test_id="b", points=2)           # fails
    s.expect(df, F.col("id") >= 0, "after bad", test_id="c")               # default: depends on b -> skipped
    s.expect(df, F.col("id") >= 0, "after c", test_id="d")                 # depends on c (skipped) -> skipped
    s.expect(df, F.col("id") >= 0, "on a", test_id="e", depends_on=["a"])  # explicit -> runs
    s.expect(df, F.col("id") >= 0, "on later", test_id="f", depends_on=["g"])  # later dep never skips
    s.expect(df, F.col("id") > 100, "bad2", test_id="g", depends_on="s-e")  # prefixed id accepted
    s.expect(df, F.col("id") >= 0, "zero points", test_id="h", points=0, depends_on="a")
    got = statuses(s)
    assert got == {
        "a": ("passed", 1), "b": ("failed", 0), "c": ("skipped", 0), "d": ("skipped", 0),
        "e": ("passed", 1), "f": ("passed", 1), "g": ("failed", 0), "h": ("passed", 0),
    }
    sc = scoring.suite_score(s.results()).first()
    assert (sc.score, sc.max_score) == (3, 8)
    assert sc.percentage == 37 and sc.passed is False


def test_unknown_dependency_raises(spark):
    s = Suite("s", spark)
    s.expect(spark.range(1), F.lit(True), "x", depends_on="nope")
    with pytest.raises(ValueError):
        s.results()


def test_bad_expression_fails_only_its_check(spark):
    df = spark.range(5)
    s = Suite("s", spark)
    s.expect(df, "no_such_column > 0", "broken", test_id="broken", depends_on="-n/a-")
    s.expect(df, F.col("id") >= 0, "fine", test_id="fine", depends_on=["broken"])
    rows = {r.test_id: r for r in s.results().collect()}
    assert rows["s-broken"].status == "failed" and "no_such_column" in rows["s-broken"].message
    assert rows["s-fine"].status == "skipped"


def test_truncated_percentage(spark):
    df = spark.createDataFrame([("x", "s-1", 2, 3), ("x", "s-2", 0, 0)], "suite string, test_id string, points int, max_points int")
    r = scoring.suite_score(df).first()
    assert r.percentage == 66  # 66.66 truncated
    r0 = scoring.suite_score(spark.createDataFrame([("y", "t", 0, 0)], "suite string, test_id string, points int, max_points int")).first()
    assert r0.percentage == 0 and r0.passed is False


def test_latest_result_wins(spark):
    df = spark.createDataFrame(
        [("t1", 1, "failed", 0, 1), ("t1", 2, "passed", 1, 1), ("t2", 5, "passed", 3, 3), ("t2", 4, "failed", 0, 3)],
        "test_id string, run_ts int, status string, points int, max_points int")
    latest = {r.test_id: r.status for r in scoring.latest_results(df, ["run_ts"]).collect()}
    assert latest == {"t1": "passed", "t2": "passed"}
    s = scoring.summary(scoring.latest_results(df, ["run_ts"])).first()
    assert (s.passing, s.failing, s.percentage) == (4, 0, 100)


def _final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_one_scan_per_table(spark):
    from conftest import SMALL_SF

    li = spark.read.parquet(f"{SMALL_SF}/lineitem.parquet")
    s = Suite("scan", spark)
    for i in range(20):
        s.expect(li, F.col("l_quantity") >= -i, f"check {i}", test_id=str(i))
    s.expect_equals(li, F.count(F.lit(1)), F.count("l_orderkey"), "count")
    plan = _final_plan(s.results())
    assert plan.count("FileScan parquet") == 1, plan
    assert s.results().count() == 21


def test_materialised_results_do_not_rerun(spark):
    df = spark.range(100)
    s = Suite("m", spark)
    s.expect(df, F.col("id") < 50, "half", test_id="half")
    s.expect(df, F.col("id") >= 0, "all", test_id="all", depends_on="-n/a-")
    kept = s.materialise()
    plan = kept._jdf.queryExecution().analyzed().toString()
    assert "Range" not in plan  # read back from the checkpoint, not recomputed
    assert {r.test_id: r.status for r in kept.collect()} == {"m-half": "failed", "m-all": "passed"}
    assert scoring.suite_score(kept).first().score == 1


def test_settings_readable_from_sql(spark):
    from vouch.operators.namespaces import publish_settings, with_params

    params = publish_settings(spark, "vouch", {"schema_name": "ws_x", "catalog_name": None})
    assert spark.sql("SELECT '${vouch.schema_name}' AS s, '${vouch.catalog_name}' AS c").first() == ("ws_x", "")
    assert with_params(spark, "SELECT :v AS v", {"v": params["schema_name"]}).first().v == "ws_x"


def test_non_boolean_predicate_fails_its_check(spark):
    df = spark.range(5)
    s = Suite("nb", spark)
    s.expect(df, F.col("id") + 1, "not boolean", test_id="bad", depends_on="-n/a-")
    s.expect(df, F.col("id") >= 0, "fine", test_id="ok", depends_on="-n/a-")
    rows = {r.test_id: (r.status, r.message) for r in s.results().collect()}
    assert rows["nb-bad"][0] == "failed" and rows["nb-bad"][1]
    assert rows["nb-ok"] == ("passed", "")


def test_adding_a_passing_check_never_lowers_the_score(spark):
    import random

    rng = random.Random(3)
    df = spark.range(20)
    for trial in range(3):
        s = Suite(f"p{trial}", spark)
        for i in range(6):
            bound = rng.choice([-1, 5, 30])  # id > -1 passes, id > 5 fails, id > 30 fails
            deps = rng.choice([None, "-n/a-"])
            s.expect(df, F.col("id") > bound, f"c{i}", test_id=f"c{i}", points=rng.randint(0, 3), depends_on=deps)
        before = scoring.suite_score(s.results()).first().score
        s.expect(df, F.col("id") >= 0, "always", test_id="extra", points=2, depends_on=rng.choice([None, "-n/a-"]))
        after = scoring.suite_score(s.results()).first().score
        assert after >= before


def test_membership_small_large_and_table_agree(spark):
    df = spark.createDataFrame([(i if i % 7 else None,) for i in range(3000)], "v long")
    values = list(range(0, 2000)) + [None, "2500", 2999.0]
    allowed = spark.createDataFrame([(v,) for v in range(0, 2000)] + [(None,), (2999,)], "a long")
    s = Suite("mem", spark)
    s.expect_in(df, "v", values, "large list", test_id="large", depends_on="-n/a-")
    s.expect_in(df, "v", values[:5] + [None], "small list", test_id="small", depends_on="-n/a-")
    s.expect_in(df, "v", allowed, "table", allowed_column="a", test_id="table", depends_on="-n/a-")
    got = {r.test_id: r.violations for r in s.raw_results().collect()}
    in_large = sum(1 for i in range(3000) if not (i % 7 == 0 or i < 2000 or i == 2999))
    in_small = sum(1 for i in range(3000) if not (i % 7 == 0 or i < 5))
    assert got == {"mem-large": in_large, "mem-small": in_small, "mem-table": in_large}


def test_missing_table_precondition_and_history(spark):
    from vouch.session import work_path

    df = spark.range(10)
    history = work_path(spark, "t-history")
    s1 = Suite("h", spark)
    s1.expect_path(history + "-missing", "input")
    s1.expect(df, F.col("id") < 5, "small ids", test_id="small")
    first = {r.test_id: (r.status, r.message) for r in s1.results().collect()}
    assert first["h-input"][0] == "failed" and "missing table" in first["h-input"][1]
    assert first["h-small"][0] == "skipped"
    s1.record(history)
    s2 = Suite("h", spark)
    s2.expect_path(history, "input")
    s2.expect(df, F.col("id") < 50, "small ids", test_id="small")
    hist = s2.record(history)
    assert hist.count() == 4
    latest = {r.test_id: r.status for r in scoring.latest_results(hist, ["run_ts"]).collect()}
    assert latest == {"h-input": "passed", "h-small": "passed"}
    assert scoring.rollup(scoring.latest_results(hist, ["run_ts"])).first().passed


def test_union_of_suites(spark):
    from vouch.plans.suite import union_suites

    df = spark.range(4)
    a = Suite("a", spark).expect(df, F.col("id") >= 0, "x")
    b = Suite("b", spark).expect(df, F.col("id") > 2, "y")
    got = {(r.suite, r.status) for r in union_suites([a, b]).collect()}
    assert got == {("a", "passed"), ("b", "failed")}


def test_checks_behind_a_failed_precondition_are_not_run(spark):
    from conftest import SMALL_SF

    orders = spark.read.parquet(f"{SMALL_SF}/orders.parquet")
    lineitem = spark.read.parquet(f"{SMALL_SF}/lineitem.parquet")
    s = Suite("pre", spark)
    s.expect_columns(lineitem, ["l_comment"], "has_comment")
    s.expect(lineitem, "length(l_comment) < 50", "short comments", test_id="short")   # depends on has_comment
    s.expect(orders, F.col("o_totalprice") > 0, "positive", test_id="pos", depends_on="-n/a-")
    res = s.results()
    statuses = {r.test_id: r.status for r in res.collect()}
    assert statuses == {"pre-has_comment": "failed", "pre-short": "skipped", "pre-pos": "passed"}
    plan = _final_plan(res)
    assert "orders.parquet" in plan and "lineitem.parquet" not in plan


def test_suites_compiled_together_scan_each_table_once(spark):
    from conftest import SMALL_SF
    from vouch.plans.suite import union_suites

    li = spark.read.parquet(f"{SMALL_SF}/lineitem.parquet")
    a = Suite("a", spark)
    a.expect(li, F.col("l_quantity") > 0, "qty", test_id="1")
    a.expect(li, F.col("l_quantity") > 1e9, "huge", test_id="2")
    a.expect(li, F.col("l_tax") >= 0, "tax", test_id="3")            # after a failure: skipped in suite a
    b = Suite("b", spark)
    b.expect(li, F.col("l_tax") >= 0, "tax", test_id="1")            # same ids in another suite are fine
    b.expect_not_null(li, "l_orderkey", "keys", test_id="2")
    res = union_suites([a, b])
    got = {r.test_id: r.status for r in res.collect()}
    assert got == {"a-1": "passed", "a-2": "failed", "a-3": "skipped", "b-1": "passed", "b-2": "passed"}
    assert _final_plan(res).count("FileScan parquet") == 1


def test_errors_are_found_by_halves_with_their_message(spark, monkeypatch):
    df = spark.createDataFrame([("7",), ("x",)], "s string")
    s = Suite("halves", spark)
    for i in range(50):
        what = F.col("s").cast("int") > 0 if i == 33 else F.length("s") > 0
        s.expect(df, what, f"check {i}", test_id=f"c{i}", depends_on=["-n/a-"] if i != 40 else ["c33"])
    cls, ran = type(df), []
    real = cls.collect
    monkeypatch.setattr(cls, "collect", lambda self: (ran.append(1), real(self))[1])
    s.materialise()
    assert len(ran) <= 12  # about 2 log2(50)
    monkeypatch.undo()
    got = {r.test_id: r for r in s.results().collect()}
    assert got["halves-c33"].status == "failed" and got["halves-c40"].status == "skipped"
    assert got["halves-c33"].message.startswith("[CAST_INVALID_INPUT]") and "'x'" in got["halves-c33"].message
    assert sum(r.status == "passed" for r in got.values()) == 48


def test_a_function_that_raises_fails_its_check(spark):
    @F.udf("boolean")
    def strict(v):
        raise ValueError("no such rule")

    df = spark.range(3)
    s = Suite("raises", spark)
    s.expect(df, strict("id"), "raises", test_id="a", depends_on=["-n/a-"])
    s.expect(df, F.col("id") >= 0, "fine", test_id="b", depends_on=["-n/a-"])
    s.expect(df, F.raise_error(F.lit("stop here")).isNull(), "raised", test_id="c", depends_on=["-n/a-"])
    got = {r.test_id: (r.status, r.message) for r in s.materialise().collect()}
    assert got["raises-b"][0] == "passed"
    assert got["raises-a"] == ("failed", "ValueError: no such rule") and "stop here" in got["raises-c"][1]


def test_lost_and_corrupt_files_raise(spark):
    import os

    import pytest

    from vouch.session import work_path

    for harm in ("lost", "corrupt"):
        path = work_path(spark, "t-harm")
        spark.range(100).repartition(2).write.parquet(path)
        df = spark.read.parquet(path)
        local = path.replace("file:", "")
        name = [n for n in os.listdir(local) if n.endswith(".parquet")][0]
        for n in (f"{local}/{name}", f"{local}/.{name}.crc"):
            if os.path.exists(n):
                os.remove(n)
        if harm == "corrupt":
            with open(f"{local}/{name}", "wb") as f:
                f.write(b"PAR1 no table at all PAR1")
        s = Suite("harm", spark)
        s.expect(df, F.col("id") >= 0, "ids", test_id="a")
        with pytest.raises(Exception):
            s.materialise()


def test_latest_results_are_merged_run_by_run(spark):
    from vouch.session import work_path

    table = scoring.LatestTable(spark, work_path(spark, "t-latest"), ["run"])
    schema = "test_id string, run int, status string"
    table.merge(spark.createDataFrame([("a", 5, "passed"), ("b", 5, "failed"), (None, 1, "x")], schema))
    table.merge(spark.createDataFrame([("a", 4, "failed"), ("b", 6, "passed"), ("c", 1, "failed"), ("a", 5, "failed")], schema))
    assert set(map(tuple, table.read().collect())) == {(None, 1, "x"), ("a", 5, "passed"), ("b", 6, "passed"), ("c", 1, "failed")}
    assert len(table.read().inputFiles()) and table.vacuum() == 1 and table.read().count() == 4
