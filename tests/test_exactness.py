"""Equality by exact value, kinds before values, and counted comparisons."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch import Suite
from vouch.functions import values as V
from vouch.functions.naming import NamingConfig, schema_prefix, schema_prefixes_of
from vouch.operators import compare as CMP
from vouch.operators.graph import skip_by_graph


def equal(spark, a, a_type, b, b_type):
    df = spark.createDataFrame([(a, b)], T.StructType([T.StructField("a", a_type), T.StructField("b", b_type)]))
    return df.select(V.py_equal(F.col("a"), a_type, F.col("b"), b_type).alias("e")).first().e


@pytest.mark.parametrize("a,a_type,b,b_type,want", [
    (Decimal("12345678901234567890.01"), T.DecimalType(38, 2), Decimal("12345678901234567890.02"), T.DecimalType(38, 2), False),
    (Decimal("1.10"), T.DecimalType(10, 2), Decimal("1.1"), T.DecimalType(10, 1), True),
    (2 ** 53 + 1, T.LongType(), float(2 ** 53), T.DoubleType(), False),
    (2 ** 53, T.LongType(), float(2 ** 53), T.DoubleType(), True),
    (float("inf"), T.DoubleType(), 1, T.LongType(), False),
    (float("nan"), T.DoubleType(), float("nan"), T.DoubleType(), False),
    (5, T.LongType(), Decimal("5.00"), T.DecimalType(10, 2), True),
    (5, T.LongType(), Decimal("5.01"), T.DecimalType(10, 2), False),
    ("1", T.StringType(), 1, T.LongType(), False),
    (dt.date(2020, 1, 1), T.DateType(), dt.date(2020, 1, 1), T.DateType(), True),
    (True, T.BooleanType(), 1, T.LongType(), True),
])
def test_values_compare_exactly(spark, a, a_type, b, b_type, want):
    assert equal(spark, a, a_type, b, b_type) is want
    assert equal(spark, b, b_type, a, a_type) is want


def test_literals_of_every_kind(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3), Decimal("1.10"), [1, 2])],
                               "d date, t timestamp, x decimal(10,2), a array<bigint>")
    s = Suite("Lit", spark)
    none = ["-n/a-"]
    for c, v in (("d", dt.date(2020, 1, 2)), ("t", dt.datetime(2020, 1, 2, 3)), ("x", Decimal("1.1")), ("a", [1, 2])):
        s.expect_equals(df, F.max(c), v, c, depends_on=none)
    s.expect_equals(df, F.max("d"), dt.date(2020, 1, 3), "other", depends_on=none)
    assert [r.status for r in s.results().orderBy("seq").collect()] == ["passed"] * 4 + ["failed"]


@pytest.mark.parametrize("extra", [0, 2000])
def test_membership_does_not_depend_on_the_length_of_the_list(spark, extra):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), Decimal("1.10"), 2, 0.5)], "d date, x decimal(10,2), n bigint, f double")
    more = [f"text {i}" for i in range(extra)]
    s = Suite("In", spark)
    none = ["-n/a-"]
    s.expect_in(df, "d", [dt.date(2020, 1, 1), "2020-01-01", *more], "date", depends_on=none)
    s.expect_in(df, "x", [Decimal("1.1"), *more], "decimal", depends_on=none)
    s.expect_in(df, "n", [2.0, *more], "whole float", depends_on=none)
    s.expect_in(df, "n", ["2", 2.5, *more], "text", depends_on=none)
    s.expect_in(df, "f", [Decimal("0.5"), *more], "float", depends_on=none)
    assert [r.status for r in s.results().orderBy("seq").collect()] == ["passed", "passed", "passed", "failed", "passed"]


def sides(diff):
    return {r.side: r.rows_differing for r in diff.collect()}


def test_kinds_come_before_values(spark):
    a, b = spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([("1",)], "v string")
    for diff in (CMP.bag_difference(a, b), CMP.ordered_difference(a, b, ["v"]), CMP.keyed_difference(a, b, ["v"])):
        assert sides(diff)["actual_only"] == 1


def test_null_and_repeated_keys(spark):
    rows = [(None, 1), (None, 1), (1, 1), (1, 2), (2, 5)]
    a = spark.createDataFrame(rows, "k int, v int")
    assert set(sides(CMP.keyed_difference(a, a, ["k"])).values()) == {0}
    b = spark.createDataFrame([(None, 1), (None, 3), (1, 1), (3, 5)], "k int, v int")
    assert sides(CMP.keyed_difference(a, b, ["k"])) == {"actual_only": 2, "expected_only": 1, "changed": 1}


def test_maps_and_unknown_order_columns(spark):
    df = spark.range(20).select("id", F.create_map(F.lit("a"), "id").alias("m"))
    for diff in (CMP.bag_difference(df, df), CMP.ordered_difference(df, df, ["id"]), CMP.keyed_difference(df, df, ["id"])):
        assert set(sides(diff).values()) == {0}
    s = Suite("Order", spark)
    s.expect_tables_equal(df, df, "misspelt", order_by=["idd"])
    r = s.results().first()
    assert r.status == "failed" and "idd" in r.message


def test_every_possible_prefix_of_a_schema_name(spark):
    cfg = NamingConfig()
    users = spark.createDataFrame([("bob.by@example.com",), ("ann@example.com",)], "u string")
    for row in users.select(schema_prefix(F.col("u"), cfg).alias("p")).collect():
        lesson = row.p.split("_")[-2] + "_" + row.p.split("_")[-1]
        df = spark.createDataFrame([(f"{row.p}_{lesson}_x",), (row.p,), ("default",)], "s string")
        found = [r.f for r in df.select(schema_prefixes_of(F.col("s"), cfg).alias("f")).collect()]
        assert row.p in found[0] and found[1] == [row.p] and found[2] == []


def test_equal_ids_of_two_suites_stay_apart(spark):
    raw = spark.createDataFrame([("A", "x", 1, False, []), ("A", "y", 2, True, ["x"]), ("B", "x", 1, True, []), ("B", "y", 2, True, ["x"])],
                                "suite string, test_id string, seq int, raw_passed boolean, depends_on array<string>")
    got = {(r.suite, r.test_id): r.skipped for r in skip_by_graph(raw).collect()}
    assert got == {("A", "x"): False, ("A", "y"): True, ("B", "x"): False, ("B", "y"): False}


def test_long_chain_and_shared_dependency(spark):
    rows = [("S", f"t{i}", i, i != 1, [f"t{i - 1}"] if 1 < i <= 60 else ["t60"] if i > 60 else []) for i in range(1, 400)]
    raw = spark.createDataFrame(rows, "suite string, test_id string, seq int, raw_passed boolean, depends_on array<string>")
    assert skip_by_graph(raw).where("skipped").count() == 398


D = Decimal


@pytest.mark.parametrize("a,scale,b", [
    (D(2 ** 53 + 1), 0, float(2 ** 53)), (D(2 ** 53), 0, float(2 ** 53)), (D(2 ** 70), 0, 2.0 ** 70), (D(2 ** 70 - 1), 0, 2.0 ** 70), (D(2 ** 120), 0, 2.0 ** 120),
    (D("0.1"), 1, 0.1), (D("0.5"), 1, 0.5), (D("-0.75"), 2, -0.75), (D("0.75"), 2, -0.75), (D("1234567.015625"), 6, 1234567.015625), (D("1234567.015626"), 6, 1234567.015625),
    (D("0"), 2, -0.0), (D("3"), 0, 3.5), (D("3"), 0, float("inf")), (D("3"), 0, float("nan")), (D(1).scaleb(-38), 38, 1e-38), (D(2) ** -20, 20, 2.0 ** -20),
    (D(10 ** 37), 0, 1e37), (D(int(1e37)), 0, 1e37), (D("-9007199254740992.5"), 1, -9007199254740992.5),
])
def test_decimals_equal_doubles_only_where_python_says_so(spark, a, scale, b):
    want = a == D(b) if b == b and abs(b) != float("inf") else False
    kind = T.DecimalType(38, scale)
    assert equal(spark, a, kind, b, T.DoubleType()) is want
    assert equal(spark, b, T.DoubleType(), a, kind) is want


def frames(spark, left, right):
    return spark.sql(f"SELECT 1 AS id, {left} AS v"), spark.sql(f"SELECT 1 AS id, {right} AS v")


@pytest.mark.parametrize("left,right,want", [
    ("array(1, 2)", "array('1', '2')", False), ("named_struct('k', 1)", "named_struct('k', '1')", False),
    ("array(9007199254740993L)", "array(9007199254740992D)", False), ("map('a', 1)", "map('a', '1')", False),
    ("map('a', array(1))", "map('a', array('1'))", False), ("array(map(1, 'x'))", "array(map('1', 'x'))", False),
    ("array(1, 2)", "array(1L, 2L)", True), ("map('a', 1, 'b', 2)", "map('b', 2, 'a', 1)", True),
    ("array(map('a', 1, 'b', null))", "array(map('b', null, 'a', 1))", True), ("array(null, 1)", "array(1, null)", False),
    ("named_struct('a', null, 'b', 1)", "named_struct('a', 1, 'b', null)", False), ("array(cast('nan' as double), -0.0D)", "array(cast('nan' as double), 0.0D)", True),
    ("named_struct('k', named_struct('m', map(1, 2)))", "named_struct('k', named_struct('m', map(1, 3)))", False),
])
def test_nested_values_compare_by_kind_and_part(spark, left, right, want):
    a, b = frames(spark, left, right)
    for diff in (CMP.bag_difference(a, b), CMP.ordered_difference(a, b, ["id"]), CMP.keyed_difference(a, b, ["id"])):
        assert (set(sides(diff).values()) == {0}) is want


@pytest.mark.parametrize("left,right,want", [
    ("named_struct('k', 1, 'm', 2.5D)", "named_struct('k', 1D, 'm', 2.5BD)", True), ("named_struct('k', 1)", "named_struct('k', '1')", False),
    ("map('a', 1, 'b', 2)", "map('b', 2D, 'a', 1D)", True), ("map('a', 1)", "map('a', 1.5D)", False), ("map(1, 2)", "map('1', 2)", False),
    ("array(named_struct('k', 9007199254740993L))", "array(named_struct('k', 9007199254740992D))", False),
    ("map('a', null)", "map('a', null)", True), ("array(1, null)", "array(1D, null)", True), ("array(map('a', 1))", "array(map('a', 1L))", True),
])
def test_single_nested_values(spark, left, right, want):
    df = spark.sql(f"SELECT {left} AS a, {right} AS b")
    e = V.py_equal(F.col("a"), df.schema["a"].dataType, F.col("b"), df.schema["b"].dataType)
    assert df.select(e.alias("e")).first().e is want


def test_hashes_tell_null_places_apart(spark):
    from vouch.functions.canonical import row_hashes

    df = spark.sql("SELECT * FROM VALUES (1, null, array(null, 1)), (null, 1, array(null, 1)), (1, null, array(1, null)) AS t(a, b, c)")
    assert df.select(*[h.alias(f"h{i}") for i, h in enumerate(row_hashes(df, df.columns))]).distinct().count() == 3


def test_hashes_tell_array_ends_apart(spark):
    from vouch.functions.canonical import row_hashes

    df = spark.sql("SELECT * FROM VALUES (array(1), array(2)), (array(1, 2), array()), (array(), array(1, 2)) AS t(a, b)")
    assert df.select(*[h.alias(f"h{i}") for i, h in enumerate(row_hashes(df, df.columns))]).distinct().count() == 3
    a, b = df.limit(1), df.where("size(a) = 2")
    assert sides(CMP.bag_difference(df, df.where("size(a) <> 1"))) == {"actual_only": 1, "expected_only": 0}
    assert sides(CMP.bag_difference(a, b)) == {"actual_only": 1, "expected_only": 1}


def test_nested_rows_are_shuffled_as_hashes(spark):
    """Multisets of wide nested rows: counts are right, and no column of a row is shuffled."""
    import re

    df = spark.range(3000).selectExpr("id % 700 AS k", "repeat('x', 50) AS wide", "map('k', named_struct('n', if(id % 5 = 0, null, id % 3))) AS m",
                                      "array(double(id % 2), -0.0D) AS f")
    other = df.where("k <> 3").unionByName(df.where("k = 5")).selectExpr("k", "wide", "m", "array(f[0], 0.0D) AS f")
    want = {"actual_only": df.where("k = 3").count(), "expected_only": df.where("k = 5").count()}
    diff = CMP.bag_difference(df, other)
    assert sides(diff) == want
    assert set(sides(CMP.bag_difference(df, df.withColumn("m", F.col("m")))).values()) == {0}
    keys = re.findall(r"hashpartitioning\(([^)]*)", diff._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("wide" in k or "f#" in k for k in keys)
