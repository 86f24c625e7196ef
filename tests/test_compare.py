"""Table and schema equality (FIXTURES section 2: pairs)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.operators import compare as CMP

PAIRS = "id bigint, v double, s string, n struct<x:int,y:array<string>>"
ROWS = [
    (1, 1.0, "a", (1, ["p"])),
    (2, float("nan"), None, (2, [])),
    (3, None, "c", None),
    (3, None, "c", None),  # duplicate row
    (4, 4.0, "d", (4, ["q", "r"])),
]


def sides(df):
    return {r.side: r.rows_differing for r in df.collect()}


def test_bag_equal_itself_and_shuffled(spark):
    a = spark.createDataFrame(ROWS, PAIRS)
    b = a.repartition(3).select("s", "n", "id", "v")  # other order, other partitioning
    assert sides(CMP.bag_difference(a, b)) == {"actual_only": 0, "expected_only": 0}


def test_bag_counts_duplicates_and_changes(spark):
    a = spark.createDataFrame(ROWS, PAIRS)
    b = spark.createDataFrame(ROWS[:3] + [(4, 4.5, "d", (4, ["q", "r"]))], PAIRS)
    assert sides(CMP.bag_difference(a, b)) == {"actual_only": 2, "expected_only": 1}


def test_bag_empty_and_column_sets(spark):
    e = spark.createDataFrame([], PAIRS)
    assert sides(CMP.bag_difference(e, e)) == {"actual_only": 0, "expected_only": 0}
    a = spark.createDataFrame(ROWS, PAIRS)
    assert sides(CMP.bag_difference(a, a.drop("s"))) == {"actual_only": 5, "expected_only": 5}


def test_ordered_and_keyed(spark):
    a = spark.createDataFrame(ROWS, PAIRS).dropDuplicates(["id"])
    changed = a.withColumn("s", F.when(F.col("id") == 4, F.lit("z")).otherwise(F.col("s")))
    assert sides(CMP.ordered_difference(a, a.select(*reversed(a.columns)), ["id"])) == {
        "actual_only": 0, "expected_only": 0, "changed": 0}
    assert sides(CMP.ordered_difference(a, changed, ["id"]))["changed"] == 1
    assert sides(CMP.keyed_difference(a, changed, ["id"])) == {"actual_only": 0, "expected_only": 0, "changed": 1}
    shorter = a.where(F.col("id") != 1)
    # positional: dropping the first row shifts every later row
    got = sides(CMP.ordered_difference(a, shorter, ["id"]))
    assert got["actual_only"] == 1 and got["changed"] == 3


def test_positions_are_global_and_dense(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k")).repartition(7)
    pos = CMP.with_positions(df, ["k"], partitions=5)
    rows = pos.select("k", "_pos").collect()
    assert sorted(r._pos for r in rows) == list(range(5000))
    assert all(r.k == r._pos for r in rows)


def test_schema_difference_nested_nullability(spark):
    s1 = T.StructType([T.StructField("a", T.IntegerType(), True),
                       T.StructField("n", T.StructType([T.StructField("x", T.IntegerType(), True)]), True)])
    s2 = T.StructType([T.StructField("a", T.IntegerType(), False),  # top level nullability ignored
                       T.StructField("n", T.StructType([T.StructField("x", T.IntegerType(), False)]), True)])
    fa = CMP.field_table(spark, {"a": s1})
    fb = CMP.field_table(spark, {"b": s2})
    assert sides(CMP.schema_difference(fa, fb, ordered=True))["changed"] == 1
    assert sides(CMP.schema_difference(fa, fa, ordered=False)) == {"actual_only": 0, "expected_only": 0}


def test_ordered_with_many_copies_is_spread(spark):
    """A third of the rows are copies of one row: positions stay exact and the
    copies land in more than one range partition."""
    base = spark.range(0, 3000).select((F.col("id") % 1000).alias("k"), F.lit("x").alias("s"))
    hot = spark.range(0, 1500).select(F.lit(7).cast("long").alias("k"), F.lit("hot").alias("s"))
    df = base.unionByName(hot).repartition(5)
    pos = CMP.with_positions(df, ["k"], partitions=6)
    assert sorted(r._pos for r in pos.select("_pos").collect()) == list(range(4500))
    assert pos.where(F.col("s") == "hot").count() == 1500
    assert sides(CMP.ordered_difference(df, df.repartition(3), ["k"])) == {"actual_only": 0, "expected_only": 0, "changed": 0}
