"""Plan shapes that the scale design relies on (final AQE plans)."""

import re

from pyspark.sql import functions as F

from conftest import SMALL_SF
from vouch.operators import compare as CMP
from vouch.sources import datasets as D


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def hash_exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)


def test_bag_difference_is_one_row_shuffle(spark):
    orders = spark.read.parquet(f"{SMALL_SF}/orders.parquet")
    plan = final_plan(CMP.bag_difference(orders, orders.where(F.col("o_orderstatus") != "P")))
    ex = hash_exchanges(plan)
    assert len(ex) == 1 and "o_orderkey" in ex[0], plan          # one shuffle keyed by the whole row
    assert "HashAggregate(keys=[o_custkey" in plan or "partial_sum" in plan   # partial (map-side) aggregate
    assert plan.count("FileScan parquet") == 2                    # each side read once


def test_manifest_diff_is_one_path_shuffle(spark):
    orders = spark.read.parquet(f"{SMALL_SF}/orders.parquet")
    lineitem = spark.read.parquet(f"{SMALL_SF}/lineitem.parquet")
    local = lineitem.select(F.concat(F.lit("part-"), F.col("l_orderkey").cast("string")).alias("path"))
    remote = orders.select(F.concat(F.lit("part-"), F.col("o_orderkey").cast("string")).alias("path"))
    plan = final_plan(D.manifest_diff(local, remote))
    assert len(hash_exchanges(plan)) == 1, plan
    assert "Join" not in plan


def test_ordered_difference_numbers_a_stored_frame(spark):
    """Positions come from a checkpointed, ranged frame, so they stay right when
    no exchange is reused; only the per-partition offsets are broadcast."""
    lineitem = spark.read.parquet(f"{SMALL_SF}/lineitem.parquet")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        numbered = CMP.with_positions(lineitem, ["l_orderkey", "l_linenumber"], 40)
        r = numbered.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_pos").alias("d"), F.max("_pos").alias("m")).first()
        assert (r["n"], r["m"]) == (r["d"], r["d"] - 1) and r["n"] == lineitem.count()
        same = CMP.ordered_difference(lineitem, lineitem, ["l_orderkey"])
        assert {r.rows_differing for r in same.collect()} == {0}
        first = lineitem.agg(F.min("l_orderkey")).scalar()
        other = lineitem.withColumn("l_comment_", F.lit(1)).withColumn("l_returnflag", F.when(F.col("l_orderkey") == first, F.lit("X")).otherwise(F.col("l_returnflag")))
        changed = CMP.ordered_difference(lineitem, other.drop("l_comment_"), ["l_orderkey"])
        plan = final_plan(changed)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    # The sort has run and is stored: the plan numbers and compares light rows only.
    assert "rangepartitioning" not in plan and "ExistingRDD" in plan and "l_orderkey" not in plan
    assert "Window" in plan and "SinglePartition" in plan          # only the per-partition counts are windowed
    assert all(re.search("_block|_pos|_side", e) for e in hash_exchanges(plan) if "_pid" not in e), plan
