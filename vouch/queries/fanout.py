"""Registered queries for per-user fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.operators import fanout as FO
from vouch.session import work_path
from vouch.sources.tables import Tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query("per_user_apply", """
SELECT user_id, count(*) AS n_events, round(sum(value), 2) AS total_value,
       count(DISTINCT event_type) AS n_types, max(event_id) AS last_event_id
FROM events GROUP BY user_id ORDER BY user_id
""")
def per_user_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = Tables(spark, sf_dir).events
    return FO.for_each_user(ev, "user_id", [
        F.count(F.lit(1)).alias("n_events"),
        F.round(F.sum("value"), 2).alias("total_value"),
        F.count_distinct("event_type").alias("n_types"),
        F.max("event_id").alias("last_event_id"),
    ])


_MATERIALISE_SQL = """
WITH per_user AS (
  SELECT user_id, count(*) AS n_all, count(*) FILTER (WHERE value > 300) AS n_first FROM events GROUP BY user_id)
SELECT 'skip' AS mode, user_id, CASE WHEN n_first > 0 THEN 'skipped' ELSE 'created' END AS action,
       CASE WHEN n_first > 0 THEN n_first ELSE n_all END AS n_rows FROM per_user
UNION ALL
SELECT 'replace', user_id, CASE WHEN n_first > 0 THEN 'replaced' ELSE 'created' END, n_all FROM per_user
"""


@query("per_user_materialise", _MATERIALISE_SQL)
def per_user_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-user table first holding each user's high-value events, then
    asked for all events per user: once skipping existing users, once
    replacing them.  Returns (mode, user_id, action, n_rows in the table)."""
    ev = Tables(spark, sf_dir).events
    first = ev.where(F.col("value") > 300)
    out = None
    for mode, drop in (("skip", False), ("replace", True)):
        table = FO.UserTable(spark, work_path(spark, "users", mode), "user_id", buckets=64)
        table.create(first, drop_existing=False)
        report = table.create(ev, drop_existing=drop)
        counts = table.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))
        part = report.join(counts, "user_id", "left").select(
            F.lit(mode).alias("mode"), "user_id", "action", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query("per_user_drop", """
WITH requested AS (SELECT DISTINCT c_custkey AS user_id FROM customer WHERE c_mktsegment = 'BUILDING'),
have AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT r.user_id, CASE WHEN h.user_id IS NOT NULL THEN 'dropped' ELSE 'skipped' END AS action, 0::BIGINT AS n_rows
FROM requested r LEFT JOIN have h ON h.user_id = r.user_id
UNION ALL
SELECT h.user_id, 'kept', h.n FROM have h WHERE h.user_id NOT IN (SELECT user_id FROM requested)
""")
def per_user_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user, then a drop request for the users of one market
    segment's customers: (user_id, action, rows left)."""
    t = Tables(spark, sf_dir)
    table = FO.UserTable(spark, work_path(spark, "users", "drop"), "user_id", buckets=64)
    table.create(t.events, drop_existing=False)
    requested = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("user_id"))
    report = table.drop(requested)
    left = table.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))
    acted = report.join(left, "user_id", "left").select("user_id", "action", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    kept = left.join(report, "user_id", "left_anti").select("user_id", F.lit(FO.KEPT).alias("action"), "n_rows")
    return acted.unionByName(kept)


@query("per_user_pandas", """
SELECT user_id, count(*) AS n_events, min(value) AS lowest, max(value) AS highest, count(DISTINCT event_type) AS n_types FROM events GROUP BY user_id
""")
def per_user_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of pandas frames for the users in them: a row for each user and
    event type of a batch, which are then merged, so a user with a third of all
    events is never one task's work."""
    ev = Tables(spark, sf_dir).events.select("user_id", "event_type", "value")

    def partial(pdf):
        g = pdf.groupby(["user_id", "event_type"], as_index=False, dropna=False, sort=False)
        return g.agg(n_events=("value", "size"), lowest=("value", "min"), highest=("value", "max"))

    def merge(pdf):
        g = pdf.groupby("user_id", as_index=False, dropna=False, sort=False)
        return g.agg(n_events=("n_events", "sum"), lowest=("lowest", "min"), highest=("highest", "max"), n_types=("event_type", "nunique"))

    return FO.combine_users(ev, "user_id", partial, "user_id bigint, event_type string, n_events bigint, lowest double, highest double",
                            merge, "user_id bigint, n_events bigint, lowest double, highest double, n_types bigint")
