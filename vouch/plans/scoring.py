"""Scores over results tables (all partial aggregates: skew-safe)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions.text import html_escape
from vouch.operators.graph import FAILED
from vouch.sources.versions import VersionLog


def _pct(score: Column, max_score: Column) -> Column:
    """Truncated whole percentage (100.0 * score / max), 0 when max is 0."""
    exact = (F.lit(100.0) * score / max_score).cast("long")
    return F.when(max_score == 0, F.lit(0).cast("long")).otherwise(exact)


def suite_score(results: DataFrame, by: str = "suite") -> DataFrame:
    """(suite, score, max_score, percentage, passed); passed only at 100."""
    agg = results.groupBy(by).agg(
        F.coalesce(F.sum("points"), F.lit(0)).cast("long").alias("score"),
        F.coalesce(F.sum("max_points"), F.lit(0)).cast("long").alias("max_score"),
    )
    pct = _pct(F.col("score"), F.col("max_score"))
    return agg.select(by, "score", "max_score", pct.alias("percentage"), (pct == 100).alias("passed"))


def latest_results(results: DataFrame, order_by: list[str], key: str = "test_id") -> DataFrame:
    """Last result per check id wins.

    ``max_by`` over a struct of the ordering columns is a partial aggregate: each
    task sorts the rows it has read by check id and passes one row of each on,
    so a check id with a huge history is combined map-side instead of being
    sorted in one task (as a ``row_number`` window would be).
    """
    keep = [c for c in results.columns if c != key]
    ordering = F.struct(*[F.col(c) for c in order_by])
    return results.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in keep]), ordering).alias("_r")).select(
        key, *[F.col(f"_r.{c}").alias(c) for c in keep]
    )


class LatestTable:
    """The latest result of every check, kept as a table and merged run by run.

    ``merge`` reads the table and the new run, never the history; the new table
    is a new version of a versioned folder, so readers see one or the other.
    Of results with equal order columns the one already there stays.
    """

    def __init__(self, spark: SparkSession, path: str, order_by: list[str], key: str = "test_id") -> None:
        self.spark, self.path, self.order_by, self.key = spark, path.rstrip("/"), order_by, key
        self.log = VersionLog(spark, path)

    def read(self) -> DataFrame:
        number, entry = self.log.latest()
        if not number:
            raise ValueError(f"{self.path} holds no results")
        return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{self.path}/{entry['folder']}")

    def merge(self, run: DataFrame) -> DataFrame:
        """Take over what is newer in ``run``; returns the table as it is then."""
        number, _entry = self.log.latest()
        rows = run.withColumn(_THERE, F.lit(0))
        if number:
            rows = self.read().withColumn(_THERE, F.lit(1)).unionByName(rows)
        latest = latest_results(rows, [*self.order_by, _THERE], self.key).select(*[F.col(f"`{c}`") for c in run.columns])
        folder = self.log.fresh_data()
        latest.write.parquet(f"{self.path}/{folder}")
        self.log.commit(number, {"schema": latest.schema.jsonValue(), "folder": folder})
        return self.read()

    def vacuum(self, keep: int = 1) -> int:
        return self.log.vacuum(keep, lambda e: [e["folder"]])


_THERE = "_already_there"


def rollup(results: DataFrame) -> DataFrame:
    """(score, max_score, percentage, passed) over every result row."""
    agg = results.agg(
        F.coalesce(F.sum("points"), F.lit(0)).cast("long").alias("score"),
        F.coalesce(F.sum("max_points"), F.lit(0)).cast("long").alias("max_score"),
    )
    pct = _pct(F.col("score"), F.col("max_score"))
    return agg.select("score", "max_score", pct.alias("percentage"), (pct == 100).alias("passed"))


def summary(results: DataFrame) -> DataFrame:
    """(passing, failing, percentage): passing/failing count POINTS."""
    r = rollup(results)
    return r.select(
        F.col("score").alias("passing"),
        (F.col("max_score") - F.col("score")).alias("failing"),
        F.col("percentage"),
    )


def report(results: DataFrame) -> DataFrame:
    """Grade table: hint only on failed checks, message only when not empty;
    description and hint are escaped for HTML where the check asks for it."""
    escape = F.coalesce(F.col("escape_html"), F.lit(False)) if "escape_html" in results.columns else F.lit(False)
    shown = lambda c: F.when(escape, html_escape(c)).otherwise(F.col(c))
    return results.select(
        "suite", "test_id", "seq", "points", shown("description").alias("description"), "status",
        F.when(F.col("status") == FAILED, shown("hint")).alias("hint"),
        F.when(F.length(F.coalesce(F.col("message"), F.lit(""))) > 0, F.col("message")).alias("message"),
    )
