"""Dependency skips over a results table.

Rule: a check is skipped when one of its dependencies that comes EARLIER
in its suite was not passed (failed or itself skipped).  A dependency on a
later check never skips.  So the skipped set is everything that reaches a
raw-failed check over backward edges.

Two operators:

- ``skip_by_chain``: the default dependency (each check on the previous
  one).  Then a check is skipped iff some earlier check of its suite failed,
  i.e. ``seq > first failing seq``.  One partial aggregate per suite plus a
  join - no window, so a suite holding a third of all checks is never sorted
  in one task (the aggregate combines map-side; AQE splits the skewed join).
- ``skip_by_graph``: explicit edges.  Every check has one parent, its latest
  dependency; these edges make a forest.  What lies below failed checks in the
  forest is found by doubling paths: a round looks two pointers ahead, twice a
  job, so a chain of n checks takes log4(n) jobs.  Then all edges are followed
  one hop from what is new, and the forest again from what that finds, until
  nothing is new.  Checks that nobody depends on take no part in the doubling.
  Every round is a written table in the shared checkpoint folder and holds at
  most three joins; backward edges strictly decrease ``seq``, so it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vouch.session import work_path

# The three result statuses.
PASSED, FAILED, SKIPPED = "passed", "failed", "skipped"


def status_columns(raw_passed: Column, skipped: Column, points: Column) -> list[Column]:
    status = F.when(skipped, F.lit(SKIPPED)).when(raw_passed, F.lit(PASSED)).otherwise(F.lit(FAILED))
    return [
        status.alias("status"),
        F.when(~skipped & raw_passed, points).otherwise(F.lit(0)).cast("int").alias("points"),
        points.cast("int").alias("max_points"),
    ]


def skip_by_chain(raw: DataFrame, suite: str = "suite", seq: str = "seq", passed: str = "raw_passed") -> DataFrame:
    """Adds boolean ``skipped`` for the default previous-check chain."""
    first_fail = (
        raw.where(~F.coalesce(F.col(passed), F.lit(False)))
        .groupBy(suite)
        .agg(F.min(seq).alias("_first_fail"))
    )
    first_fail = first_fail.withColumnRenamed(suite, "_failed_suite")  # a NULL suite is a suite
    joined = raw.join(first_fail, F.col(suite).eqNullSafe(F.col("_failed_suite")), "left")
    return joined.withColumn("skipped", F.coalesce(F.col(seq) > F.col("_first_fail"), F.lit(False))).drop("_first_fail", "_failed_suite")


def _key(suite: str, node: str) -> Column:
    """A check: its suite (which may be NULL) and its id."""
    return F.struct(F.col(suite).alias("suite"), F.col(node).alias("node"))


def backward_edges(raw: DataFrame, edges: DataFrame | None = None, test_id: str = "test_id", seq: str = "seq",
                   depends_on: str = "depends_on") -> DataFrame:
    """(t, d, d_seq): check t depends on d, which comes earlier in the same suite.

    With ``depends_on`` (an array column of ``raw``) the dependent side's seq
    and suite travel with the exploded edge, so only the dependency side
    needs a join; an explicit ``edges`` table (test_id, dep_id) needs both.
    Unknown dependencies drop out of the inner join.
    """
    nodes = raw.select(_key("suite", test_id).alias("d"), F.col(seq).alias("d_seq"))
    if edges is None:
        e = raw.select("suite", F.col(test_id).alias("t"), F.col(seq).alias("t_seq"), F.explode(F.col(depends_on)).alias("dep"))
    else:
        tn = raw.select("suite", F.col(test_id).alias("t"), F.col(seq).alias("t_seq"))
        e = edges.select(F.col("test_id").alias("t"), F.col("dep_id").alias("dep")).join(tn, "t")
    e = e.where("dep IS NOT NULL").select(_key("suite", "t").alias("t"), _key("suite", "dep").alias("d"), "t_seq")
    return e.join(nodes, "d").where(F.col("d_seq") < F.col("t_seq")).select("t", "d", "d_seq")


class _Rounds:
    """Tables of one run, each written once under the shared checkpoint folder."""

    def __init__(self, spark) -> None:
        self.spark, self.path, self._n = spark, work_path(spark, "skips"), 0

    def keep(self, df: DataFrame, wanted: Column | None = None) -> tuple[DataFrame, int]:
        """``df`` written and read back, and how many rows are ``wanted`` (counted while writing)."""
        self._n += 1
        path, seen = f"{self.path}/{self._n}", Observation()
        one = F.lit(1) if wanted is None else F.when(wanted, F.lit(1))
        df.observe(seen, F.count(one).alias("n")).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["n"]


def skip_by_graph(
    raw: DataFrame,
    edges: DataFrame | None = None,
    test_id: str = "test_id",
    seq: str = "seq",
    passed: str = "raw_passed",
    depends_on: str = "depends_on",
) -> DataFrame:
    """Adds boolean ``skipped`` for explicit dependencies, given either as an
    array column ``depends_on`` of ``raw`` or as an edges table (test_id, dep_id).

    A check is identified by its suite and id.  The driver sees only how many
    rows a round leaves to do.
    """
    rounds = _Rounds(raw.sparkSession)
    back, n_edges = rounds.keep(backward_edges(raw, edges, test_id, seq, depends_on))
    keep = [c for c in raw.columns if c != depends_on] if edges is None else raw.columns
    rows = raw.select(*keep)
    failed = raw.where(~F.coalesce(F.col(passed), F.lit(False))).select(_key("suite", test_id).alias("d"))
    new, n_new = rounds.keep(failed.distinct())
    if not n_edges or not n_new:
        return rows.withColumn("skipped", F.lit(False))
    parents, _n = rounds.keep(back.groupBy("t").agg(F.max(F.struct("d_seq", "d")).alias("_p")).select("t", F.col("_p.d").alias("p")))
    inner, _n = rounds.keep(parents.join(parents.select(F.col("p").alias("t")).distinct(), "t", "left_semi"))
    reached = None
    while n_new:
        below, _n = _below(rounds, parents, inner, new, reached)
        reached = below if reached is None else reached.unionByName(below)
        new = new.unionByName(below.select(F.col("t").alias("d")))
        hop = back.join(new, "d", "left_semi").select("t").distinct().join(reached, "t", "left_anti")
        hop, n_new = rounds.keep(hop)
        reached = reached.unionByName(hop)
        new = hop.select(F.col("t").alias("d"))
    marks = reached.distinct().select("t", F.lit(True).alias("skipped"))
    marked = rows.withColumn("_t", _key("suite", test_id)).join(marks.withColumnRenamed("t", "_t"), "_t", "left")
    return marked.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("skipped", F.lit(False)).alias("skipped"))


def _below(rounds: _Rounds, parents: DataFrame, inner: DataFrame, new: DataFrame, reached: DataFrame | None) -> tuple[DataFrame, int]:
    """Checks (t) with one of ``new`` (d) above them in the forest, without ``reached``.

    ``ahead`` has, for every check that others depend on, a pointer p some
    steps up (NULL beyond a root) and whether one of ``new`` was on the way.
    """
    marked = new.select(F.col("d").alias("p"), F.lit(True).alias("hit"))
    if reached is not None:  # what is known need not be passed again: new checks lie below it only by themselves
        inner = inner.join(reached, "t", "left_anti")
    going = ~F.col("hit") & F.col("p").isNotNull()
    ahead, left = rounds.keep(inner.join(marked, "p", "left").select("t", "p", F.coalesce("hit", F.lit(False)).alias("hit")), going)
    while left:
        ahead, left = rounds.keep(_doubled(_doubled(ahead, going), going), going)
    hits = ahead.where("hit").select(F.col("t").alias("p")).unionByName(new.select(F.col("d").alias("p")))
    found = parents.join(hits, "p", "left_semi").select("t")
    return rounds.keep(found if reached is None else found.join(reached, "t", "left_anti"))


def _doubled(ahead: DataFrame, going: Column) -> DataFrame:
    """Every pointer that is still going takes over its target's pointer and hit;
    the others look at themselves, so no key is shared by all that are done."""
    target = ahead.select(F.col("t").alias("_k"), F.col("p").alias("_p2"), F.col("hit").alias("_hit2"))
    moved = ahead.withColumn("_k", F.when(going, F.col("p")).otherwise(F.col("t"))).join(target, "_k", "left")
    return moved.select("t", F.when(going, F.col("_p2")).otherwise(F.col("p")).alias("p"), F.coalesce(F.col("hit") | F.col("_hit2"), F.col("hit")).alias("hit"))


def explode_dependencies(checks: DataFrame, test_id: str = "test_id", depends_on: str = "depends_on") -> DataFrame:
    """Edges (test_id, dep_id) from an array column of dependency ids."""
    return checks.select(F.col(test_id).alias("test_id"), F.explode(F.col(depends_on)).alias("dep_id")).where(
        F.col("dep_id").isNotNull()
    )
