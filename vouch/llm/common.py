"""Helpers shared by the text operators: written cuts, prefix sums, labels.

Rules that hold for every operator of this package:

* a null text counts as an empty text;
* a document is a row; rows equal in every column get equal results;
* only the named input columns are read, so extra columns (also ones whose
  names equal an internal name) never reach an operator's own columns;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vouch.session import work_path

#: The six characters that separate words and are stripped from lines.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    This cuts the lineage with files every executor can reach, so a lost
    executor never forces the work before the cut to run again.
    """
    spark = df.sparkSession
    path = work_path(spark, "llm", name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of ``value`` with the value computed once.

    A lambda variable is bound to the value, so the optimizer cannot copy an
    expensive expression into an inner lambda and run it for every element.
    """
    return F.transform(F.array(value), body)[0]


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two differently seeded 64-bit hashes."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def join_on(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on equally named columns, kept once from the left.

    The right side's keys are renamed first, so frames made from one another
    can be joined.
    """
    others = [c for c in right.columns if c not in names]
    renamed = right.select(*[F.col(n).alias(f"_r_{n}") for n in names], *others)
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(f"_r_{n}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{n}" for n in names])


def preceding_sums(df: DataFrame, groups: list[str], chunk: str, value: Column, out: str) -> DataFrame:
    """One row per (groups, chunk) with the sum of ``value`` over the chunks before it.

    ``chunk`` has a bounded number of values, so the window holds a bounded
    number of rows for each group however many rows the group has.
    """
    w = Window.partitionBy(*groups).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*groups, chunk).agg(F.sum(value).alias("_v"))
    return sums.select(*groups, chunk, F.coalesce(F.sum("_v").over(w), F.lit(0).cast("bigint")).alias(out))


def running_total(df: DataFrame, groups: list[str], chunk: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Add the exclusive running sum of ``value`` in each group, ordered by
    (chunk, order): sums of whole chunks, plus a window inside each chunk.

    No task sees a whole group.  ``df`` is read twice and has to be a written
    table or cheap.
    """
    before = preceding_sums(df, groups, chunk, value, "_before")
    inner = Window.partitionBy(*groups, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0).cast("bigint")))
    return join_on(part, before, [*groups, chunk]).select(*df.columns, (F.col("_before") + F.col("_inner")).alias(out))


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a bigint, b bigint).

    Alternating star contraction: every round joins each node's larger
    neighbours to its smallest neighbour, then its smaller ones.  A node's
    neighbours are only ever aggregated (min) and joined, never gathered into
    a list, so a hub with very many edges stays spread over tasks.  Each round
    is a written table; rounds end when no edge changes.  Returns
    (node, component) for the nodes that occur in an edge.
    """
    spark = edges.sparkSession
    cur = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    stats = _edge_stats(cur)
    while stats[0]:
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        cur = written(small.filter("a <> b").distinct(), name)
        now = _edge_stats(cur)
        if now == stats:
            break
        stats = now
    nodes = cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = cur.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    roots = roots.join(nodes.select("node"), "node", "left_anti")
    if not stats[0]:
        return spark.createDataFrame([], T.StructType([T.StructField("node", T.LongType()), T.StructField("component", T.LongType())]))
    return nodes.union(roots)


def _edge_stats(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return (r["n"], r["h"])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of at most ``rows`` documents."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


#: A table of classes with at most so many rows may be broadcast.
FEW_CLASSES = 1 << 16


def sampled(rows: DataFrame, group: str, key: str, per_group: int) -> DataFrame:
    """About ``per_group`` rows (all, where fewer) of each value of ``group``.

    A row is taken when the hash of its key falls below per_group / rows of
    the group; counts are the only thing gathered, so no group is sorted, and
    the sample of a table is always the same.  The counts are broadcast where
    they are few (counted first), so texts are not shuffled by their class; a
    column of very many values is joined plainly.
    """
    counts = written(rows.groupBy(group).agg((F.lit(float(per_group)) / F.count(F.lit(1))).alias("_share")), "sample-counts")
    if counts.count() <= FEW_CLASSES:
        counts = F.broadcast(counts)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(counts, group).filter(draw < F.col("_share")).drop("_share")


#: A class with more than one row in so many is hot; there are fewer hot classes than this.
HOT_SHARE = 1000


def by_class(rows: DataFrame, classes: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of their class (inner join on ``key``, which is
    never null; ``classes`` has each key once and is a written table).

    ``count`` is the number of rows of the class.  A class with more than a
    thousandth of all rows would land in one task; there are fewer than a
    thousand such classes, so they are broadcast, and the other rows are shuffled.
    """
    total = classes.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    hot = F.broadcast(classes.filter(is_hot).drop(count))
    found = rows.join(hot, key)
    rest = rows.join(F.broadcast(classes.filter(is_hot).select(key)), key, "left_anti")
    return found.unionByName(rest.join(classes.filter(~is_hot).drop(count), key))
