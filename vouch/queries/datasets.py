"""Registered queries for dataset readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.session import work_path
from vouch.sources import content as C
from vouch.sources import datasets as D
from vouch.sources.tables import Tables, table_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Orders that one task sorts and writes, about.
FILE_ROWS = 1 << 19


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Remote manifest from orders, local one from lineitem: a file per order
    and a folder per status (remote) / return flag (local)."""
    t = Tables(spark, sf_dir)
    remote = t.orders.select(F.concat(F.lit("part-"), F.col("o_orderkey").cast("string")).alias("path")).unionByName(
        t.orders.select(F.concat(F.col("o_orderstatus"), F.lit("/")).alias("path")))
    local = t.lineitem.select(F.concat(F.lit("part-"), F.col("l_orderkey").cast("string")).alias("path")).unionByName(
        t.lineitem.select(F.concat(F.col("l_returnflag"), F.lit("/")).alias("path")))
    return local, remote


_MANIFEST_SQL = """remote AS (SELECT DISTINCT path FROM (
    SELECT 'part-' || o_orderkey AS path FROM orders UNION ALL SELECT o_orderstatus || '/' FROM orders)),
local AS (SELECT DISTINCT path FROM (
    SELECT 'part-' || l_orderkey AS path FROM lineitem UNION ALL SELECT l_returnflag || '/' FROM lineitem)),
diff AS (
  SELECT 'extra' AS diff, CASE WHEN path LIKE '%/' THEN 'path' ELSE 'file' END AS kind, path
  FROM local l WHERE NOT EXISTS (SELECT 1 FROM remote r WHERE r.path = l.path)
  UNION ALL
  SELECT 'missing', CASE WHEN path LIKE '%/' THEN 'path' ELSE 'file' END, path
  FROM remote r WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.path = r.path))"""


@query("manifest_diff", f"WITH {_MANIFEST_SQL}\nSELECT diff, kind, path FROM diff")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote = manifests(spark, sf_dir)
    return D.manifest_diff(local, remote)


@query("validate_dataset", f"""
WITH {_MANIFEST_SQL}
SELECT count(*) = 0 AS valid, count(*) FILTER (WHERE diff = 'extra') AS extra,
       count(*) FILTER (WHERE diff = 'missing') AS missing, 0::BIGINT AS changed FROM diff
""")
def validate_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote = manifests(spark, sf_dir)
    return D.validate(local, remote)


@query("install_dataset", "SELECT * FROM lineitem")
def install_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A damaged copy of lineitem (a slice lost, values changed, rows repeated)
    is there already: installing repairs it; installing again leaves it."""
    source, target = table_path(sf_dir, "lineitem"), work_path(spark, "datasets", "lineitem")
    damaged_lineitem(Tables(spark, sf_dir).lineitem).write.parquet(target)
    D.install_table(spark, source, target)
    return D.install_table(spark, source, target, reinstall=False)


def damaged_lineitem(lineitem: DataFrame) -> DataFrame:
    """Lineitem without the returned lines, with the first line of each order
    changed, and with the accepted lines twice."""
    changed = lineitem.where(F.col("l_returnflag") != "R").withColumn(
        "l_linestatus", F.when(F.col("l_linenumber") == 1, F.lit("X")).otherwise(F.col("l_linestatus")))
    return changed.unionByName(lineitem.where(F.col("l_returnflag") == "A"))


@query("repair_dataset", "SELECT * FROM lineitem")
def repair_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A damaged copy of lineitem, whose key (order, line) repeats, repaired
    against the source: every row as often as there."""
    lineitem = Tables(spark, sf_dir).lineitem
    damaged_path = work_path(spark, "damaged", "lineitem")
    damaged_lineitem(lineitem).write.parquet(damaged_path)
    damaged = spark.read.parquet(damaged_path)
    return D.repair_table(lineitem, damaged, ["l_orderkey", "l_linenumber"], work_path(spark, "repaired", "lineitem"))


@query("repair_changes", """
WITH damaged AS (
  SELECT * EXCLUDE (l_linestatus), CASE WHEN l_linenumber = 1 AND l_orderkey % 1000 = 7 THEN 'X' ELSE l_linestatus END AS l_linestatus
  FROM lineitem WHERE l_orderkey % 500 <> 3
  UNION ALL SELECT * EXCLUDE (l_linestatus), l_linestatus FROM lineitem WHERE l_orderkey % 900 = 5),
sides AS (SELECT *, 1 AS w, 0 AS f FROM lineitem UNION ALL BY NAME SELECT *, 0 AS w, 1 AS f FROM damaged),
rows AS (SELECT sum(w) AS w, sum(f) AS f FROM sides
  GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
SELECT sum(least(w, f))::BIGINT AS rows_kept, sum(w - least(w, f))::BIGINT AS rows_added, sum(f - least(w, f))::BIGINT AS rows_dropped,
       0::BIGINT AS rows_wrong FROM rows
""")
def repair_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A versioned copy that lost, changed and repeated a few lines, repaired by
    bucket: rows kept, added and dropped, and rows in which it differs then."""
    lineitem = Tables(spark, sf_dir).lineitem
    changed = lineitem.where("l_orderkey % 500 <> 3").withColumn(
        "l_linestatus", F.when(F.expr("l_linenumber = 1 AND l_orderkey % 1000 = 7"), F.lit("X")).otherwise(F.col("l_linestatus")))
    copy = D.TableCopy(spark, work_path(spark, "datasets", "changes"))
    copy.install(changed.unionByName(lineitem.where("l_orderkey % 900 = 5")), buckets=128)
    report = copy.repair(lineitem)
    changes = D.row_changes(lineitem, copy.read(), mostly_equal=True)
    wrong = sum(changes[c] for c in ("rows_added", "rows_dropped"))
    return spark.createDataFrame([(report["rows_kept"], report["rows_added"], report["rows_dropped"], wrong)],
                                 "rows_kept bigint, rows_added bigint, rows_dropped bigint, rows_wrong bigint")


_STATUS_FILES = "SELECT DISTINCT 'o_orderstatus=' || o_orderstatus || '/' AS folder, o_orderstatus FROM orders"


@query("validate_contents", f"""
WITH folders AS ({_STATUS_FILES})
SELECT 'orders' AS dataset, folder, CASE o_orderstatus WHEN 'F' THEN 'changed' WHEN 'P' THEN 'missing' END AS diff, true AS repaired, 0::BIGINT AS left_over
FROM folders WHERE o_orderstatus IN ('F', 'P') AND EXISTS (SELECT 1 FROM orders)
UNION ALL SELECT 'orders', 'extra/', 'extra', true, 0
""")
def validate_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a folder for each status, and a copy of its files of which those
    of one status have a changed byte, those of another are lost and one is too
    many: found by content, repaired.  A row for each folder that differed; left
    over are the files that differ after the repair or whose damage was not found."""
    base = work_path(spark, "contents")
    source, copy, damaged = f"{base}/source", f"{base}/copy", f"{base}/damaged"
    write_by_status(Tables(spark, sf_dir).orders, source)
    whole = C.stored(C.file_digests(spark, source), "whole")
    C.repair_folder(spark, source, copy, whole.select("path", F.lit(C.MISSING).alias("diff")))
    # The damage goes by the same way as a repair does, from a folder of damaged files.
    changed = whole.where(F.col("path").startswith("o_orderstatus=F/")).select("path", F.lit(C.CHANGED).alias("diff"))
    more = whole.agg(F.lit("extra/more.parquet").alias("path"), F.min("path").alias("origin"))
    lost = whole.where(F.col("path").startswith("o_orderstatus=P/")).select("path", F.lit(C.EXTRA).alias("diff"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spoilt = changed.select("path", F.col("path").alias("origin")).unionByName(more)
    spoilt.repartition(n, "path").mapInPandas(_spoil(source, damaged), "path string").count()
    harm = changed.unionByName(more.select("path", F.lit(C.MISSING).alias("diff"))).unionByName(lost)
    C.repair_folder(spark, damaged, copy, harm)
    found = C.validate_folders(spark, {"orders": (source, copy)})
    left = C.content_differences(whole, C.stored(C.file_digests(spark, copy), "after")).count()
    left += harm.join(found, "path", "left_anti").count()
    folder = F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/"))
    return found.select("dataset", folder.alias("folder"), "diff", "repaired", F.lit(left).cast("bigint").alias("left_over")).distinct()


def write_by_status(orders: DataFrame, target: str) -> None:
    """Orders in a folder for each status; a task sorts and writes about
    ``FILE_ROWS`` rows, so more rows make more files and not larger ones."""
    tasks = max(1, -(-orders.count() // FILE_ROWS))
    dealt = orders.withColumn("_deal", F.monotonically_increasing_id()).repartition(tasks, "_deal").drop("_deal")
    dealt.write.partitionBy("o_orderstatus").parquet(target)


def _spoil(source: str, target: str):
    """mapInPandas body: write the files of ``origin`` as ``path``, each with its
    middle byte changed, block by block (without an origin: an empty file)."""
    import pandas as pd

    def run(frames):
        from_fs, from_root = C.located(source)
        to_fs, to_root = C.located(target)
        for frame in frames:
            for path, origin in zip(frame["path"], frame["origin"], strict=True):
                to_fs.create_dir(f"{to_root}/{path.rpartition('/')[0]}", recursive=True)
                with to_fs.open_output_stream(f"{to_root}/{path}") as out:
                    if pd.isna(origin):
                        continue
                    with from_fs.open_input_file(f"{from_root}/{origin}") as f:
                        middle = f.size() // 2
                        while block := bytearray(f.read(C.CHUNK)):
                            if 0 <= middle < len(block):
                                block[middle] ^= 1
                            middle -= len(block)
                            out.write(bytes(block))
            yield pd.DataFrame({"path": frame["path"]})

    return run


@query("prefer_staged", "SELECT * FROM orders")
def prefer_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty staged copy (written from an empty filter) loses to the source."""
    orders = Tables(spark, sf_dir).orders
    staged = work_path(spark, "staged", "orders")
    orders.where(F.col("o_totalprice") < 0).write.mode("overwrite").parquet(staged)
    chosen = D.choose_source(spark, staged, table_path(sf_dir, "orders"))
    return D.prefer_staged(spark.read.parquet(chosen), orders)


@query("text_line_counts", """
WITH wanted AS (SELECT doc_id FROM documents UNION ALL SELECT -1 - item_id FROM benchmark)
SELECT w.doc_id, CASE WHEN d.doc_id IS NOT NULL THEN len(string_split(d.text, chr(10))) + 1 END AS n_lines,
       d.doc_id IS NOT NULL AS found
FROM wanted w LEFT JOIN documents d ON d.doc_id = w.doc_id
""")
def text_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and one wanted text that is absent for each benchmark item."""
    t = Tables(spark, sf_dir)
    wanted = t.documents.select("doc_id").unionByName(t.benchmark.select((-1 - F.col("item_id")).alias("doc_id")))
    return D.text_line_counts(wanted, t.documents.select("doc_id", "text"), "doc_id")
