"""File listings as DataFrames (recursive, relative, with directories)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.session import path_exists

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("is_dir", T.BooleanType(), False),
        T.StructField("length", T.LongType(), True),
    ]
)


def qualify(spark: SparkSession, path: str) -> str:
    """Fully qualified form of a path, the form file sources report."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return str(fs.makeQualified(jpath).toString())


def norm_uri(c):
    """``file:/x``, ``file:///x`` and ``/x`` all become ``/x``; other schemes stay."""
    return F.regexp_replace(c, "^file:/+", "/")


def norm_root(spark: SparkSession, root: str) -> str:
    import re

    return re.sub("^file:/+", "/", qualify(spark, root)).rstrip("/") + "/"


def list_files(spark: SparkSession, root: str, include_dirs: bool = True) -> DataFrame:
    """Recursive listing of ``root``: (path relative to root, is_dir, length).

    The listing is a ``binaryFile`` scan with only ``path`` and ``length``
    selected, so file contents are never read (the column is pruned).  The
    file index is built in parallel on the cluster for large trees.  Like
    every Spark file source it skips names starting with ``_`` or ``.``.
    Directories are derived from the file paths (every proper prefix ending
    in ``/``).  A missing root gives an empty listing.
    """
    if not path_exists(spark, root):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    base = norm_root(spark, root)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length")
    )
    rel = F.substring(norm_uri(F.col("path")), len(base) + 1, 1 << 30)
    files = files.select(rel.alias("path"), F.lit(False).alias("is_dir"), F.col("length").cast("long").alias("length"))
    if not include_dirs:
        return files
    parts = F.split(F.col("path"), "/")
    dirs = (
        files.where(F.size(parts) > 1)
        .select(F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("i"), parts.alias("p"))
        .select(F.concat(F.array_join(F.slice(F.col("p"), F.lit(1), F.col("i")), "/"), F.lit("/")).alias("path"))
        .distinct()
        .select("path", F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("length"))
    )
    return files.unionByName(dirs)


def write_manifest(listing: DataFrame, target: str) -> DataFrame:
    """Persist a listing as a parquet table (sorted by path) and read it back."""
    listing.orderBy("path").write.mode("overwrite").parquet(target)
    return listing.sparkSession.read.parquet(target)


TREE_SCHEMA = "root string, path string, is_dir boolean, length long"


def _walk_roots(batches):
    """mapInPandas body: list every root folder of the batch recursively,
    hidden entries included (``_x`` and ``.x``), with ``pyarrow.fs`` (local
    disks, object stores and HDFS alike)."""
    import pandas as pd
    from pyarrow import fs as pafs

    for pdf in batches:
        out = []
        for root in pdf["root"]:
            # An unknown scheme or an unreadable root raises: an empty listing
            # would make a diff call every file missing.  A root that is not
            # there lists as empty.
            if "://" in root or root.startswith("file:"):
                filesystem, base = pafs.FileSystem.from_uri(root)
            else:
                filesystem, base = pafs.LocalFileSystem(), root
            base = base.rstrip("/")
            infos = filesystem.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
            for info in infos:
                rel = info.path[len(base) + 1:]
                is_dir = info.type == pafs.FileType.Directory
                out.append((root, rel + "/" if is_dir else rel, is_dir, None if is_dir else int(info.size)))
        yield pd.DataFrame(out, columns=["root", "path", "is_dir", "length"])


def list_tree(roots: DataFrame, column: str = "root") -> DataFrame:
    """Recursive listing of many root folders in parallel, hidden entries
    included: (root, relative path, is_dir, length).  Each task walks the
    roots of its partition; give one root per dataset so the walk spreads."""
    r = roots.select(F.col(column).alias("root")).distinct()
    n = max(1, int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return r.repartition(n, "root").mapInPandas(_walk_roots, TREE_SCHEMA)
