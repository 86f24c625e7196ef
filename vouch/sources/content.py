"""Dataset folders compared by what their files hold.

Spark lists the files and deals their chunks over tasks, which read and hash
one chunk at a time; the chunk hashes (64 bytes each) are folded into one digest
a file, and the files' digests into one for every folder above them (order-free
sums, so a folder of any number of files is a partial aggregate).  Two folders are equal when their root digests
are, one row each; only below folders that differ are files compared by path.

``validate_folders`` is the whole flow for declared datasets: compare, then
raise (``fail_fast``) or copy what is missing or changed, delete what is extra,
and compare again.  Copies run on the executors.

No task holds a file, whose length is therefore free, and the chunks of one
file are hashed by many tasks.  Names that start with ``_`` or ``.`` are not
looked at, as by every file source of Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.functions.canonical import LANES, digest_sums, same_digest
from vouch.session import path_exists, work_path
from vouch.sources.files import list_files, list_tree

MISSING, EXTRA, CHANGED = "missing", "extra", "changed"
#: Bytes hashed at a time.
CHUNK = 4 << 20
FILE_SCHEMA = "path string, length bigint, digest string"


class InvalidDataset(RuntimeError):
    """A dataset differs from its source; the message names the first paths."""


def located(root: str):
    """(file system of pyarrow, folder in it) of a path or URI."""
    from pyarrow import fs as pafs

    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def _hash_chunks(root: str, chunk: int):
    """mapInPandas body: (path, length, offset, hash) of the named chunks, one in
    memory at a time.  A file whose length is no longer the listed one raises."""
    import hashlib

    def run(frames):
        files, base = located(root)
        for frame in frames:
            hashes = {}
            for path, part in frame.groupby("path", sort=False):
                with files.open_input_file(f"{base}/{path}") as f:
                    for i, length, offset in zip(part.index, part["length"], part["offset"], strict=True):
                        if f.size() != length:
                            raise OSError(f"{path} was listed with {length} bytes and has {f.size()}")
                        hashes[i] = hashlib.sha256(f.read_at(min(chunk, length - offset), offset)).hexdigest()
            yield frame.assign(hash=[hashes[i] for i in frame.index])

    return run


def file_digests(spark: SparkSession, root: str, chunk: int = CHUNK) -> DataFrame:
    """(path relative to root, length, digest) of every file below a folder."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], FILE_SCHEMA)
    listed = list_files(spark, root, include_dirs=False).where("length > 0")
    offsets = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(chunk).cast("bigint"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = listed.select("path", "length", F.explode(offsets).alias("offset")).repartition(n, "path", "offset")
    hashed = chunks.mapInPandas(_hash_chunks(root.rstrip("/"), chunk), "path string, length bigint, offset bigint, hash string")
    files = hashed.groupBy("path", "length").agg(F.sort_array(F.collect_list(F.struct("offset", "hash"))).alias("chunks"))
    files = files.select("path", "length", F.sha2(F.array_join("chunks.hash", ""), 256).alias("digest"))
    # Spark's file sources pass over empty files, so these come from a walk.
    walked = list_tree(spark.createDataFrame([(root.rstrip("/"),)], "root string"))
    empty = walked.where("NOT is_dir AND length = 0").where(~F.col("path").rlike(r"(^|/)[._]"))
    return files.unionByName(empty.select("path", "length", F.sha2(F.lit(""), 256).alias("digest")))


def folders_above(path: Column) -> Column:
    """The folders that hold a path, the root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i > 0, "/").otherwise("")))


def digest_tree(files: DataFrame) -> DataFrame:
    """(folder, n, d0..d3): number and digest of the files below every folder."""
    named = files.select(F.explode(folders_above(F.col("path"))).alias("folder"), F.xxhash64("path", "length", "digest").alias("_h1"),
                         F.xxhash64("digest", "length", "path").alias("_h2"))
    return named.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), *digest_sums(F.col("_h1"), F.col("_h2")))


def differing_folders(source: DataFrame, copy: DataFrame) -> DataFrame:
    """(folder) whose digests differ between two trees, those of one side included."""
    both = source.alias("l").join(copy.alias("r"), F.col("l.folder") == F.col("r.folder"), "full_outer")
    return both.where(~same_digest("l", "r")).select(F.coalesce("l.folder", "r.folder").alias("folder"))


def content_differences(source: DataFrame, copy: DataFrame) -> DataFrame:
    """(path, diff): files that the copy misses, has beyond the source, or holds
    with other bytes.  Only files in folders that differ are joined by path."""
    suspect = differing_folders(digest_tree(source), digest_tree(copy))

    def inside(files: DataFrame) -> DataFrame:
        own = F.element_at(folders_above(F.col("path")), -1)
        return files.withColumn("folder", own).join(suspect, "folder", "left_semi").drop("folder")

    both = inside(source).alias("l").join(inside(copy).alias("r"), F.col("l.path") == F.col("r.path"), "full_outer")
    diff = F.when(F.col("r.path").isNull(), MISSING).when(F.col("l.path").isNull(), EXTRA).when(
        (F.col("l.length") != F.col("r.length")) | (F.col("l.digest") != F.col("r.digest")), CHANGED)
    return both.select(F.coalesce("l.path", "r.path").alias("path"), diff.alias("diff")).where("diff IS NOT NULL")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of this run, so that files are hashed once."""
    path = work_path(df.sparkSession, "content", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _apply(source: str, target: str):
    """mapInPandas body: copy or delete the files of a partition (an attempt that
    is repeated does the same again)."""
    import pandas as pd
    from pyarrow import fs as pafs

    def run(frames):
        from_fs, from_root = located(source)
        to_fs, to_root = located(target)
        for frame in frames:
            for path, diff in zip(frame["path"], frame["diff"], strict=True):
                there, hidden = f"{to_root}/{path}", f"{to_root}/{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}.crc"
                for old in (there, hidden):  # the checksum beside a local file is of the old bytes
                    if to_fs.get_file_info(old).type != pafs.FileType.NotFound:
                        to_fs.delete_file(old)
                if diff != EXTRA:
                    to_fs.create_dir(there.rpartition("/")[0], recursive=True)
                    pafs.copy_files(f"{from_root}/{path}", there, source_filesystem=from_fs, destination_filesystem=to_fs)
            yield pd.DataFrame({"path": frame["path"]})

    return run


def repair_folder(spark: SparkSession, source: str, target: str, differences: DataFrame) -> int:
    """Make the named files of ``target`` those of ``source``; returns their number."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    done = differences.repartition(n, "path").mapInPandas(_apply(source.rstrip("/"), target.rstrip("/")), "path string")
    return done.count()


def validate_folders(spark: SparkSession, datasets: dict[str, tuple[str, str]], fail_fast: bool = False, repair: bool = True,
                     chunk: int = CHUNK) -> DataFrame:
    """(dataset, path, diff, repaired) of every file that differs.

    ``datasets`` names (source folder, copy).  With ``fail_fast`` the first
    dataset that differs raises.  Otherwise, with ``repair``, its files are made
    right and it is compared again; it raises if it differs still.
    """
    out = spark.createDataFrame([], "dataset string, path string, diff string, repaired boolean")
    for name, (source, target) in datasets.items():
        wanted = stored(file_digests(spark, source, chunk), "source")
        found = stored(content_differences(wanted, stored(file_digests(spark, target, chunk), "copy")), "differences")
        first = [r["path"] for r in found.orderBy("path").limit(5).collect()]
        if first and fail_fast:
            raise InvalidDataset(f"{name}: {', '.join(first)} differ from {source}")
        if first and repair:
            repair_folder(spark, source, target, found)
            left = content_differences(wanted, stored(file_digests(spark, target, chunk), "repaired"))
            if not left.isEmpty():
                raise InvalidDataset(f"{name} differs from {source} after its repair")
        out = out.unionByName(found.select(F.lit(name).alias("dataset"), "path", "diff", F.lit(bool(first and repair)).alias("repaired")))
    return out
