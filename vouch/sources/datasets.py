"""Dataset readiness: manifest diff, verdict, install, repair, staged source.

The manifest diff is one grouped union (both directions in one shuffle), a
verdict is an aggregate of the diff.  Copies are compared with their source by
digests of hash buckets; a repair writes only the buckets that differ.
Writes go to fresh folders through Spark's commit protocol, so a lost
executor only re-runs its tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions.canonical import digest_sums, row_hashes, same_digest
from vouch.functions.text import line_count, path_kind
from vouch.session import path_exists, work_path
from vouch.sources.files import norm_root, norm_uri
from vouch.sources.tables import path_bytes
from vouch.sources.versions import VersionLog, delete, list_lengths, list_names

EXTRA, MISSING, CHANGED = "extra", "missing", "changed"


def manifest_diff(local: DataFrame, remote: DataFrame, path: str = "path") -> DataFrame:
    """(diff, kind, path): every local path not in the remote manifest is
    ``extra``, every remote path not present locally is ``missing``.
    ``kind`` is ``path`` for directories (trailing ``/``), else ``file``.

    Both manifests are tagged, unioned and grouped by path: ONE shuffle,
    with repeated paths collapsed map-side, instead of two distincts and two
    anti joins."""
    tagged = local.select(F.col(path).alias("path"), F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        remote.select(F.col(path).alias("path"), F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    sides = tagged.groupBy("path").agg(F.max("_l").alias("_in_l"), F.max("_r").alias("_in_r"))
    one_sided = sides.where(F.col("_in_l") != F.col("_in_r"))
    return one_sided.select(
        F.when(F.col("_in_l") == 1, F.lit(EXTRA)).otherwise(F.lit(MISSING)).alias("diff"),
        path_kind("path").alias("kind"), "path")


def length_changes(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Paths present on both sides whose ``length`` differs."""
    j = local.select("path", F.col("length").alias("l_len")).join(
        remote.select("path", F.col("length").alias("r_len")), "path"
    )
    return j.where(~F.col("l_len").eqNullSafe(F.col("r_len"))).select(
        F.lit(CHANGED).alias("diff"), path_kind("path").alias("kind"), "path"
    )


def validate(local: DataFrame, remote: DataFrame, compare_length: bool = False) -> DataFrame:
    """One-row verdict (valid, extra, missing, changed)."""
    diff = manifest_diff(local, remote)
    if compare_length:
        diff = diff.unionByName(length_changes(local, remote))
    agg = diff.agg(
        F.count_if(F.col("diff") == EXTRA).alias("extra"),
        F.count_if(F.col("diff") == MISSING).alias("missing"),
        F.count_if(F.col("diff") == CHANGED).alias("changed"),
    )
    return agg.select(
        ((F.col("extra") + F.col("missing") + F.col("changed")) == 0).alias("valid"), "extra", "missing", "changed"
    )


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write of this folder was committed (a half-written one was not)."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS") or bool(VersionLog(spark, path).numbers())


# ----------------------------------------------------------------------
# copies that are verified and repaired by bucket
# ----------------------------------------------------------------------
#: Name of the partition folders of a copy, bytes of source for one bucket, and
#: the least and greatest number of buckets.
BUCKET, _BUCKET_BYTES, _LEAST, _MOST = "vouch_bucket", 128 << 20, 16, 1 << 16
#: A bucket with so many times the mean number of rows is written by several tasks.
_HOT = 4
#: Rows that one task sorts and writes, about.
_TASK_ROWS = 1 << 19
#: Buckets of two tables that are expected to be equal.
_FINE = 1 << 10


def bucket_digests(rows: DataFrame, buckets: int, by: Column | None = None) -> DataFrame:
    """(bucket, n, d0..d3): row count and order-free digest of each bucket, a
    partial aggregate that shuffles at most a row a bucket and task.  A bucket
    is taken from the row's hash, or from ``by``."""
    h1, h2 = row_hashes(rows, rows.columns)
    bucket = _bucket_of(h1, buckets) if by is None else by
    hashed = rows.select(bucket.alias("bucket"), h1.alias("_h1"), h2.alias("_h2"))
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *digest_sums(F.col("_h1"), F.col("_h2")))


def _bucket_of(h1: Column, buckets: int) -> Column:
    return F.pmod(h1, F.lit(buckets)).cast("int")


def differing_buckets(left: DataFrame, right: DataFrame) -> list[int]:
    """The buckets whose digests differ, at most as many as there are buckets."""
    joined = left.alias("l").join(right.alias("r"), F.col("l.bucket") == F.col("r.bucket"), "full_outer")
    found = joined.where(~same_digest("l", "r")).select(F.coalesce("l.bucket", "r.bucket").alias("bucket"))
    return sorted(r["bucket"] for r in found.collect())


class TableCopy:
    """A copy of a table in buckets by row hash, as a versioned folder.

    A version names the files of every bucket with their lengths.  A repair
    compares digests of both sides bucket by bucket (no row is shuffled),
    writes the buckets that differ anew and commits a version that names the
    new files beside the untouched ones.  Files that are lost, cut short or
    unreadable make their bucket differ; files that no version names are never
    read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = VersionLog(spark, path)

    def files(self, entry: dict, buckets: list[int] | None = None) -> list[str]:
        chosen = entry["files"] if buckets is None else {str(b): entry["files"].get(str(b), []) for b in buckets}
        return [f"{self.path}/{name}" for names in chosen.values() for name, _length in names]

    def read(self) -> DataFrame:
        number, entry = self.log.latest()
        if not number:
            raise ValueError(f"{self.path} holds no committed copy")
        return self._read(entry, self.files(entry))

    def _read(self, entry: dict, files: list[str], lenient: bool = False) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        if lenient:  # lost files are left out
            there = list_lengths(self.spark, f"{self.path}/data")
            files = [f for f in files if f[len(f"{self.path}/data/"):] in there]
        if not files:
            return self.spark.createDataFrame([], schema)
        flag = str(lenient).lower()
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", flag).option("ignoreMissingFiles", flag).parquet(*files)

    def _write(self, rows: DataFrame, counts: dict[int, int], buckets: int) -> dict[str, list]:
        """The files by bucket of ``rows``, which are dealt by bucket; a bucket
        of many rows, or many copies of a row, is dealt over several tasks, so
        with more rows there are more tasks and not larger ones."""
        folder = self.log.fresh_data()
        h1, _h2 = row_hashes(rows, rows.columns)
        total = sum(counts.values())
        mean = max(1, total // max(1, len(counts)))
        each = -(-mean // _TASK_ROWS)
        hot = {b: -(-n * each // mean) for b, n in counts.items() if n > _HOT * mean}  # at most a quarter of all
        parts = F.lit(each)
        if hot:
            sizes = F.map_from_entries(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("parts")) for b, n in hot.items()]))
            parts = F.coalesce(F.try_element_at(sizes, F.col(BUCKET)), F.lit(each))
        dealt = rows.withColumn(BUCKET, _bucket_of(h1, buckets)).withColumn("_deal", F.pmod(F.monotonically_increasing_id(), parts))
        pieces = each * (len(counts) - len(hot)) + sum(hot.values())
        tasks = max(min(pieces, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), -(-total // _TASK_ROWS))
        dealt.repartition(max(1, tasks), BUCKET, "_deal").drop("_deal").write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        out: dict[str, list] = {}
        for name, length in sorted(list_lengths(self.spark, f"{self.path}/{folder}").items()):
            if name.startswith(f"{BUCKET}=") and name.endswith(".parquet"):
                out.setdefault(name.split("/")[0].split("=")[1], []).append([f"{folder}/{name}", length])
        return out

    def install(self, source: DataFrame, buckets: int) -> None:
        """Write a whole new version and verify it."""
        number, _entry = self.log.latest()
        wanted = _stored_digests(source, buckets)
        counts = {r["bucket"]: r["n"] for r in wanted.collect()}  # one row a bucket
        files = self._write(source, counts, buckets) if counts else {}
        entry = {"schema": source.schema.jsonValue(), "buckets": buckets, "files": files}
        self._verify(entry, wanted, sorted(counts))
        self.log.commit(number, entry)

    def _digests(self, entry: dict, buckets: list[int] | None, lenient: bool) -> DataFrame:
        """Digests of the copy, a row in the bucket whose folder it was found in."""
        rows = self._read(entry, self.files(entry, buckets), lenient)
        place = F.regexp_extract(F.col("_metadata.file_path"), f"{BUCKET}=([0-9]+)/", 1).cast("int")
        if not self.files(entry, buckets):
            place = F.lit(0)
        return bucket_digests(rows, entry["buckets"], place)

    def _verify(self, entry: dict, wanted: DataFrame, buckets: list[int]) -> None:
        if differing_buckets(wanted.where(F.col("bucket").isin(buckets)), self._digests(entry, buckets, lenient=False)):
            raise RuntimeError(f"{self.path}: what was written differs from its source")

    def damaged(self, source: DataFrame) -> list[int]:
        """The buckets of the newest version that differ from the source."""
        return self._damage(source)[2]

    def _damage(self, source: DataFrame) -> tuple[int, dict, list[int], DataFrame]:
        number, entry = self.log.latest()
        wanted = _stored_digests(source, entry["buckets"])
        sizes = list_lengths(self.spark, f"{self.path}/data")
        cut = {int(b) for b, names in entry["files"].items() if any(sizes.get(n[len("data/"):]) != length for n, length in names)}
        whole = [int(b) for b in entry["files"] if int(b) not in cut]  # files of the wrong length are not even read
        bad = differing_buckets(wanted, self._digests(entry, whole, lenient=True))
        return number, entry, sorted(cut.union(bad)), wanted

    def repair(self, source: DataFrame) -> dict[str, int]:
        """Rewrite the buckets that differ from the source; returns the rows
        kept, added and dropped (as multisets) and the buckets kept and written."""
        number, entry = self.log.latest()
        if not number or T.StructType.fromJson(entry["schema"]) != source.schema:
            raise ValueError(f"{self.path} holds no copy of these columns")
        number, entry, bad, wanted = self._damage(source)
        counts = {r["bucket"]: r["n"] for r in wanted.collect()}  # one row a bucket
        report = {"rows_kept": sum(n for b, n in counts.items() if b not in bad), "rows_added": 0, "rows_dropped": 0,
                  "buckets_kept": len(set(counts) - set(bad)), "buckets_written": len(set(bad) & set(counts))}
        if not bad:
            return report
        lost = self._read(entry, self.files(entry, bad), lenient=True)
        fresh = _in_buckets(source, entry["buckets"], bad)
        report = {n: v + report[n] if n == "rows_kept" else v for n, v in row_changes(fresh, lost).items()} | {n: report[n] for n in report if n.startswith("buckets")}
        files = self._write(fresh, {b: counts[b] for b in bad if b in counts}, entry["buckets"]) if set(bad) & set(counts) else {}
        kept = {b: names for b, names in entry["files"].items() if int(b) not in bad}
        after = entry | {"files": kept | files}
        self._verify(after, wanted, bad)
        self.log.commit(number, after)
        return report

    def vacuum(self, keep: int = 1) -> int:
        return self.log.vacuum(keep, lambda e: sorted({"/".join(n.split("/")[:2]) for names in e["files"].values() for n, _length in names}))


def _stored_digests(rows: DataFrame, buckets: int) -> DataFrame:
    """Digests kept as a table of one row a bucket, so the source is read once."""
    path = work_path(rows.sparkSession, "digests")
    digests = bucket_digests(rows, buckets)
    digests.write.parquet(path)
    return rows.sparkSession.read.schema(digests.schema).parquet(path)


def _in_buckets(rows: DataFrame, buckets: int, chosen: list[int]) -> DataFrame:
    """The rows of the chosen buckets (a list bounded by the number of buckets)."""
    h1, _h2 = row_hashes(rows, rows.columns)
    ids = F.broadcast(rows.sparkSession.createDataFrame([(b,) for b in chosen], f"{BUCKET} int"))
    return rows.withColumn(BUCKET, _bucket_of(h1, buckets)).join(ids, BUCKET, "left_semi").drop(BUCKET)


def row_changes(wanted: DataFrame, found: DataFrame, mostly_equal: bool = False) -> dict[str, int]:
    """Rows kept, added and dropped from ``found`` to ``wanted``, as multisets;
    rows are told apart by 128-bit hashes, combined before the shuffle.  With
    ``mostly_equal``, buckets are first compared by digest, which shuffles no
    row, and only rows of buckets that differ are counted one by one."""
    if mostly_equal:
        digests = [_stored_digests(rows, _FINE) for rows in (wanted, found)]
        bad = differing_buckets(*digests)
        kept = digests[0].where(~F.col("bucket").isin(bad)).agg(F.sum("n").alias("n")).first()["n"] or 0  # one row
        if not bad:
            return {"rows_kept": kept, "rows_added": 0, "rows_dropped": 0}
        rest = row_changes(_in_buckets(wanted, _FINE, bad), _in_buckets(found, _FINE, bad))
        return rest | {"rows_kept": rest["rows_kept"] + kept}
    sides = []
    for rows, w in ((wanted, 1), (found, 0)):
        h1, h2 = row_hashes(rows, rows.columns)
        sides.append(rows.select(h1.alias("_h1"), h2.alias("_h2"), F.lit(w).alias("_w")))
    each = sides[0].unionByName(sides[1]).groupBy("_h1", "_h2").agg(F.sum("_w").alias("w"), F.sum(1 - F.col("_w")).alias("f"))
    r = each.agg(F.sum(F.least("w", "f")).alias("kept"), F.sum("w").alias("w"), F.sum("f").alias("f")).first()  # one row
    kept, w, f = (r[c] or 0 for c in ("kept", "w", "f"))
    return {"rows_kept": kept, "rows_added": w - kept, "rows_dropped": f - kept}


def _bucket_count(spark: SparkSession, path: str) -> int:
    n = -(-path_bytes(spark, path) // _BUCKET_BYTES)
    return max(_LEAST, min(_MOST, 1 << max(0, n - 1).bit_length()))


def install_table(spark: SparkSession, source: str, target: str, reinstall: bool = False) -> DataFrame:
    """Copy one parquet dataset, or make an existing copy right.

    The copy is a versioned folder (``TableCopy``): where one was committed, only
    the buckets that differ from the source are written.  A plain folder at the
    target stays as it is if it equals the source; a half-written or different
    one is replaced by a versioned copy.  Raises if what was written differs.
    """
    src, copy = spark.read.parquet(source), TableCopy(spark, target)
    number, entry = copy.log.latest()
    managed = number and T.StructType.fromJson(entry["schema"]) == src.schema
    if managed and not reinstall:
        copy.repair(src)
        return copy.read()
    if not number and not reinstall and is_complete(spark, target):
        plain = spark.read.parquet(target)
        if plain.schema == src.schema and not _differs(src, plain, _bucket_count(spark, source)):
            return plain
    before = [n for n in list_names(spark, target) if n not in ("_versions", "data")]
    copy.install(src, _bucket_count(spark, source))
    for name in before:  # the plain files that the committed copy replaces
        delete(spark, f"{copy.path}/{name}")
    return copy.read()


def _differs(source: DataFrame, copy: DataFrame, buckets: int = _LEAST) -> bool:
    return bool(differing_buckets(bucket_digests(source, buckets), bucket_digests(copy, buckets)))


def repair_table(source: DataFrame, target: DataFrame, key: list[str], out_path: str, buckets: int = 1024) -> DataFrame:
    """A damaged copy made right in a new folder: rows of the buckets that equal
    the source's are taken from the copy, all others from the source, so
    repeated keys and repeated rows come out as often as the source has them.

    Buckets are compared by digest; no row is shuffled.  ``key`` names the
    columns by which the caller tells rows apart (they have to be there).
    The folder is read back and verified.
    """
    for k in key:
        if k not in source.columns:
            raise ValueError(f"unknown key column: {k}")
    wanted = _stored_digests(source, buckets)
    target = target.select(*[F.col(f"`{c}`") for c in source.columns])
    if target.schema != source.schema:
        target = target.limit(0)  # nothing of it can be kept
    bad = differing_buckets(wanted, bucket_digests(target, buckets))
    good = sorted(set(range(buckets)) - set(bad))
    _in_buckets(target, buckets, good).unionByName(_in_buckets(source, buckets, bad)).write.mode("overwrite").parquet(out_path)
    out = source.sparkSession.read.parquet(out_path)
    if differing_buckets(wanted, bucket_digests(out, buckets)):
        raise RuntimeError("the repaired copy differs from its source")
    return out


def has_data(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    """True when the folder exists and holds at least one row (a read that
    stops at the first row; an empty frame's schema-only file does not count)."""
    try:
        return path_exists(spark, path) and not spark.read.format(fmt).load(path).isEmpty()
    except Exception:  # noqa: BLE001 - any error means "not usable"
        return False


def choose_source(spark: SparkSession, staged: str, remote: str, fmt: str = "parquet") -> str:
    """The staged copy when it exists and is not empty, else the remote one."""
    return staged if has_data(spark, staged, fmt) else remote


def prefer_staged(staged: DataFrame, remote: DataFrame) -> DataFrame:
    """DataFrame form: the staged frame unless it is empty."""
    try:
        return remote if staged.isEmpty() else staged
    except Exception:  # noqa: BLE001
        return remote


def readme_line_counts(spark: SparkSession, datasets: DataFrame, root: str, default: str = "README.md",
                       mapping: dict[str, str] | None = None) -> DataFrame:
    """Per dataset (column ``name``), the line count of its readme, or a
    NULL count and ``found = false`` when the file is absent.

    All readmes are read in one ``text(wholetext=True)`` scan and joined
    back, a left join from the dataset list so absent ones stay.
    """
    mapping = mapping or {}
    names = datasets.select("name")
    readme = F.coalesce(
        *([F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])[F.col("name")]] if mapping else []),
        F.lit(default),
    )
    base = root.rstrip("/") + "/"
    wanted = names.select("name", F.concat(F.lit(base), F.col("name"), F.lit("/"), readme).alias("file"))
    if not path_exists(spark, root):
        return text_line_counts(wanted, spark.createDataFrame([], "file string, text string"), "file")
    glob = "{" + ",".join(sorted({default, *mapping.values()})) + "}"
    texts = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .text(root, wholetext=True)
        .select(F.col("value").alias("text"), F.input_file_name().alias("uri"))
    )
    qualified = norm_root(spark, root)
    texts = texts.select(
        F.concat(F.lit(base), F.substring(norm_uri(F.col("uri")), len(qualified) + 1, 1 << 30)).alias("file"), "text")
    return text_line_counts(wanted, texts, "file")


def text_line_counts(wanted: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Left join of wanted keys with texts: (key, n_lines, found).

    Lines are counted where the texts are read, so the join moves
    (key, count) pairs, never whole texts."""
    t = texts.select(F.col(key), line_count(F.col("text")).alias("_lines"), F.lit(True).alias("_hit"))
    j = wanted.join(t, key, "left")
    return j.select(
        *wanted.columns,
        F.when(F.col("_hit"), F.col("_lines")).alias("n_lines"),
        F.coalesce(F.col("_hit"), F.lit(False)).alias("found"),
    )
