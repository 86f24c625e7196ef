"""Per-user work as grouped Spark jobs.

``for_each_user`` replaces "one thread per user": one grouped aggregate,
partial on the map side, so a user with a third of all rows is combined
before the shuffle.  ``apply_per_user`` is the pandas path for logic the
built-in aggregates cannot express; it hands each user's rows to one task,
so it is meant for groups of bounded size.  ``combine_users`` is the pandas path
for many users: its functions take frames of many users at once.

``UserTable`` keeps one "database" per user as rows of one versioned folder:
files of each change lie beside each other, and a commit log names them.  A
change writes its own rows once, and the users it replaces or drops once as
tombstones; nothing that is there is read or rewritten, and a change is seen
whole or not at all.  Readers leave out rows whose user has a later tombstone;
``compact`` rewrites the table without them.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.session import path_exists, work_path
from vouch.sources.versions import VersionLog

CREATED, SKIPPED, REPLACED, DROPPED, KEPT = "created", "skipped", "replaced", "dropped", "kept"
BUCKET, _VERSION = "vouch_user_bucket", "vouch_version"
#: Slices that the rows of a user are dealt over when they meet tombstones.
_SLICES = 16


def for_each_user(df: DataFrame, user: str, aggs: list[Column]) -> DataFrame:
    """One row per user (sorted by user) from built-in aggregates."""
    return df.groupBy(user).agg(*aggs).orderBy(user)


def apply_per_user(df: DataFrame, user: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Arbitrary pandas logic per user (Arrow batches, one group per call).
    Each user's rows go to one call: only for groups of bounded size."""
    return df.groupBy(user).applyInPandas(fn, schema=schema)


def combine_per_user(
    df: DataFrame,
    user: str,
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    partial_schema: str,
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    salts: int | None = None,
) -> DataFrame:
    """Pandas logic per user that never holds a whole user in one task.

    Rows are dealt over ``salts`` slices per user, by their position in the
    input, so also identical rows are spread (by default as many slices as the
    session has shuffle partitions, 64 at least); ``partial`` reduces each (user, slice) group to a few rows, and
    ``merge`` combines the at most ``salts`` partial rows of a user.  A
    user with a third of all rows is spread over ``salts`` tasks.
    ``partial`` and ``merge`` must keep the user column.
    """
    salts = salts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("_slice")
    sliced = df.select("*", salt)

    def run_partial(pdf: pd.DataFrame) -> pd.DataFrame:
        return partial(pdf.drop(columns=["_slice"]))

    parts = sliced.groupBy(user, "_slice").applyInPandas(run_partial, schema=partial_schema)
    return parts.groupBy(user).applyInPandas(merge, schema=schema)


def combine_users(
    df: DataFrame,
    user: str,
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    partial_schema: str,
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Pandas logic over frames of many users, for any number of users and rows.

    ``partial`` reduces each Arrow batch as it is read, whosever its rows are,
    and ``merge`` gets frames that hold all partial rows of their users.  So
    there is one call a batch, not one a user; a user with a third of all rows is
    reduced by every task, and only partial rows are shuffled.  Both keep the
    user column; a NULL user is a user.
    """

    def run_partial(frames):
        for frame in frames:
            if len(frame):
                yield partial(frame)

    def run_merge(frames):
        held = None  # the rows of the last user seen, of whom the next frame may have more
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = held[user].iloc[-1] if len(held) else None
            open_rows = held[user].isna() if pd.isna(last) else held[user] == last
            if not open_rows.all():
                yield merge(held[~open_rows])
                held = held[open_rows]
        if held is not None and len(held):
            yield merge(held)

    def combined(rows: DataFrame) -> DataFrame:
        parts = rows.mapInPandas(run_partial, schema=partial_schema)
        return parts.repartition(user).sortWithinPartitions(user).mapInPandas(run_merge, schema=schema)

    # A frame with a NULL user would turn the numbers of the others into doubles.
    known = F.col(f"`{user}`").isNotNull()
    return combined(df.where(known)).unionByName(combined(df.where(~known)))


def user_bucket(user: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")


class UserTable:
    """Rows of many users, created, replaced and dropped user by user.

    A NULL user is a user.  Rows are written in ``buckets`` folders by a hash
    of the user, so a reader of one user (``read_user``) opens one of each
    change; a hot user's bucket is written by several tasks.
    """

    def __init__(self, spark: SparkSession, path: str, user: str, buckets: int = 64) -> None:
        self.spark, self.path, self.user, self.buckets = spark, path.rstrip("/"), user, buckets
        self.log = VersionLog(spark, path)
        self._user_type = "bigint"

    def exists(self) -> bool:
        return bool(self.log.numbers())

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.log.latest()[1]["schema"])

    def read(self) -> DataFrame:
        _number, entry = self.log.latest()
        if not entry:
            raise ValueError(f"{self.path} has no table")
        return self._visible(entry, self._rows(entry, T.StructType.fromJson(entry["schema"])))

    def read_user(self, value) -> DataFrame:
        """The rows of one user, from that user's bucket of each change."""
        _number, entry = self.log.latest()
        schema = T.StructType.fromJson(entry["schema"])
        one = self.spark.createDataFrame([(value,)], T.StructType([schema[self.user]]))
        bucket = one.select(user_bucket(F.col(f"`{self.user}`"), self.buckets)).first()[0]
        rows = self._rows(entry, schema, bucket)
        return self._visible(entry, rows.where(F.col(f"`{self.user}`").eqNullSafe(F.lit(value).cast(schema[self.user].dataType))))

    def _rows(self, entry: dict, schema: T.StructType, bucket: int | None = None) -> DataFrame:
        """All stored rows with the version that wrote them."""
        stored = schema.add(_VERSION, T.LongType())
        folders = [f"{self.path}/{f}" for f in entry["adds"]]
        if bucket is not None:
            folders = [p for p in (f"{f}/{BUCKET}={bucket}" for f in folders) if path_exists(self.spark, p)]
        if not folders:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).option("recursiveFileLookup", "true").parquet(*folders)

    def _visible(self, entry: dict, rows: DataFrame) -> DataFrame:
        """Rows without those whose user was dropped or replaced later.  A user's
        rows are dealt over slices, and its tombstone copied to each, so a hot
        user is no hot key."""
        names = [F.col(f"`{c}`") for c in rows.columns if c != _VERSION]
        if entry["drops"]:
            gone = self._tombstones(entry, rows.schema[self.user]).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(_SLICES - 1))))
            here = F.col(f"`{self.user}`").eqNullSafe(F.col("_gone")) & (F.col("_slice") == F.pmod(F.col("_deal"), F.lit(_SLICES)))
            rows = rows.withColumn("_deal", F.monotonically_increasing_id())
            rows = rows.join(gone, here & (F.col(_VERSION) < F.col("_until")), "left_anti")
        return rows.select(*names)

    def _tombstones(self, entry: dict, field: T.StructField) -> DataFrame:
        """(_gone, _until): the last version that dropped or replaced a user."""
        stored = T.StructType([T.StructField("_gone", field.dataType), T.StructField("_until", T.LongType())])
        rows = self.spark.read.schema(stored).parquet(*[f"{self.path}/{f}" for f in entry["drops"]])
        return rows.groupBy("_gone").agg(F.max("_until").alias("_until"))

    def users(self) -> DataFrame:
        """Existing users (reads only the user column)."""
        if not self.exists():
            return self.spark.createDataFrame([], f"`{self.user}` {self._user_type}")
        return self.read().select(F.col(f"`{self.user}`")).distinct()

    def _accept(self, rows: DataFrame, entry: dict, whole: bool) -> None:
        """Take the user's type from a request; rows to be stored must have
        the columns and types of the table, so that none is lost on reading."""
        self._user_type = rows.schema[self.user].dataType.simpleString()
        if not entry:
            return
        stored = {f.name: f.dataType for f in T.StructType.fromJson(entry["schema"]).fields}
        given = {f.name: f.dataType for f in rows.schema.fields}
        if (whole and stored != given) or stored[self.user] != given[self.user]:
            raise ValueError(f"the table has columns {sorted(stored)}, the request {sorted(given)}, or their types differ")

    def _report(self, requested: DataFrame, found: str, other: str) -> DataFrame:
        """(user, action) of each requested user, kept so that it tells of the
        state the request met."""
        user = F.col(f"`{self.user}`")
        hit = self.users().select(user.alias("_known"), F.lit(True).alias("_hit"))
        action = F.when(F.col("_hit"), F.lit(found)).otherwise(F.lit(other)).alias("action")
        report = requested.join(hit, user.eqNullSafe(F.col("_known")), "left").select(user, action)
        path = work_path(self.spark, "user-report")
        report.write.parquet(path)
        return self.spark.read.schema(report.schema).parquet(path)

    def _write_rows(self, rows: DataFrame, version: int) -> str:
        """One copy of the rows, in a folder no version names yet.  The rows are
        dealt by bucket and position: a hot user is written by as many tasks as
        there are shuffle partitions for each bucket."""
        folder, n = self.log.fresh_data(), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(1, n // self.buckets)
        tagged = rows.withColumn(_VERSION, F.lit(version).cast("bigint")).withColumn(BUCKET, user_bucket(F.col(f"`{self.user}`"), self.buckets))
        dealt = tagged.withColumn("_deal", F.pmod(F.monotonically_increasing_id(), F.lit(parts))).repartition(n, BUCKET, "_deal")
        dealt.drop("_deal").write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return folder

    def _write_drops(self, users: DataFrame, version: int) -> str:
        folder = self.log.fresh_data()
        users.select(F.col(f"`{self.user}`").alias("_gone"), F.lit(version).cast("bigint").alias("_until")).write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, number: int, entry: dict, schema: T.StructType, adds: list[str], drops: list[str]) -> None:
        self.log.commit(number, {"schema": schema.jsonValue(), "adds": entry.get("adds", []) + adds, "drops": entry.get("drops", []) + drops})

    def create(self, rows: DataFrame, drop_existing: bool, post_create: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Materialise each user's rows.  Existing users are skipped, or with
        ``drop_existing`` replaced.  Returns (user, action), fixed before any
        write so it describes the state the request met."""
        number, entry = self.log.latest()
        self._accept(rows, entry, whole=True)
        user = F.col(f"`{self.user}`")
        report = self._report(rows.select(user).distinct(), REPLACED if drop_existing else SKIPPED, CREATED)
        new, drops = rows, []
        if entry and not drop_existing:
            fresh = report.where(F.col("action") == CREATED).select(user.alias("_fresh"))
            new = rows.join(fresh, user.eqNullSafe(F.col("_fresh")), "left_semi")
        elif entry:
            drops = [self._write_drops(report.where(F.col("action") == REPLACED), number + 1)]
        # A tombstone of this version does not hide the rows of this version.
        self._commit(number, entry, rows.schema, [self._write_rows(new, number + 1)], drops)
        if post_create is not None:
            post_create(report.where(F.col("action") != SKIPPED))
        return report

    def drop(self, users: DataFrame) -> DataFrame:
        """Drop the listed users that exist (tombstones only); the rest are
        reported skipped."""
        number, entry = self.log.latest()
        self._accept(users, entry, whole=False)
        report = self._report(users.select(F.col(f"`{self.user}`")).distinct(), DROPPED, SKIPPED)
        if entry:
            gone = self._write_drops(report.where(F.col("action") == DROPPED), number + 1)
            self._commit(number, entry, T.StructType.fromJson(entry["schema"]), [], [gone])
        return report

    def compact(self) -> None:
        """Rewrite the visible rows as one change, without tombstones."""
        number, entry = self.log.latest()
        if entry:
            folder = self._write_rows(self.read(), number + 1)
            self._commit(number, {}, T.StructType.fromJson(entry["schema"]), [folder], [])

    def vacuum(self, keep: int = 1) -> int:
        """Delete the data of all but the last ``keep`` versions, and of lost writers."""
        return self.log.vacuum(keep, lambda e: e["adds"] + e["drops"])
