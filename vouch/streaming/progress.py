"""Stream readiness: a progress table written by the stream itself.

Each micro-batch, inside ``foreachBatch``, writes its rows to the sink and
one progress row ``(batch_id, rows)`` to a progress table.  Both writes go
to a folder keyed by ``batch_id`` in overwrite mode, so a batch that is
replayed after a failure (``foreachBatch`` is at-least-once) replaces its
own output instead of adding to it.  Row counts come from an
``Observation`` on the write itself - no second pass over the batch.

"Ready" means the progress table holds at least ``min_batches`` batches with
rows, or the query has ended.  Waiting goes on while the stream makes progress.
"""

from __future__ import annotations

import time
from typing import TYPE_CHECKING, Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

if TYPE_CHECKING:
    from vouch.plans.suite import Suite

from vouch.session import path_exists

PROGRESS_SCHEMA = "batch_id bigint, rows bigint"


def stage_files(df: DataFrame, path: str, files: int, order_by: str) -> str:
    """Write a table as ``files`` files in ``order_by`` ranges (a landing
    folder a file stream can consume a few files per trigger).  A hash of the
    row is the last range key, so one frequent value spreads over files."""
    df.repartitionByRange(files, F.col(order_by), F.xxhash64(*df.columns)).sortWithinPartitions(order_by).write.mode("overwrite").parquet(path)
    return path


def batch_writer(sink: str, progress: str, transform: Callable[[DataFrame], DataFrame] | None = None,
                 checks: Callable[[DataFrame], "Suite"] | None = None, checks_path: str | None = None):
    """``foreachBatch`` function: idempotent per ``batch_id``.

    With ``checks`` (a function building a Suite over the batch), the suite's
    results are written for every batch too, under ``checks_path`` keyed by
    ``batch_id`` - checks per micro-batch, replay-safe like the data.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        if checks is not None:
            out = out.persist()  # read once for the sink and the checks
        obs = Observation(f"batch_{batch_id}")
        observed = out.observe(obs, F.count(F.lit(1)).alias("rows"))
        observed.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
        rows = int(obs.get.get("rows", 0))
        spark = batch.sparkSession
        spark.createDataFrame([(int(batch_id), rows)], PROGRESS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
            f"{progress.rstrip('/')}/batch={batch_id}")
        if checks is not None:
            target = checks_path or f"{progress.rstrip('/')}_checks"
            checks(out).results().write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch_id={batch_id}")
            out.unpersist()

    return write


def start_file_stream(
    spark: SparkSession,
    source: str,
    schema: StructType,
    sink: str,
    progress: str,
    checkpoint: str,
    *,
    name: str | None = None,
    max_files_per_trigger: int = 1,
    available_now: bool = True,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    checks: Callable[[DataFrame], "Suite"] | None = None,
) -> StreamingQuery:
    """Parquet folder -> foreachBatch sink with a progress table (and, with
    ``checks``, per-batch suite results).  One checkpoint folder per query."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    writer = reader.parquet(source).writeStream.foreachBatch(batch_writer(sink, progress, transform, checks))
    writer = writer.option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    return writer.start()


def find_query(spark: SparkSession, name: str, timeout: float, delay: float = 0.5) -> StreamingQuery:
    """The active query with this name; waits for it to appear; two with the
    same name is an error."""
    deadline = time.monotonic() + timeout
    while True:
        found = [q for q in spark.streams.active if q.name == name]
        if len(found) > 1:
            raise ValueError(f'More than one streaming query is named "{name}"')
        if found:
            return found[0]
        if time.monotonic() > deadline:
            raise TimeoutError(f'No streaming query named "{name}" became active')
        time.sleep(delay)


def read_progress(spark: SparkSession, progress: str) -> DataFrame:
    if not path_exists(spark, progress):
        return spark.createDataFrame([], PROGRESS_SCHEMA)
    return spark.read.schema(PROGRESS_SCHEMA).parquet(progress).select("batch_id", "rows")


def batches_done(spark: SparkSession, progress: str) -> int:
    """Number of distinct batches that processed rows."""
    return read_progress(spark, progress).where(F.col("rows") > 0).select("batch_id").distinct().count()


def wait_until_ready(
    spark: SparkSession,
    query: StreamingQuery | str,
    progress: str,
    min_batches: int = 2,
    delay: float = 0.5,
    stall: float = 900.0,
) -> int:
    """Block until ``min_batches`` batches with rows are recorded or the
    query is no longer active; returns the batches seen.  Raises only when the
    query makes no progress for ``stall`` seconds, or has failed."""
    if isinstance(query, str):
        query = find_query(spark, query, stall, delay)
    watch = _Progress(query, stall)
    polls = 0
    while True:
        active = query.isActive
        # cheap driver-side hint first (no Spark job); the progress table is
        # read when the hint says ready, the query ended, or every 10th poll
        # (the in-memory progress list is capped, the table is not)
        hinted = sum(1 for p in (query.recentProgress or []) if p.get("numInputRows", 0) > 0)
        if hinted >= min_batches or not active or polls % 10 == 9:
            done = batches_done(spark, progress)
            if done >= min_batches or not active:
                raise_failure(query)
                return done if active else batches_done(spark, progress)
        watch.check()
        polls += 1
        time.sleep(delay)


class _Progress:
    """Raises when a query's last batch has not changed for a while."""

    def __init__(self, query: StreamingQuery, stall: float) -> None:
        self.query, self.stall = query, stall
        self.seen, self.since = None, time.monotonic()

    def check(self) -> None:
        last = self.query.lastProgress
        now = None if last is None else (last["batchId"], last["timestamp"])
        if now != self.seen:
            self.seen, self.since = now, time.monotonic()
        elif time.monotonic() - self.since > self.stall:
            raise TimeoutError(f"stream made no progress in {self.stall}s (last batch: {self.seen})")


def wait_until_ended(query: StreamingQuery, stall: float = 900.0, step: float = 5.0) -> None:
    """Wait until a query that ends by itself has ended, however long that
    takes.  Raises when it failed, or made no progress for ``stall`` seconds;
    never returns while it is still running."""
    watch = _Progress(query, stall)
    while not query.awaitTermination(step):
        watch.check()


def raise_failure(query: StreamingQuery) -> None:
    error = query.exception()
    if error is not None:
        raise error


def stop_queries(queries: list[StreamingQuery], timeout: float = 60.0) -> None:
    """Stop the given queries (only those this engine started).  Errors of the
    stopping itself are ignored, as the query is going away anyway; a failure
    of the stream is raised once all are stopped."""
    failed = [q for q in queries if q.exception() is not None]
    for q in queries:
        try:
            q.stop()
            q.awaitTermination(timeout)
        except Exception:  # noqa: BLE001
            pass
    for q in failed:
        raise_failure(q)


def sink_totals(spark: SparkSession, sink: str, key: str) -> DataFrame:
    """(total_rows, distinct_keys) of everything the stream delivered."""
    data = spark.read.parquet(sink)
    return data.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct(key).alias("distinct_keys"))
