"""A sink that commits every micro-batch once, rows and progress together.

A batch writes its rows to a folder of its own attempt and then one commit
file, named by the batch, which says where they are and how many.  The commit
is renamed into place and fails if the batch has one, so

- a writer that is lost before its commit leaves rows that nobody reads;
- a batch that is replayed after its commit writes nothing;
- there is no moment in which the rows are there and the progress is not.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.sources.versions import delete, list_names, rename_new, write_text

COMMIT_SCHEMA = "batch_id bigint, rows bigint, folder string"


class CommittedSink:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def writer(self, transform: Callable[[DataFrame], DataFrame] | None = None,
               watch: Callable[[str, int], None] | None = None) -> Callable[[DataFrame, int], None]:
        """The ``foreachBatch`` function.  ``watch(step, batch_id)`` is called
        after the steps "written" and "committed"; what it raises ends the
        query there, as the loss of the driver would."""

        def write(batch: DataFrame, batch_id: int) -> None:
            name = f"{int(batch_id):012d}.json"
            if name in list_names(self.spark, f"{self.path}/commits"):
                return
            out = transform(batch) if transform else batch
            seen, folder = Observation(), f"rows/batch={int(batch_id)}-{uuid.uuid4().hex}"
            out.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/{folder}")
            if watch:
                watch("written", int(batch_id))
            aside = f"{self.path}/commits/.{uuid.uuid4().hex}"
            write_text(self.spark, aside, json.dumps({"batch_id": int(batch_id), "rows": int(seen.get["rows"]), "folder": folder}))
            if not rename_new(self.spark, aside, f"{self.path}/commits/{name}"):
                delete(self.spark, aside)  # another attempt was first
            if watch:
                watch("committed", int(batch_id))

        return write

    def commits(self) -> DataFrame:
        """(batch_id, rows, folder) of the committed batches."""
        if not list_names(self.spark, f"{self.path}/commits"):
            return self.spark.createDataFrame([], COMMIT_SCHEMA)
        return self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.path}/commits")

    def read(self) -> DataFrame:
        """The rows of the committed batches (a folder name a batch is collected)."""
        folders = [f"{self.path}/{r['folder']}" for r in self.commits().select("folder").collect()]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def attempts(self) -> DataFrame:
        """(batch_id, attempts): how often each batch has begun to write."""
        names = [n for n in list_names(self.spark, f"{self.path}/rows") if n.startswith("batch=")]
        rows = self.spark.createDataFrame([(int(n[len("batch="):].split("-")[0]),) for n in names], "batch_id bigint")
        return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("attempts"))


def start_committed_stream(spark: SparkSession, source: str, schema: T.StructType, sink: CommittedSink, checkpoint: str, *,
                           max_files_per_trigger: int = 1, transform: Callable[[DataFrame], DataFrame] | None = None,
                           watch: Callable[[str, int], None] | None = None):
    """Parquet folder -> committed sink, until all that is there is read."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
    writer = rows.writeStream.foreachBatch(sink.writer(transform, watch)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
