"""Line de-duplication with levelled sorted runs of line hashes.

A run is a table (h1, h2, n) in buckets by the 128-bit line hash, each bucket
sorted by it: in how many documents of some batches a line occurs.  A new batch
counts its own lines, anti-joins those that are already known to be common, and
adds the rest as a run of level 0.  When a level holds ``fan_in`` runs they are
merged bucket by bucket, without an exchange, into one run of the next level, so
n batches leave about fan_in * log(n) runs and every count is rewritten log(n)
times.  What reaches ``min_docs`` in a run is noted as common; merges leave it
out, so common lines are counted no more.

Batches are groups of files of a bounded size (``file_batches``).

A line's key is the line without white space at both ends, A-Z lower-cased.
Built-in functions only.

Defined results: a null or empty text is one empty line, which is never
dropped; a line that occurs twice in a document counts it once and loses both
lines; every row counts as a document, also repeated rows; a text that loses
all its lines becomes empty; no documents give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import join_on, let, text_key, text_or_empty, written
from vouch.session import work_path
from vouch.sources.tables import path_bytes

_SCHEMA = "h1 bigint, h2 bigint, n bigint"
# White space stripped from both ends of a line.
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def folded(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the fast way."""
    ascii_only = F.char_length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def line_keys(text: Column) -> Column:
    return F.transform(F.split(folded(text), "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)))


def batch_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, n): in how many rows of ``docs`` each line key occurs."""
    keys = docs.select(F.explode(F.array_distinct(line_keys(text_or_empty()))).alias("_key"))
    h1, h2 = text_key(F.col("_key"))
    keys = keys.filter(F.char_length("_key") >= min_chars).select(h1.alias("h1"), h2.alias("h2"))
    return keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))


class LineRuns:
    """Bucketed, sorted runs in a shared folder, a list of runs per level.

    ``buckets`` (the session's shuffle partitions, unless given) is the same
    for all runs, so runs join and merge where they lie.  The runs are tables
    of the session's catalog, for only these keep their buckets; ``close``
    takes them from the catalog (their files stay).
    """

    def __init__(self, spark: SparkSession, min_docs: int, min_chars: int = 1, fan_in: int = 4, path: str | None = None, buckets: int | None = None) -> None:
        if fan_in < 2:
            raise ValueError("fan_in must be 2 at least")
        self.spark, self.min_docs, self.min_chars, self.fan_in = spark, min_docs, min_chars, fan_in
        self.path = path or work_path(spark, "llm", "line-runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._name, self._made, self._known = f"line_run_{uuid.uuid4().hex}", 0, False

    def _write(self, run: DataFrame) -> str:
        """Store a run (partitioned by its hashes already) and note its common lines."""
        self._made += 1
        name = f"{self._name}_{self._made}"
        run.write.option("compression", "zstd").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/run-{self._made}").saveAsTable(name)
        common = self.spark.table(name).filter(F.col("n") >= self.min_docs).select("h1", "h2")
        common.coalesce(8).write.mode("append").option("compression", "zstd").parquet(f"{self.path}/common")
        self._known = True
        return name

    def known(self) -> DataFrame:
        """(h1, h2) of the lines that one run alone has shown to be common."""
        if not self._known:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        return self.spark.read.schema("h1 bigint, h2 bigint").parquet(f"{self.path}/common")

    def _sums(self, names: list[str]) -> DataFrame:
        """Counts over runs of the lines that none of them shows to be common:
        buckets are summed where they lie."""
        if not names:
            return self.spark.createDataFrame([], _SCHEMA)
        open_rows = [self.spark.table(n).filter(F.col("n") < self.min_docs) for n in names]
        rows = open_rows[0]
        for more in open_rows[1:]:
            rows = rows.unionAll(more)
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def common(self) -> DataFrame:
        """(h1, h2) of the lines found in at least ``min_docs`` documents so far."""
        late = self._sums(self.runs()).filter(F.col("n") >= self.min_docs).select("h1", "h2")
        return late.unionAll(self.known())

    def add(self, batch: DataFrame) -> None:
        counts = batch_counts(batch, self.min_chars)
        if self._known:
            counts = counts.join(self.known(), ["h1", "h2"], "left_anti")
        self._add_run(0, self._write(counts))

    def _add_run(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan_in:
            merged = self._write(self._sums(self.levels[level]))
            self.levels[level] = []
            self._add_run(level + 1, merged)

    def close(self) -> None:
        for i in range(1, self._made + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name}_{i}")


def clean_lines(docs: DataFrame, common: DataFrame, min_chars: int = 1) -> DataFrame:
    """``docs`` (doc_id, text) without the lines of ``common`` (h1, h2):
    doc_id, text (the whole kept text), n_lines, n_dropped."""
    k1, k2 = text_key(F.col("text"))
    whole = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", "text", k1.alias("_t1"), k2.alias("_t2"))
    key = ["doc_id", "_t1", "_t2"]
    lines = whole.select(*key, F.posexplode(line_keys(F.col("text"))).alias("_pos", "_key"))
    h1, h2 = text_key(F.col("_key"))
    lines = lines.filter(F.char_length("_key") >= min_chars).select(*key, "_pos", h1.alias("h1"), h2.alias("h2"))
    hits = lines.join(common, ["h1", "h2"], "left_semi").groupBy(*key).agg(F.collect_set("_pos").alias("_drop"))
    joined = join_on(whole, hits, key, "left")
    parts = let(F.split("text", "\n"), lambda ls: F.struct(
        F.size(ls).cast("bigint").alias("n_lines"),
        F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_drop")), lambda i: ls[i]), "\n")).alias("text")))
    out = joined.select("doc_id", parts.alias("_p"), F.coalesce(F.size("_drop"), F.lit(0)).cast("bigint").alias("n_dropped"))
    return out.select("doc_id", "_p.text", "_p.n_lines", F.when(F.col("n_dropped") < 0, 0).otherwise(F.col("n_dropped")).alias("n_dropped"))


def drop_common_lines(batches: Iterable[DataFrame], docs: DataFrame, min_docs: int = 10, min_chars: int = 1, fan_in: int = 4,
                      buckets: int | None = None) -> DataFrame:
    """Feed ``batches`` (each row once) to the runs, then clean ``docs``."""
    runs = LineRuns(docs.sparkSession, min_docs, min_chars, fan_in, buckets=buckets)
    for batch in batches:
        runs.add(batch)
    common = written(runs.common(), "line-runs-common")
    runs.close()
    return clean_lines(docs, common, min_chars)


#: A batch holds files of about so many bytes, and a table makes so many batches at least.
BATCH_BYTES, LEAST_BATCHES = 64 << 30, 8


def file_batches(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES, least: int = LEAST_BATCHES) -> list[DataFrame]:
    """A table in batches of whole files, in the order of their names: as many as
    it has times ``batch_bytes``, ``least`` at the least.  A table of fewer files
    than batches, which is small, is dealt by a hash of the row instead."""
    table = spark.read.parquet(path)
    files = sorted(table.inputFiles())
    if not files:
        return []
    n = max(least, -(-path_bytes(spark, path) // batch_bytes))
    if len(files) < n:
        deal = F.pmod(F.xxhash64("doc_id", text_or_empty()), F.lit(n))
        return [table.filter(deal == i) for i in range(n)]
    return [spark.read.parquet(*files[len(files) * i // n:len(files) * (i + 1) // n]) for i in range(n)]
