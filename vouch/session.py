"""Session helpers: building a session for tests/bench and finding shared storage.

Everything that writes (dataset copies, repaired tables, progress tables,
stream checkpoints, lineage cuts) goes under the folder named by the
session's ``spark.checkpoint.dir``.  On a cluster that folder is shared
storage every executor can reach; a machine-local temporary folder is only
ever used for a local master where the setting is missing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "vouch") -> SparkSession:
    """Local session used by tests and the benchmark.

    AQE stays on so small build sides are broadcast only after their real
    size is measured, skewed join partitions are split, and tiny shuffle
    partitions are coalesced.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only where it is unset.

    The cluster's own ``spark.checkpoint.dir`` always wins.  A fresh local
    folder is created only for a local master (tests); on a cluster a missing
    setting is an error, because a machine-local folder would not survive the
    loss of the executor that wrote it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="vouch-ckpt-"))
    return sc.getCheckpointDir()


def work_path(spark: SparkSession, *parts: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one run."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "vouch", *parts, uuid.uuid4().hex])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop filesystem of the session."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))
