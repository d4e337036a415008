"""Spark session helpers and the shared scratch location.

On a cluster the session is created by the platform; the library only reads
`spark.checkpoint.dir` from it.  Tests and local runs call `local_session`,
which sets a checkpoint folder only when none is configured.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "textloom") -> SparkSession:
    """Session for tests and the bench: local mode, AQE on, UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  Unset, only a plain local session gets one of its own."""
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        try:  # a checkpoint folder set on the context directly
            path = spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
        except Exception:
            path = None
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{CHECKPOINT_KEY} is not set: name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="textloom-ckpt-")  # a plain local session, as in tests: one machine
        spark.conf.set(CHECKPOINT_KEY, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Reliable checkpoint into the shared checkpoint folder: computes `df` once and cuts
    its lineage, so a table used several times in one job (a vocabulary) is not
    recomputed and survives executor loss.  Never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
