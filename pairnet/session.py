"""Session helpers: building a local session for tests and bench, and the
shared folder used for checkpoints and staged files.

On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared file
system path every executor can reach). Only when that setting is missing and
the master is local (tests, bench) is a fresh scratch folder created.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Paths handed out inside the innermost ``intermediate_tables`` block.
_made: ContextVar[list[str] | None] = ContextVar("pairnet_made", default=None)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "pairnet", driver_memory: str = "8g") -> SparkSession:
    """A local session with AQE on and the UI off (tests and bench only)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged files.

    Read from the session (``spark.checkpoint.dir`` or an already set
    checkpoint directory). If unset and the master is local, create a scratch
    folder and register it; on a cluster an unset value is an error, because a
    machine-local folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        try:
            conf = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf = None
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        conf = tempfile.mkdtemp(prefix="pairnet-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for files a job writes and reads."""
    base = shared_dir(spark).rstrip("/")
    path = f"{base}/stage-{name}-{uuid.uuid4().hex[:12]}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end of the block, the folders that ``stage_path`` and
    ``checkpoint`` handed out inside it (and nothing else), through the
    session's Hadoop file system. DataFrames built inside must have been
    written elsewhere, or used, before the block ends."""
    token = _made.set([])
    try:
        yield
    finally:
        paths = _made.get() or []
        _made.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def checkpoint(df: DataFrame, name: str = "ckpt") -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and
    read it back. One job computes and writes the rows (an RDD checkpoint
    would compute them twice and store Java-serialised rows); the table
    survives the loss of any executor. Never ``localCheckpoint``."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

