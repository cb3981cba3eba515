"""One-time landing of text sources as Parquet in the shared folder.

A gzipped file can't be split: whoever reads it parses all of it in one task.
``landed`` parses a source once and keeps the rows as Parquet under a key made
of the source's path, length and modification time (and what was read from
it); later jobs, also of other sessions with the same shared folder, read the
Parquet. The folder is written under a name of its own and published by a
rename that fails if another job was first, so a reader never sees half of it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from pairnet.session import shared_dir


def _files(spark: SparkSession, path: str) -> list[str]:
    """Path, length and time of every data file of a source (a file, or a
    folder of part files)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [fs.getFileStatus(p)]
    if found[0].isDirectory():
        found = [s for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "_."]
    return sorted(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}" for s in found)


def landing_path(spark: SparkSession, path: str, form: str) -> str:
    """Where a source lands; another path once the source changes."""
    key = hashlib.sha256("\n".join([form, *_files(spark, path)]).encode()).hexdigest()[:32]
    return f"{shared_dir(spark).rstrip('/')}/landed/{key}"


def published(spark: SparkSession, own: str, target: str) -> bool:
    """Renames a finished folder to ``target``, unless that is there already:
    then the folder goes. Whether it was this one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(own), jvm.org.apache.hadoop.fs.Path(target)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), conf) \
            .rename(src, dst, spark.sparkContext._gateway.new_array(rename, 0))
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        src.getFileSystem(conf).delete(src, True)
        return False


def landed(spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame], form: str) -> DataFrame:
    """The rows that ``read`` gives for ``path``, from their Parquet copy;
    the first call makes it. ``form`` names what is read (sources read in two
    ways land twice)."""
    target = landing_path(spark, path, form)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        own = f"{target}.{uuid.uuid4().hex}.part"
        read(spark, path).write.parquet(own)
        published(spark, own, target)
    return spark.read.parquet(target)
