"""Sinks: delimited text (header or not, any separator), Parquet, edge lists.

A sink writes a directory of part files, one per partition, in parallel; no
data passes through the driver. Text is written without trimming. An empty string
is written as ``""`` and NULL as nothing; a reader whose ``nullValue`` isn't the
empty string gets both back as they were. Without quoting (``quote=''``) a text file cannot tell them apart.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True,
                    mode: str = "overwrite", compression: str | None = None,
                    quote: str | None = None) -> str:
    """``quote=''`` writes fields verbatim (for tab files read without quoting)."""
    w = (
        df.write.mode(mode)
        .option("sep", sep)
        .option("header", header)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if quote == "":
        w = w.option("emptyValue", "")
    if compression:
        w = w.option("compression", compression)
    if quote is not None:
        w = w.option("quote", quote)
    w.csv(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Comma-separated with a header (the comparison table, network tables)."""
    return write_delimited(df, path, ",", True, mode)


def write_edges(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header-less comma-separated edge list ``protein1,protein2,weight,direction``."""
    return write_delimited(df, path, ",", False, mode)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


#: A verified table's manifest; readers of the table skip names that begin so.
MANIFEST = "_MANIFEST.json"


def _measures(df: DataFrame) -> list[Column]:
    """Rows, NULLs by column, and a checksum that doesn't depend on the order
    of the rows (but on how often each occurs)."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = [F.count_if(c.isNull()).alias(f"nulls_{i}") for i, c in enumerate(columns)]
    return [F.count(F.lit(1)).alias("rows"), *nulls,
            F.sum(F.xxhash64(*columns).cast("decimal(28,0)")).cast("string").alias("checksum")]


def _manifest(columns: list[str], row: dict) -> dict:
    return {"rows": row["rows"], "nulls": {c: row[f"nulls_{i}"] for i, c in enumerate(columns)}, "checksum": row["checksum"]}


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_verified(df: DataFrame, path: str, write: Callable[..., str] = write_parquet, **options) -> dict:
    """Writes by one of the sinks above and, last of all, a manifest: rows,
    NULLs by column and checksum, observed while the rows were written (no
    second pass). A write that breaks off leaves no manifest, also not an
    earlier one's."""
    spark = df.sparkSession
    p, fs = _file_system(spark, f"{path}/{MANIFEST}")
    fs.delete(p, False)
    seen = Observation(f"sink-{uuid.uuid4().hex[:8]}")
    write(df.observe(seen, *_measures(df)), path, **options)
    manifest = _manifest(df.columns, seen.get)
    own, _ = _file_system(spark, f"{path}/_{uuid.uuid4().hex}.json")
    out = fs.create(own, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    fs.rename(own, p)
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a complete write, or nothing."""
    p, fs = _file_system(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def complete(spark: SparkSession, path: str) -> str:
    """``path``, if its table was written to the end; else an error."""
    if read_manifest(spark, path) is None:
        raise FileNotFoundError(f"no manifest: {path} was not written to the end")
    return path


def differences(df: DataFrame, manifest: dict) -> dict:
    """What a read-back table has otherwise than its manifest says, by one
    aggregate: measure -> (found, said)."""
    found = _manifest(df.columns, df.agg(*_measures(df)).first().asDict())
    return {k: (found[k], manifest[k]) for k in manifest if found[k] != manifest[k]}
