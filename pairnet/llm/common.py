"""Shared helpers of the training-data operators: the narrow document view,
sizes that set partition counts, and Arrow batch access."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from pairnet.session import checkpoint, shared_dir
from pairnet.sources.fixtures import table

__all__ = ["documents", "narrow", "quoted", "input_bytes", "parts_for", "text_batches", "release", "small_batches",
           "shared_dir", "table", "shuffle_parts", "held_out", "bounded_sample", "fewest", "nested", "atoms"]


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone: whatever other columns the table has
    (also ones named like an operator's results) never reach the operator."""
    return docs.select(quoted(id_col).cast("long").alias("doc_id"),
                       quoted(text_col).cast("string").alias("text"))


def input_bytes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of the text column (one aggregate job)."""
    r = docs.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.octet_length(quoted(text_col)).cast("long")).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def parts_for(total: int, each: int, least: int = 1) -> int:
    """Partitions so that one holds about ``each`` of ``total``."""
    return max(least, math.ceil(total / each))


#: Bytes of an Arrow batch that the JVM builds for a Python task, at most about.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Python tasks get Arrow batches of about
    ``BATCH_BYTES`` (Spark's default of 10 000 rows is 30 MB of documents, held
    several times by the JVM and by the worker), unless a size was set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, spark.conf.get(key, BATCH_BYTES))


def release() -> None:
    """Gives freed memory back to the system: a worker outlives its task, and
    what it took stays part of the executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def text_batches(batches: Iterable[pa.RecordBatch], max_bytes: int = 4 << 20,
                 max_rows: int = 2000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most about ``max_bytes`` of ``column`` each
    (a longer text makes a slice of its own), so that the Python copies of a
    slice stay small whatever the batch holds. Behind the last one, freed
    memory goes back to the system."""
    for b in batches:
        at = 0
        if b.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        while at < b.num_rows:
            end, size = at, 0
            while end < b.num_rows and end - at < max_rows and (end == at or size + sizes[end] <= max_bytes):
                size += sizes[end]
                end += 1
            yield b.slice(at, end - at)
            at = end
    release()


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is held out of learning: crc32 of its id's digits mod
    ``folds`` is 0 (a null id counts as the empty string and is held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


#: Values with over so many times the wanted rows are thinned before their rows are ranked.
MUCH = 4


def _limit(n: Column, most: int) -> Column:
    """The hash below which about twice ``most`` of ``n`` rows lie."""
    return (F.lit(2.0 * most) / n * F.lit(2.0 ** 64) - F.lit(2.0 ** 63)).cast("long")


def bounded_sample(rows: DataFrame, per: str, most: int) -> DataFrame:
    """At most ``most`` rows of each value of ``per``: the smallest hashes of
    ``doc_id``, written. Of a value with many rows only those below a hash that
    its count sets (about twice ``most`` rows in all, however many tasks) are
    ranked; should fewer than ``most`` lie below one, all rows are. ``rows`` is
    written first, so it should be narrow."""
    rows = checkpoint(rows, "to-sample")
    w = Window.partitionBy(per).orderBy(F.xxhash64("doc_id"), "doc_id")

    def best(of: DataFrame) -> DataFrame:
        return checkpoint(of.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most).drop("_nth"), "sample")

    many = rows.groupBy(per).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MUCH * most)
    many = checkpoint(many.select(F.col(per).alias("_per"), _limit(F.col("_n"), most).alias("_below")), "many")
    below = rows.join(many, F.col(per) == F.col("_per"), "left") \
        .where(F.col("_below").isNull() | (F.xxhash64("doc_id") <= F.col("_below"))).select(*rows.columns)
    out = best(below)
    got = out.groupBy(per).agg(F.count(F.lit(1)).alias("_n"))
    short = many.join(got, F.col(per) == F.col("_per"), "left").where(F.coalesce("_n", F.lit(0)) < most)
    return out if short.isEmpty() else best(rows)


def fewest(rows: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hashes of ``key``, of ``n``: a hash
    that the count sets thins the rows before they are ranked in one task; if
    fewer than ``most`` lie below it, all rows are ranked."""
    h = F.xxhash64(key)
    if n > MUCH * most:
        below = rows.where(h <= _limit(F.lit(float(n)), most))
        if below.select(key).limit(most).count() == most:
            rows = below
    return rows.orderBy(h, key).limit(most)


def nested(docs: DataFrame, **keys: Column) -> DataFrame:
    """``doc``, a struct of all columns, beside ``keys``: no column of the
    table can clash with a key. ``doc.*`` unfolds it again."""
    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("doc"),
                       *[c.alias(k) for k, c in keys.items()])


def atoms(docs: DataFrame) -> list[Column]:
    """The columns of ``doc`` that can be ordered, for a stable choice."""
    return [F.col("doc").getField(f.name) for f in docs.schema if isinstance(f.dataType, AtomicType)]
