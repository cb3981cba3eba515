"""Scans: the Parquet pair and confidence tables and the delimited evidence
files (links, aliases, info), plain or gzipped.

Text files are read with every column as a string (no schema-inference pass
over the data) and the numeric columns are cast afterwards. By default with
``try_cast``: a malformed value gives NULL, and ``rejected_values`` counts such
values. ``strict=True`` fails the job instead, also for a row with a wrong
number of fields. ``checked_links`` keeps both apart: rows, and a quarantine of
the lines that aren't rows, with the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pairnet.functions import names as N
from pairnet.functions.expr import all_not_null, strip_prefix
from pairnet.session import checkpoint
from pairnet.sources.landing import landed


def read_pairs(spark: SparkSession, path: str, drop_null_ids: bool = True) -> DataFrame:
    """Pair table; rows with a NULL id are dropped (the filter reaches the scan)."""
    df = spark.read.parquet(_parquet_path(path, "summary_pairs.parquet"))
    if drop_null_ids:
        df = df.where(all_not_null([N.ID1, N.ID2]))
    return df


def read_confidences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_parquet_path(path, "summary_confidences.parquet"))


def _parquet_path(path: str, default_name: str) -> str:
    if path.endswith(".parquet"):
        return path
    return f"{path.rstrip('/')}/{default_name}"


def read_delimited(spark: SparkSession, path: str, sep: str, quote: str | None = None,
                   strict: bool = False) -> DataFrame:
    """Delimited text with a header row; every column read as a string.

    ``quote=''`` turns quoting off: tab files carry free text in which a lone
    double quote would otherwise swallow the next separator.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if quote is not None:
        reader = reader.option("quote", quote)
    return reader.csv(path)


def cast_longs(df: DataFrame, cols, strict: bool = False) -> DataFrame:
    """Whole numbers; with ``strict`` a malformed one fails the job (ANSI cast)."""
    return df.withColumns({c: F.col(f"`{c}`").cast("bigint") if strict else F.col(f"`{c}`").try_cast("bigint")
                           for c in cols})


def rejected_values(df: DataFrame, cols) -> DataFrame:
    """One row per column of an uncast table: ``column``, ``rejected`` (values
    that are there but aren't whole numbers). One aggregate over the rows."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("bigint").isNull()).alias(c)
                   for c in cols])
    return one.unpivot([], [F.col(f"`{c}`") for c in cols], "column", "rejected")


def _spread(df: DataFrame, partitions: int | None) -> DataFrame:
    return df.repartition(partitions) if partitions else df


def score_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (N.PROTEIN1, N.PROTEIN2)]


#: Columns that ``checked_links`` adds, and its reasons.
RAW_LINE, REASON = "raw_line", "reject_reason"
WRONG_FIELDS, WRONG_VALUE = "fields", "value"


def checked_links(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A links file with every line accounted for: its columns (scores as
    whole numbers), ``reject_reason`` and ``raw_line``.

    ``fields``: the line has more or fewer fields than the header.
    ``value``: a score is there but is no whole number. A rejected line's
    ``raw_line`` holds its text, a kept one has neither. The table is parsed
    once and written; ``kept_links``, ``quarantine`` and ``reject_counts``
    read the written copy."""
    columns = read_delimited(spark, path, " ", quote="").columns
    schema = StructType([StructField(c, StringType()) for c in [*columns, RAW_LINE]])
    raw = (
        spark.read.schema(schema).option("header", True).option("sep", " ").option("quote", "")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW_LINE)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    scores = score_columns(raw.drop(RAW_LINE))
    odd = F.lit(False)
    for c in scores:
        odd = odd | (F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("bigint").isNull())
    line = F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns])
    parsed = _spread(raw, partitions).withColumn(
        REASON, F.when(F.col(RAW_LINE).isNotNull(), WRONG_FIELDS).when(odd, WRONG_VALUE)) \
        .withColumn(RAW_LINE, F.coalesce(RAW_LINE, F.when(F.col(REASON).isNotNull(), line)))
    return checkpoint(cast_longs(parsed, scores), "checked-links")


def kept_links(checked: DataFrame) -> DataFrame:
    return checked.where(F.col(REASON).isNull()).drop(RAW_LINE, REASON)


def quarantine(checked: DataFrame) -> DataFrame:
    """The rejected lines: ``reject_reason``, ``raw_line``."""
    return checked.where(F.col(REASON).isNotNull()).select(REASON, RAW_LINE)


def reject_counts(checked: DataFrame) -> DataFrame:
    """``reason`` (``kept`` or why not), ``lines``."""
    return checked.groupBy(F.coalesce(REASON, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("lines"))


def read_links_landed(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_links``, but parsed once for all jobs and kept as Parquet:
    the way to read a ``.gz``."""
    return landed(spark, path, read_links, "links")


def read_links(spark: SparkSession, path: str, partitions: int | None = None, strict: bool = False) -> DataFrame:
    """Space-separated links file: ``protein1 protein2 <scores..> combined_score``.

    A gzipped file is read by one task (gzip cannot be split);
    ``partitions`` spreads the rows right after the scan so that the work
    downstream runs in parallel (better still: ``read_links_landed``)."""
    df = _spread(read_delimited(spark, path, " ", quote="", strict=strict), partitions)
    return cast_longs(df, score_columns(df), strict)


def rename_string_id(df: DataFrame) -> DataFrame:
    """``string_protein_id`` if present, else ``#string_protein_id``, becomes ``string_id``."""
    for header in N.STRING_ID_HEADERS:
        if header in df.columns:
            return df.withColumnRenamed(header, N.STRING_ID)
    return df


def read_aliases(spark: SparkSession, path: str, partitions: int | None = None, strict: bool = False) -> DataFrame:
    """Tab-separated alias file -> ``string_id, alias, source``."""
    return _spread(rename_string_id(read_delimited(spark, path, "\t", quote="", strict=strict)), partitions)


def read_info(spark: SparkSession, path: str, partitions: int | None = None, strict: bool = False) -> DataFrame:
    """Tab-separated info file -> ``string_id, preferred_name, annotation, ..``."""
    df = _spread(rename_string_id(read_delimited(spark, path, "\t", quote="", strict=strict)), partitions)
    return cast_longs(df, [c for c in df.columns if c == "protein_size"], strict)


def evidence_file_name(data_id: str, organism: int | str = N.DEFAULT_ORGANISM,
                       version: str = N.DEFAULT_VERSION) -> str:
    return f"{organism}.{data_id}.{version}.txt"


def read_evidence(spark: SparkSession, directory: str, data_id: str = N.LINKS_DATA_ID,
                  organism: int | str = N.DEFAULT_ORGANISM, version: str = N.DEFAULT_VERSION,
                  clean=None, partitions: int | None = None, strict: bool = False) -> DataFrame:
    """Evidence table by data id: the file name is built from organism, data id
    and version; ``.txt.gz`` is used when only the gzipped copy exists.

    Aliases and info are tab-separated, everything else space-separated.
    ``clean`` lists columns from which the ``<organism>.`` prefix is removed;
    ``partitions`` spreads the rows of a file that one task must read (``.gz``).
    """
    name = evidence_file_name(data_id, organism, version)
    path = f"{directory.rstrip('/')}/{name}"
    if not path_exists(spark, path) and path_exists(spark, path + ".gz"):
        path = path + ".gz"
    if data_id == N.ALIASES_DATA_ID:
        df = read_aliases(spark, path, partitions, strict)
    elif data_id == N.INFO_DATA_ID:
        df = read_info(spark, path, partitions, strict)
    elif data_id in N.TAB_SEPARATED:
        df = _spread(read_delimited(spark, path, "\t", quote="", strict=strict), partitions)
    else:
        df = read_links(spark, path, partitions, strict)
    if clean:
        df = df.withColumns({c: strip_prefix(F.col(f"`{c}`"), organism) for c in clean})
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the session's Hadoop file system (local
    disk, HDFS or an object store alike)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
