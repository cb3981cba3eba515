"""Inputs of the registered queries: the adapter tables over a test-data
folder, and the same tables staged as the text files the evidence readers
expect (written in parallel to the shared folder, then read back)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairnet.functions import names as N
from pairnet.session import stage_path
from pairnet.sources import fixtures as fx
from pairnet.sources import readers as R
from pairnet.sources.sinks import write_delimited, write_parquet

#: Organism code carried by the adapter's evidence ids (``9.Q<key>``).
ORGANISM = 9


@dataclass
class Inputs:
    spark: SparkSession
    sf_dir: str

    def pairs(self) -> DataFrame:
        return fx.pairs(self.spark, self.sf_dir)

    def pairs_raw(self) -> DataFrame:
        return fx.pairs_raw(self.spark, self.sf_dir)

    def conf(self) -> DataFrame:
        return fx.confidences(self.spark, self.sf_dir)

    def links(self) -> DataFrame:
        return fx.links(self.spark, self.sf_dir)

    def aliases(self) -> DataFrame:
        return fx.aliases(self.spark, self.sf_dir)

    def info(self) -> DataFrame:
        return fx.info(self.spark, self.sf_dir)


def stage_parquet_inputs(inp: Inputs) -> str:
    """Pairs (before the NULL-id filter) and confidences as the two Parquet
    files of the source data layout; returns their folder."""
    d = stage_path(inp.spark, "parquet")
    write_parquet(inp.pairs_raw(), f"{d}/summary_pairs.parquet")
    write_parquet(inp.conf(), f"{d}/summary_confidences.parquet")
    return d


EVIDENCE = (N.LINKS_DATA_ID, N.ALIASES_DATA_ID, N.INFO_DATA_ID)


def stage_text_inputs(inp: Inputs, gzip_links: bool = False,
                      alias_header: str = "#string_protein_id",
                      info_header: str = "string_protein_id", only=EVIDENCE) -> str:
    """Links (space-separated), aliases and info (tab-separated, with the two
    header variants) under the evidence file names, those of ``only``;
    returns their folder."""
    d = stage_path(inp.spark, "text")

    def path(data_id: str) -> str:
        return f"{d}/{R.evidence_file_name(data_id, ORGANISM)}"

    if N.LINKS_DATA_ID in only:
        write_delimited(inp.links(), path(N.LINKS_DATA_ID) + (".gz" if gzip_links else ""), sep=" ",
                        compression="gzip" if gzip_links else None)
    if N.ALIASES_DATA_ID in only:
        write_delimited(inp.aliases().withColumnRenamed(N.STRING_ID, alias_header),
                        path(N.ALIASES_DATA_ID), sep="\t", quote="")
    if N.INFO_DATA_ID in only:
        write_delimited(inp.info().withColumnRenamed(N.STRING_ID, info_header),
                        path(N.INFO_DATA_ID), sep="\t", quote="")
    return d


def stage_odd_links(inp: Inputs) -> str:
    """The links file with lines that aren't rows among them: some without a
    score, some with a field too many, some with letters in the score."""
    part, score = F.col(N.COMBINED_SCORE) % 50, F.col(N.COMBINED_SCORE).cast("string")
    end = F.when(part == 0, "").when(part == 1, F.concat(F.lit(" "), score, F.lit(" extra"))) \
        .when(part == 2, F.concat(F.lit(" x"), score)).otherwise(F.concat(F.lit(" "), score))
    path = f"{stage_path(inp.spark, 'odd')}/{R.evidence_file_name(N.LINKS_DATA_ID, ORGANISM)}"
    lines = inp.links().select(F.concat(N.PROTEIN1, F.lit(" "), N.PROTEIN2, end)
                               .alias(f"{N.PROTEIN1} {N.PROTEIN2} {N.COMBINED_SCORE}"))
    return write_delimited(lines, path, sep="\t", quote="")


def stage_one_gz(inp: Inputs) -> str:
    """The links as one single ``.gz`` file, as they are published."""
    d = stage_path(inp.spark, "gz")
    write_delimited(inp.links().coalesce(1), d, sep=" ", compression="gzip")
    p = inp.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(d)
    files = p.getFileSystem(inp.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return next(str(f.getPath()) for f in files if f.getPath().getName().endswith(".gz"))
