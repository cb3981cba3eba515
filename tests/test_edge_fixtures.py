"""Hand-made edge fixtures (FIXTURES.md section D)."""

import gzip
import math
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pairnet.functions import names as N
from pairnet.functions.expr import norm_id, strip_prefix
from pairnet.operators import pairs as P
from pairnet.operators import profile as PR
from pairnet.operators import stats as S
from pairnet.session import stage_path
from pairnet.sources import readers as R

PAIR_SCHEMA = StructType([
    StructField(N.NAME, StringType()), StructField(N.ID1, StringType()), StructField(N.ID2, StringType()),
    StructField(N.BEST, DoubleType()), StructField(N.MEAN, DoubleType()),
])


def _local_dir(spark, name):
    p = stage_path(spark, name)
    p = p[len("file:"):] if p.startswith("file:") else p
    os.makedirs(p)
    return p


def test_nan_null_threshold(spark):
    df = spark.createDataFrame([("r1", "a", "b", float("nan"), 1.0), ("r2", "a", "c", None, 1.0),
                                ("r3", "a", "d", 0.6, 1.0)], PAIR_SCHEMA)
    kept = P.drop_nulls(df, [N.BEST])
    assert kept.count() == 2  # NaN survives null dropping
    conf = P.filter_confident(df).select(N.NAME).collect()
    assert sorted(r[0] for r in conf) == ["r1", "r3"]  # NaN >= 0.6; NULL is not


def test_ordered_and_undirected_dedupe(spark):
    df = spark.createDataFrame([("r1", "a", "b", 0.7, 0.1), ("r2", "b", "a", 0.9, 0.1),
                                ("r3", "a", "a", 0.8, 0.1)], PAIR_SCHEMA)
    assert P.dedupe_runs(df).count() == 3
    und = P.dedupe_runs(df, undirected=True)
    assert und.count() == 2
    ab = und.where(F.col(N.ID1) != F.col(N.ID2)).first()
    assert ab[N.BEST] == 0.9


def test_link_conflict_keeps_largest(spark):
    links = spark.createDataFrame([("x", "y", 400), ("y", "x", 400), ("x", "y", 700)],
                                  [N.PROTEIN1, N.PROTEIN2, N.COMBINED_SCORE])
    rows = P.link_scores(links).collect()
    assert len(rows) == 1 and rows[0][N.COMBINED_SCORE] == 700


def test_strip_all_white_space(spark):
    df = spark.createDataFrame([("\tQ1\r",), (" Q2 ",), (" q3\n",)], ["alias"])
    got = [r[0] for r in df.select(norm_id("alias")).collect()]
    assert got == ["q1", "q2", "q3"]


def test_tab_file_with_lone_quote_and_header_variants(spark):
    d = _local_dir(spark, "tab")
    with open(f"{d}/aliases.txt", "w") as f:
        f.write("#string_protein_id\talias\tsource\n")
        f.write('4932.A\tq"x\tKEGG\n')
        f.write('4932.B\t"lone\tUniProt_AC\n')
    with open(f"{d}/info.txt", "w") as f:
        f.write("string_protein_id\tpreferred_name\tannotation\n")
        f.write('4932.A\tAAA\tsays "hi\n')
    al = R.read_aliases(spark, f"{d}/aliases.txt").orderBy(N.STRING_ID).collect()
    assert [tuple(r) for r in al] == [("4932.A", 'q"x', "KEGG"), ("4932.B", '"lone', "UniProt_AC")]
    info = R.read_info(spark, f"{d}/info.txt").collect()
    assert info[0][N.STRING_ID] == "4932.A" and info[0][N.ANNOTATION] == 'says "hi'


def test_prefix_stripped_once_at_start(spark):
    df = spark.createDataFrame([("4932.X4932.Y",), ("X4932.Y",)], ["id"])
    got = [r[0] for r in df.select(strip_prefix("id", 4932)).collect()]
    assert got == ["X4932.Y", "X4932.Y"]


def test_degenerate_statistics(spark):
    one = spark.createDataFrame([("r", "a", "a", 0.7, 0.7)], PAIR_SCHEMA)
    st = S.protein_stats(one)
    ms = S.protein_mean_std(st).first()
    assert ms[1] is None  # one protein: sample std is NULL
    assert S.bias_table(st).first()[N.STD_UNITS] is None
    zeros = spark.createDataFrame([("r1", "a", "b", 0.0, 0.0), ("r2", "a", "c", 0.0, 0.0)], PAIR_SCHEMA)
    scaled = S.scale(zeros, N.BEST).collect()
    assert all(r[N.BEST] is None for r in scaled)  # division by a zero max
    z = S.zscore(zeros, N.BEST).collect()
    assert all(r["z_score"] is None for r in z)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,)], ["x"])
    h = {r["bin"]: r["count"] for r in PR.histogram(df, "x", 2).collect()}
    assert h == {0: 1, 1: 3}  # the last bin is closed; 0.5 opens bin 1
    same = spark.createDataFrame([(2.0,), (2.0,)], ["x"])
    rows = PR.histogram(same, "x", 4).orderBy("bin").collect()
    assert rows[0]["bin_start"] == 1.5 and rows[-1]["bin_end"] == 2.5
    assert sum(r["count"] for r in rows) == 2


def test_empty_pairs(spark):
    empty = spark.createDataFrame([], PAIR_SCHEMA)
    assert P.confident_pairs(empty.withColumn(N.MEAN, F.col(N.MEAN)),
                             spark.createDataFrame([], "name string, ptm double, iptm double")).count() == 0
    ms = S.protein_mean_std(S.protein_stats(empty)).first()
    assert ms[0] is None and ms[1] is None
    h = PR.histogram(empty, N.BEST, 3).collect()
    assert len(h) == 3 and all(r["count"] == 0 for r in h)
    assert S.score_range(empty, N.BEST).first()[0] is None


def test_gzip_links(spark):
    d = _local_dir(spark, "gz")
    with gzip.open(f"{d}/links.txt.gz", "wt") as f:
        f.write("protein1 protein2 combined_score\n4932.A 4932.B 500\n4932.B 4932.C 150\n")
    df = R.read_links(spark, f"{d}/links.txt.gz")
    assert df.schema[N.COMBINED_SCORE].dataType.simpleString() == "bigint"
    assert sorted(r[N.COMBINED_SCORE] for r in df.collect()) == [150, 500]


BAD_LINKS = "protein1 protein2 combined_score\n4932.A 4932.B 500\n4932.B 4932.C x1\n4932.C 4932.D\n"


def test_malformed_scores_are_null_and_counted(spark):
    d = _local_dir(spark, "bad")
    with open(f"{d}/links.txt", "w") as f:
        f.write(BAD_LINKS)
    assert sorted((r[N.COMBINED_SCORE] for r in R.read_links(spark, f"{d}/links.txt").collect()),
                  key=lambda x: x or 0) == [None, None, 500]
    raw = R.read_delimited(spark, f"{d}/links.txt", " ", quote="")
    assert [tuple(r) for r in R.rejected_values(raw, R.score_columns(raw)).collect()] == [(N.COMBINED_SCORE, 1)]


@pytest.mark.parametrize("row", ["4932.B 4932.C x1", "4932.C 4932.D"])
def test_strict_links_fail_on_a_malformed_row(spark, row):
    d = _local_dir(spark, "strict")
    with open(f"{d}/links.txt", "w") as f:
        f.write(f"protein1 protein2 combined_score\n4932.A 4932.B 500\n{row}\n")
    with pytest.raises(Exception, match="MALFORMED|CAST_INVALID"):
        R.read_links(spark, f"{d}/links.txt", strict=True).collect()


def test_links_with_a_lone_quote(spark):
    d = _local_dir(spark, "quote")
    with open(f"{d}/links.txt", "w") as f:
        f.write('protein1 protein2 combined_score\n"A 4932.B 500\n4932.B C" 150\n')
    assert sorted(tuple(r) for r in R.read_links(spark, f"{d}/links.txt").collect()) == \
        [('"A', "4932.B", 500), ("4932.B", 'C"', 150)]


@pytest.mark.parametrize("data_id", [N.LINKS_DATA_ID, N.ALIASES_DATA_ID, N.INFO_DATA_ID])
def test_single_gz_of_each_kind_is_spread(spark, data_id):
    d = _local_dir(spark, "gzkinds")
    sep = " " if data_id == N.LINKS_DATA_ID else "\t"
    with gzip.open(f"{d}/{R.evidence_file_name(data_id, 4932)}.gz", "wt") as f:
        f.write(sep.join(["protein1", "protein2", "combined_score"]) + "\n")
        f.writelines(sep.join([f"a{i}", f"b{i}", str(i)]) + "\n" for i in range(40))
    df = R.read_evidence(spark, d, data_id, organism=4932, partitions=3)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 40


def test_intermediate_tables_are_removed_after_a_job(spark):
    from pairnet.session import checkpoint, intermediate_tables

    kept = stage_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    with intermediate_tables(spark):
        inner = stage_path(spark, "inner")
        checkpoint(spark.range(5), "tmp").write.parquet(inner)
        out = checkpoint(spark.range(4), "own")
        files = out.inputFiles()
        with intermediate_tables(spark):
            nested = stage_path(spark, "nested")
            spark.range(2).write.parquet(nested)
        assert not R.path_exists(spark, nested) and R.path_exists(spark, inner)
    assert not R.path_exists(spark, inner)
    assert files and not any(R.path_exists(spark, f) for f in files)
    assert R.path_exists(spark, kept)


def test_read_evidence_by_id_picks_gz_and_cleans(spark):
    d = _local_dir(spark, "ev")
    name = R.evidence_file_name(N.LINKS_DATA_ID, 4932)
    with gzip.open(f"{d}/{name}.gz", "wt") as f:
        f.write("protein1 protein2 combined_score\n4932.A 4932.B 500\n")
    df = R.read_evidence(spark, d, N.LINKS_DATA_ID, organism=4932, clean=[N.PROTEIN1, N.PROTEIN2])
    assert [tuple(r) for r in df.collect()] == [("A", "B", 500)]


def test_nan_is_not_dropped_by_drop_nulls(spark):
    df = spark.createDataFrame([("r", "a", "b", math.nan, None)], PAIR_SCHEMA)
    assert P.drop_nulls(df, [N.BEST]).count() == 1
    assert P.drop_nulls(df).count() == 0


def test_gzip_links_spread_after_scan(spark):
    d = _local_dir(spark, "gzrep")
    with gzip.open(f"{d}/links.txt.gz", "wt") as f:
        f.write("protein1 protein2 combined_score\n")
        for i in range(50):
            f.write(f"4932.A{i} 4932.B{i} {i * 10}\n")
    df = R.read_links(spark, f"{d}/links.txt.gz", partitions=3)
    assert df.rdd.getNumPartitions() == 3
    assert df.count() == 50
    assert R.path_exists(spark, f"{d}/links.txt.gz") and not R.path_exists(spark, f"{d}/nope.txt")


def test_shared_folder_comes_from_the_session(spark):
    from pairnet.session import shared_dir

    d = shared_dir(spark)
    assert d == spark.sparkContext.getCheckpointDir()
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:  # set by the environment: the folder lives below it
        assert conf.rstrip("/").split("/")[-1] in d
    assert stage_path(spark, "x").startswith(d.rstrip("/") + "/stage-x-")
