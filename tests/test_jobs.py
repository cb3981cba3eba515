"""End-to-end jobs over the source file layout (test tables staged as the
pair/confidence Parquet files and the evidence text files)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pairnet.functions import names as N
from pairnet.plans import jobs as J
from pairnet.plans.inputs import ORGANISM, Inputs, stage_parquet_inputs, stage_text_inputs
from pairnet.session import stage_path


@pytest.fixture(scope="module")
def layout(spark):
    i = Inputs(spark, SF_SMALL)
    return stage_parquet_inputs(i), stage_text_inputs(i, gzip_links=True)


def test_run_pipeline(spark, layout):
    a = J.run_pipeline(spark, layout[0])
    assert a.confident.count() == 1121
    assert a.protein_count.first()[0] == 200
    assert a.bias.count() == 200
    top = a.bias.first()
    assert top[N.PROTEIN_AVG] == a.stats.agg(F.max(N.PROTEIN_AVG)).first()[0]


def test_load_and_map_and_exports(spark, layout):
    cmp = J.load_and_map_data(spark, layout[0], layout[1], organism=ORGANISM)
    saved = J.save_comparison(cmp, stage_path(spark, "cmp-csv"), stage_path(spark, "cmp-pq"))
    assert saved.count() == 3530
    assert saved.where(F.col(N.COMBINED_SCORE).isNotNull()).count() == 2344
    out = J.network_exports(saved, stage_path(spark, "net"))
    best = spark.read.option("header", True).csv(out["best"])
    mean = spark.read.option("header", True).csv(out["mean"])
    assert (best.count(), mean.count()) == (710, 649)


def test_size_corrected_edges(spark, layout):
    path = stage_path(spark, "edges")
    edges = J.size_corrected_edges(spark, layout[0], path)
    back = spark.read.csv(path)  # header-less
    assert back.count() == edges.count() == 2962
    assert set(r[0] for r in back.select("_c3").distinct().collect()) == {"U"}
    cascade = J.size_corrected_edges(spark, layout[0], cutoff=None)
    assert cascade.count() == 97
    assert cascade.agg(F.max(N.WEIGHT)).first()[0] == 1.0
