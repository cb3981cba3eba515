"""Distributed order statistics and curves against brute force on small
random inputs (NumPy / pandas in the test process only)."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pairnet.operators import curves as C
from pairnet.operators import profile as PR
from pairnet.operators.ranking import exact_quantiles, prefix_sums

SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
values = st.lists(st.integers(min_value=-40, max_value=40), min_size=1, max_size=60)


@SETTINGS
@given(values, st.integers(min_value=1, max_value=5))
def test_prefix_sums_match_cumsum(spark, xs, blocks):
    pdf = pd.DataFrame({"g": [x % 3 for x in xs], "v": [x / 8 for x in xs]}).drop_duplicates()
    pdf["w"] = range(1, len(pdf) + 1)
    df = spark.createDataFrame(pdf)
    got = prefix_sums(df, "v", ["w"], keys=["g"], num_blocks=blocks).toPandas()
    exp = pdf.sort_values(["g", "v"]).assign(cum_w=lambda d: d.groupby("g")["w"].cumsum())
    m = got.merge(exp, on=["g", "v", "w"], suffixes=("", "_exp"))
    assert len(m) == len(pdf)
    assert (m["cum_w"] == m["cum_w_exp"]).all()


@SETTINGS
@given(values, st.integers(min_value=1, max_value=4))
def test_prefix_sums_descending_without_keys(spark, xs, blocks):
    pdf = pd.DataFrame({"v": sorted(set(x / 4 for x in xs))})
    pdf["w"] = 1
    got = prefix_sums(spark.createDataFrame(pdf), "v", ["w"], descending=True, num_blocks=blocks).toPandas()
    got = got.sort_values("v", ascending=False)
    assert list(got["cum_w"]) == list(range(1, len(pdf) + 1))


@pytest.fixture(params=["window", "blocks"])
def rank_path(spark, request):
    """Run a test with the single-task window path and with the block path."""
    if request.param == "blocks":
        spark.conf.set("pairnet.singleTask.maxRows", "1")
    yield request.param
    spark.conf.unset("pairnet.singleTask.maxRows")


@SETTINGS
@given(values)
def test_exact_quantiles_match_numpy(spark, rank_path, xs):
    pdf = pd.DataFrame({"g": [abs(x) % 2 for x in xs], "v": [x / 16 for x in xs]})
    qs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), "v", qs, keys=["g"], num_blocks=3).toPandas()
    for (g, q), row in got.set_index(["g", "q"]).iterrows():
        exp = np.percentile(pdf[pdf.g == g]["v"].to_numpy(), q * 100)
        assert row["quantile"] == pytest.approx(exp, abs=1e-12)
    assert len(got) == pdf["g"].nunique() * len(qs)


@SETTINGS
@given(values)
def test_nearest_quantile_rank(spark, xs):
    pdf = pd.DataFrame({"v": [x / 16 for x in xs]})
    got = exact_quantiles(spark.createDataFrame(pdf), "v", [0.25, 0.5, 0.75],
                          interpolation="nearest").toPandas().set_index("q")["quantile"]
    s = np.sort(pdf["v"].to_numpy())
    for q in (0.25, 0.5, 0.75):
        h = (len(s) - 1) * q
        k = int(np.floor(h + 0.5))  # half away from zero for h >= 0
        assert got[q] == s[k]


@SETTINGS
@given(st.lists(st.floats(min_value=-3, max_value=3, allow_nan=False), min_size=1, max_size=80),
       st.integers(min_value=1, max_value=12))
def test_histogram_matches_numpy(spark, xs, bins):
    pdf = pd.DataFrame({"x": xs})
    got = PR.histogram(spark.createDataFrame(pdf), "x", bins).toPandas().sort_values("bin")
    counts, edges = np.histogram(np.array(xs), bins=bins)
    assert list(got["count"]) == list(counts)
    assert np.allclose(got["bin_start"].to_numpy(), edges[:-1])
    assert np.allclose(got["bin_end"].to_numpy(), edges[1:])


@SETTINGS
@given(st.lists(st.tuples(st.integers(min_value=0, max_value=9), st.integers(min_value=0, max_value=999)),
                min_size=2, max_size=60))
def test_curves_match_brute_force(spark, rank_path, rows):
    pdf = pd.DataFrame({"s": [a / 10 for a, _ in rows], "combined_score": [b for _, b in rows]})
    df = spark.createDataFrame(pdf)
    lab = (pdf["combined_score"] >= 400).astype(int)
    P, N = lab.sum(), len(lab) - lab.sum()
    ths = sorted(pdf["s"].unique(), reverse=True)
    tps = [int(((pdf["s"] >= t) & (lab == 1)).sum()) for t in ths]
    fps = [int(((pdf["s"] >= t) & (lab == 0)).sum()) for t in ths]
    roc = C.roc_curve(df, "s").toPandas().sort_values("threshold", ascending=False)
    assert list(roc["tp"]) == tps and list(roc["fp"]) == fps
    auc = C.roc_auc(df, "s").first()[0]
    ap = C.average_precision(df, "s").first()[0]
    if P == 0 or N == 0:
        assert auc is None
    else:
        tpr = np.array([0] + tps) / P
        fpr = np.array([0] + fps) / N
        assert auc == pytest.approx(np.trapezoid(tpr, fpr), abs=1e-12)
    if P == 0:
        assert ap is None
    else:
        rec = np.array([0] + tps) / P
        prec = np.array(tps) / (np.array(tps) + np.array(fps))
        assert ap == pytest.approx(float(np.sum(np.diff(rec) * prec)), abs=1e-12)


@SETTINGS
@given(st.lists(st.integers(min_value=-500, max_value=500), min_size=1, max_size=200),
       st.sampled_from([1, 20, 50_000]))
def test_bracketed_global_quantiles_are_exact(spark, rank_path, xs, accuracy):
    from pairnet.operators.ranking import global_quantiles

    pdf = pd.DataFrame({"v": [x / 7 for x in xs]})
    qs = [0.0, 0.1, 0.5, 0.75, 0.999, 1.0]
    got = global_quantiles(spark.createDataFrame(pdf), "v", qs, accuracy=accuracy).toPandas()
    got = got.set_index("q")["quantile"]
    for q in qs:
        assert got[q] == pytest.approx(np.percentile(pdf["v"].to_numpy(), q * 100), abs=1e-12)
