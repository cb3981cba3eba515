"""Nested cut-offs and grouped quantiles against NumPy, their passes over the
input and their shuffles from Spark's event log."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import ROOT
from pairnet.operators import cascade
from pairnet.operators.cascade import nested_cutoffs
from pairnet.operators.ranking import exact_quantiles


def plain(x, q, rounds):
    out = []
    for r in range(rounds):
        cut = float(np.percentile(x, q * 100))
        x = x[x >= cut]
        out.append((r + 1, cut, len(x)))
    return out


def same(got, want):
    assert [(r, k) for r, _, k in got] == [(r, k) for r, _, k in want]
    assert [c for _, c, _ in got] == pytest.approx([c for _, c, _ in want], abs=1e-12)


def columns(rng):
    return {
        "continuous": rng.normal(size=20_000),
        "few values": rng.integers(0, 7, 20_000) / 7,
        "one value": np.full(500, 0.25),
        "hot value at the cut": np.where(rng.random(20_000) < 0.35, 0.8, rng.random(20_000)),
        "hot value above": np.where(rng.random(20_000) < 0.4, 2.0, rng.random(20_000)),
        "tiny": np.array([0.1, 0.2]),
        "single": np.array([3.5]),
    }


@pytest.mark.parametrize("name", columns(np.random.default_rng(0)))
def test_cutoffs_are_exact(spark, name):
    x = columns(np.random.default_rng(5))[name]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(5)
    for q, rounds in ((0.75, 3), (0.5, 4)):
        same(nested_cutoffs(df, "v", q, rounds, accuracy=200, grid=100), plain(x, q, rounds))
        same(nested_cutoffs(df, "v", q, rounds), plain(x, q, rounds))


def test_a_round_falls_back_alone(spark, monkeypatch):
    x = np.random.default_rng(2).random(5000)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    own = cascade._brackets

    def second_is_wrong(*a):
        b = own(*a)
        return [b[0], (-2.0, -1.0), b[2]]

    asked = []
    exact = cascade.exact_quantile_value
    monkeypatch.setattr(cascade, "_brackets", second_is_wrong)
    monkeypatch.setattr(cascade, "exact_quantile_value", lambda *a: asked.append(a) or exact(*a))
    same(nested_cutoffs(df, "v", 0.75, 3), plain(x, 0.75, 3))
    assert len(asked) == 1


def test_empty_columns(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert nested_cutoffs(df, "v", 0.75, 3) == [] and nested_cutoffs(df.limit(0), "v", 0.75, 3) == []


@pytest.mark.parametrize("accuracy, materialize", [(20, False), (2000, False), (2000, True)])
def test_grouped_quantiles_are_exact(spark, accuracy, materialize):
    """A coarse sketch's brackets miss ranks of small groups: they fall back."""
    rng = np.random.default_rng(7)
    rows = [(g, float(v)) for g, n in (("hot", 6000), ("b", 700), ("c", 1), (None, 40))
            for v in (rng.random(n) if g != "b" else rng.integers(0, 3, n))]
    df = spark.createDataFrame(rows + [("none", None)], "g string, v double").repartition(4)
    for how in ("linear", "nearest"):
        got = {(r["g"], r["q"]): r["quantile"] for r in exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.99, 1.0], ["g"], how, accuracy=accuracy, materialize=materialize).collect()}
        assert len(got) == 4 * 5
        for (g, q), v in got.items():
            x = np.sort([b for a, b in rows if a == g])
            want = np.percentile(x, 100 * q) if how == "linear" else x[int(np.floor((len(x) - 1) * q + 0.5))]
            assert v == pytest.approx(want, abs=1e-12), (g, q, how)


JOB = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4") \\
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://" + sys.argv[2] + "/log") \\
    .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false") \\
    .config("spark.checkpoint.dir", sys.argv[2] + "/ckpt").getOrCreate()
path = sys.argv[2] + "/input"
i = F.col("id")
spark.range(0, 1_000_000, 1, 4).select(F.when(i % 3 == 0, 0).otherwise(i % 5 + 1).alias("g"), F.rand(1).alias("v"), F.rand(2).alias("w")).write.parquet(path)
spark.sparkContext.setJobGroup("measured", "measured")
df = spark.read.parquet(path)
if sys.argv[3] == "cascade":
    from pairnet.operators.stats import quartile_cascade
    quartile_cascade(df, "v")
else:
    from pairnet.operators.ranking import exact_quantiles
    exact_quantiles(df, "v", [0.25, 0.5, 0.75], ["g"]).collect()
spark.stop()
"""


def measured(tmp_path, job):
    os.makedirs(tmp_path / "log")
    subprocess.run([sys.executable, "-c", JOB, ROOT, str(tmp_path), job], check=True, capture_output=True, timeout=300)
    stages, rows, shuffled = set(), 0, 0
    for line in (tmp_path / "log" / os.listdir(tmp_path / "log")[0]).read_text().splitlines():
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart" and e["Properties"].get("spark.jobGroup.id") == "measured":
            stages.update(e["Stage IDs"])
        if e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in stages:
            m = e["Task Metrics"]
            rows += m["Input Metrics"]["Records Read"]
            shuffled += m["Shuffle Write Metrics"]["Shuffle Bytes Written"]
    size = sum(f.stat().st_size for f in (tmp_path / "input").glob("*.parquet"))
    return rows, shuffled, size


def test_cascade_reads_the_column_three_times(tmp_path):
    rows, shuffled, size = measured(tmp_path, "cascade")
    # Beside the three passes: the ranks of the values inside the brackets, and nothing like a copy.
    assert 3_000_000 <= rows <= 3_200_000
    assert shuffled < 0.05 * size


def test_grouped_quantiles_shuffle_little(tmp_path):
    rows, shuffled, size = measured(tmp_path, "groups")
    assert 3_000_000 <= rows <= 3_200_000
    assert shuffled < 0.05 * size
