"""Rejected lines, landed .gz files, verified sinks."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from pairnet.functions import names as N
from pairnet.sources import readers as R
from pairnet.sources import sinks as K
from pairnet.sources.landing import landed, landing_path, published

HEAD = "protein1 protein2 combined_score\n"


def test_every_line_is_kept_or_has_a_reason(spark, tmp_path):
    lines = ["a b 1", "a b", "a b 2 3", "a b x", "", "c d ", "e f 9223372036854775808", '"q r 7', "g h 4"]
    (tmp_path / "one.txt").write_text(HEAD + "\n".join(lines) + "\n")
    checked = R.checked_links(spark, str(tmp_path / "one.txt"))
    assert [(r[0], r[1], r[2]) for r in R.kept_links(checked).orderBy(N.PROTEIN1).collect()] == [
        ('"q', "r", 7), ("a", "b", 1), ("c", "d", None), ("g", "h", 4)]
    assert {(r["reject_reason"], r["raw_line"]) for r in R.quarantine(checked).collect()} == {
        ("fields", "a b"), ("fields", "a b 2 3"), ("value", "a b x"), ("value", "e f 9223372036854775808")}
    assert {r["reason"]: r["lines"] for r in R.reject_counts(checked).collect()} == {"kept": 4, "fields": 2, "value": 2}
    (tmp_path / "none.txt").write_text(HEAD)
    assert R.checked_links(spark, str(tmp_path / "none.txt")).count() == 0


def test_a_gz_is_parsed_once(spark, tmp_path):
    path = str(tmp_path / "links.txt.gz")

    def put(rows):
        with gzip.open(path, "wt") as f:
            f.write(HEAD + "".join(f"a{i} b{i} {i}\n" for i in range(rows)))

    put(100)
    parsed = []

    def read(s, p):
        parsed.append(p)
        return R.read_links(s, p)

    first = landed(spark, path, read, "test")
    assert "FileScan parquet" in first._jdf.queryExecution().executedPlan().toString()
    assert first.count() == 100 and first.agg(F.sum(N.COMBINED_SCORE)).first()[0] == 4950
    again = landed(spark, path, read, "test")
    assert again.count() == 100 and len(parsed) == 1
    assert again.inputFiles() == first.inputFiles()
    # Another source under the same name lands anew; what was landed stays.
    put(7)
    os.utime(path, (1, 1))
    assert landed(spark, path, read, "test").count() == 7 and len(parsed) == 2
    os.remove(path)
    assert first.count() == 100


def test_the_second_of_two_landings_gives_way(spark, tmp_path):
    (tmp_path / "in.txt").write_text(HEAD + "a b 1\n")
    target = landing_path(spark, str(tmp_path / "in.txt"), "race")
    for k, rows in enumerate((3, 5)):
        own = f"{target}.{k}.part"
        spark.range(rows).write.parquet(own)
        assert published(spark, own, target) == (k == 0)
        assert not R.path_exists(spark, own)
    assert spark.read.parquet(target).count() == 3


@pytest.mark.parametrize("write", [K.write_parquet, K.write_csv, K.write_edges])
def test_a_manifest_says_what_was_written(spark, tmp_path, write):
    df = spark.createDataFrame([("a", 1.5, None), ("a", 1.5, None), ("b", None, 3)], "s string, x double, n long").repartition(2)
    path = str(tmp_path / "t")
    m = K.write_verified(df, path, write)
    assert m["rows"] == 3 and m["nulls"] == {"s": 0, "x": 1, "n": 2} and K.read_manifest(spark, path) == m
    assert K.complete(spark, path) == path
    back = spark.read.parquet(path) if write is K.write_parquet else \
        spark.read.schema(df.schema).option("header", write is K.write_csv).csv(path)
    assert K.differences(back, m) == {}
    assert "checksum" in K.differences(back.where("s = 'b'").unionByName(back.where("s = 'b'")), m)
    assert K.differences(back.limit(1), m)["rows"] == (1, 3)


def test_a_broken_write_has_no_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    K.write_verified(spark.range(10), path)
    bad = spark.range(1000).repartition(8).select(F.when(F.col("id") == 700, F.raise_error(F.lit("killed"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        K.write_verified(bad, path)
    assert K.read_manifest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        K.complete(spark, path)


def test_an_empty_table_has_a_manifest(spark, tmp_path):
    m = K.write_verified(spark.range(0), str(tmp_path / "t"))
    assert m["rows"] == 0 and K.differences(spark.read.parquet(str(tmp_path / "t")), m) == {}
