"""Files of exports, outside detectors and feature extremes: against their SQL, and cases worked out by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from riskloom.operators import detectors
from riskloom.sources import files

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " a ", 'say "x", y', "two\nlines", "é\t\\", '"']


@pytest.mark.parametrize("name", ["export_logs_csv", "export_threats_ndjson", "external_detectors", "feature_extremes"])
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.execute(f"select {', '.join(df.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("kind", files.KINDS)
def test_files_keep_every_text(spark, tmp_path, kind):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    files.write_rows(df, f"{tmp_path}/rows", kind)
    assert {(r.id, r.text) for r in files.read_rows(spark, f"{tmp_path}/rows", kind, df.schema).collect()} == set(enumerate(TEXTS))
    files.write_rows(df.limit(0), f"{tmp_path}/none", kind)
    assert files.read_rows(spark, f"{tmp_path}/none", kind, df.schema).count() == 0
    with pytest.raises(ValueError):
        files.write_rows(df, f"{tmp_path}/x", "xml")


def test_shadow_results_count_nowhere(spark):
    rows = [
        (1, "Advanced_Auth", 80.0, None, True, False), (1, "auth", 90.0, 0.9, True, True), (1, "other", 99.0, 0.99, True, None),
        (2, "z_score", None, 0.4, None, False), (3, "model", 50.0, 0.5, True, True), (3, None, 10.0, 0.2, False, False),
    ]
    df = spark.createDataFrame(rows, "id long, detector_name string, score double, confidence double, is_anomaly boolean, is_shadow boolean")
    out = {r.id: tuple(r)[1:] for r in detectors.external(df, "id").collect()}
    assert out == {1: (80.0, 0.0, 0.0, 0.75, 0.0, 0.0, 2), 2: (0.0, 0.0, 0.0, 0.75, 0.4, 0.0, 0), 3: (0.0, 0.0, 0.0, 0.75, 0.0, 0.0, 0)}


def test_median_of_the_first_peak_of_all(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(-3, 10)] + [("b", 1, None)], "k string, at long, x double")
    assert [tuple(r) for r in detectors.extremes(df, ["k"], [F.col("at")], "x", most=6).collect()] == [("a", 6, 0.0, 9.0)]
