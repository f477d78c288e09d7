"""Expressions that are built once, ranks over ranges, flags over frames."""

import math

from pyspark.sql import functions as F

from riskloom.functions.planned import Noted, planned
from riskloom.operators import fleet


def test_built_once_for_columns_and_types(spark):
    built = []

    @planned
    def add(df):
        built.append(df.dtypes)
        out = df.withColumns({"twice": F.col("x") * 2, "kind": F.lit(dict(df.dtypes)["x"])}).withColumn("more", F.col("twice") + 1)
        return inner(out).drop("twice")

    @planned
    def inner(df):
        assert isinstance(df, Noted) and df.columns[-1] == "more" and dict(df.dtypes)["x"] in ("int", "double")
        return df.withColumn("x", F.col("x") + 100)

    whole = spark.createDataFrame([(1,), (2,)], "x int")
    for df in (whole, whole.where("x = 2"), whole):
        got = add(df)
        assert got.columns == ["x", "kind", "more"]
    assert sorted(map(tuple, got.collect())) == [(101, "int", 3), (102, "int", 5)]
    assert len(built) == 1
    assert [tuple(r) for r in add(whole.select(F.col("x").cast("double")).where("x = 1")).collect()] == [(101.0, "double", 3.0)]
    assert len(built) == 2


def test_nearest_ranks(spark):
    rows = [("a", float(v)) for v in [5, 1, 1, 1, 9, 7, 3]] + [("b", 2.0), ("a", None), (None, 4.0), (None, 6.0)] + [("c", float(i % 97)) for i in range(1000)]
    got = {r.g: (r.p0, r.p50, r.p95, r.p100) for r in fleet.nearest_rank(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    for g in ("a", "b", None, "c"):
        held = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == tuple(held[min(len(held) - 1, math.floor(len(held) * q))] for q in (0.0, 0.5, 0.95, 1.0))
    assert fleet.nearest_rank(spark.createDataFrame(rows, "g string, v double").where("false"), "g", "v", (0.5,)).collect() == []
