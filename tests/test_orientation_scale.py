"""Orientation statistics: exact medians by ranges, joins that do not pass through the driver."""

import random

import pytest
from pyspark.sql import functions as F

from corpusops.operators import evaluation as E
from corpusops.operators import manifest as M


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_medians_across_ranges(spark):
    roll = random.Random(2)
    rows = [(m, roll.randint(0, 60) / 8, roll.randint(1, 4)) for m, n in (("a", 101), ("b", 40), ("c", 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "m string, v double, n int").groupBy("m", "v").agg(F.sum("n").alias("n"))
    got = {r["m"]: r["median"] for r in E.medians(df, ["m"], "v", "n", 7).collect()}
    want = df.select("m", "v", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).groupBy("m").agg(F.percentile("v", 0.5).alias("p"))
    assert got == {r["m"]: r["p"] for r in want.collect()}


def test_orientation_joins_do_not_broadcast(spark):
    df = spark.range(40).select(F.col("id").alias("uid"), F.when(F.col("id") % 2 == 0, F.lit("abc")).alias("gt_text"), F.struct(F.lit("p").alias("source")).alias("meta"))
    turns = df.select("uid", F.explode(F.array(F.lit(0), F.lit(90))).alias("angle"))
    turns = turns.select("uid", "angle", (F.col("uid") * 7 % 5 + F.col("angle") / 90).alias("proj"), F.lit(0.5).alias("cc"), F.lit(0.0).alias("penalty"), (F.col("uid") % 4 / 4).alias("density"), (F.col("uid") % 3).alias("lines"))
    read = df.select("uid", F.explode(F.array(F.lit(True), F.lit(False))).alias("mirrored"), F.lit(False).alias("reverse"), F.lit("abd").alias("text"))
    out, stats = M.orient_manifest(df, turns, read, None, 42, "a-m")
    assert "Broadcast" not in plan_of(out)
    got = {(r["measure"], r["key"]): r["value"] for r in stats.collect()}
    assert got["rotation", "90"] == 40 and got["binarize_density", "median"] == 0.375 and got["n_lines_est", "mean"] == pytest.approx(0.975)


def test_orientation_stats_of_nothing(spark):
    none = spark.createDataFrame([], "orientation_deg int, orientation_confidence double, binarize_density double, n_lines_est long, mirrored boolean, reverse_pred boolean")
    assert {(r["measure"], r["key"], r["value"]) for r in M.orientation_stats(none).collect()} == {(m, k, 0.0) for m in ("orientation_confidence", "binarize_density", "n_lines_est") for k in ("mean", "median")}
