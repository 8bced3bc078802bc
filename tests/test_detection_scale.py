"""Detection metrics in one order for all thresholds, matching in batches, boxes dealt once."""

import random

import pytest
from pyspark.sql import functions as F

from corpusops.operators import evaluation as E
from corpusops.plans.fixtures import Inputs

BOX = "uid long, idx long, x1 double, y1 double, x2 double, y2 double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def boxes(spark, seed):
    roll = random.Random(seed)
    box = lambda: (x := float(roll.randint(0, 5)), y := float(roll.randint(0, 5)), x + roll.randint(1, 6), y + roll.randint(1, 6))
    gt = [(u, i, *box()) for u in range(60) for i in range(roll.randint(0, 6))]
    pred = [(u, i, *box(), roll.randint(0, 3) / 4) for u in range(62) for i in range(roll.randint(0, 8))]
    return spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, BOX + ", score double")


def test_areas_of_all_levels_are_those_of_the_curve(spark):
    gt, pred = boxes(spark, 5)
    levels = [0.1, 0.3, 0.5]
    both = pred.withColumn("m", F.lit("a")).unionByName(pred.filter("idx < 3").withColumn("m", F.lit("b")))
    hits, n_gt = E.matched(gt, both, levels, ["m"]), gt.agg(F.count("*").alias("n_gt"))
    got = {(r["m"], r["threshold"]): r for r in E.level_areas(hits, n_gt, ["m"], levels, 40).collect()}
    assert len(got) == 6
    for m in "ab":
        for t in levels:
            alone = E.match_detections(gt, both.filter(F.col("m") == m), [t])
            want = E.average_precision(E.pr_curve(alone, n_gt, [], 10_000), []).first()
            assert [got[m, t][c] for c in ("ap", "recall", "precision")] == pytest.approx([want[c] for c in ("ap", "recall", "precision")])


def test_matching_in_small_batches(spark):
    gt, pred = boxes(spark, 9)
    want = set(map(tuple, E.matched(gt, pred, [0.2, 0.4]).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert set(map(tuple, E.matched(gt, pred, [0.2, 0.4]).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_matching_orders_predictions_once(spark):
    gt, pred = boxes(spark, 1)
    calls, real = [], E.kept
    E.kept = lambda df, name: calls.append((name, df.columns)) or real(df, name)
    try:
        rows = E.detection_metrics(gt, pred).collect()
    finally:
        E.kept = real
    assert len(rows) == len(E.THRESHOLDS)
    assert all("threshold" not in columns for _, columns in calls)  # no row for each prediction and threshold is written


def test_boxes_are_shuffled_by_uid_once(spark):
    rows = [(k % 9, k % 50, k % 7, k % 3, 1.0 * k, 2.0) for k in range(99)]
    table = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_quantity double")
    t = Inputs(spark, "")
    t.table = lambda name: table
    counted = t.view("v_boxes_gt").groupBy("uid").agg(F.count("*"))
    assert plan_of(counted).count("Exchange hashpartitioning") == 1


def test_coco_annotations_are_not_dealt_by_label(spark, monkeypatch):
    from corpusops.plans import files

    seen, real = [], files.io.write_coco
    monkeypatch.setattr(files.io, "write_coco", lambda images, annotations, *rest: seen.append(plan_of(annotations)) or real(images, annotations, *rest))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files.sink_coco(Inputs(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(label" not in seen[0]
