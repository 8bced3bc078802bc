"""Operators on small rows, and properties that must hold."""

import pytest
from pyspark.sql import functions as F

from corpusops.operators import decoding as D
from corpusops.operators import evaluation as E
from corpusops.operators import manifest as M
from corpusops.operators import runs as U
from corpusops.operators import splits as S
from corpusops.sources import io
from corpusops.streaming import streams

BOX = "uid long, idx long, x1 double, y1 double, x2 double, y2 double"


def test_match_detections(spark):
    gt = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0)], BOX)
    pred = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 1, 0.0, 0.0, 10.0, 9.0, 0.9), (2, 0, 0.0, 0.0, 1.0, 1.0, 0.9)], BOX + ", score double")
    got = {r["idx"]: r["tp"] for r in E.match_detections(gt, pred, [0.5]).collect()}
    assert got == {1: 1, 0: 0}


def test_class_without_support_is_no_part_of_macro(spark):
    counts = spark.createDataFrame([(0, 0, 3), (0, 2, 1), (1, 1, 4)], "y_true int, y_pred int, n long")
    s = E.summary_metrics(counts).first()
    assert s["accuracy"] == pytest.approx(7 / 8) and s["macro_recall"] == pytest.approx((0.75 + 1) / 2)


def test_average_precision_by_hand(spark):
    hits = spark.createDataFrame([(1, 0, 0.9, 1), (1, 1, 0.8, 0), (1, 2, 0.7, 1)], "uid long, idx long, score double, tp int")
    curve = E.pr_curve(hits, spark.createDataFrame([(2,)], "n_gt long"), [])
    rows = {r["idx"]: (r["recall"], round(r["envelope"], 6)) for r in curve.collect()}
    assert rows == {0: (0.5, 1.0), 1: (0.5, 0.666667), 2: (1.0, 0.666667)}
    assert E.average_precision(curve, []).first()["ap"] == pytest.approx(0.5 + 0 + 0.5 * 2 / 3)


def test_edit_script(spark):
    df = spark.createDataFrame([("abc", "axcd"), (None, "z")], "r string, p string")
    got = [[(s["op"], s["a"], s["b"]) for s in r["s"]] for r in df.select(E.edit_script("r", "p").alias("s")).collect()]
    assert got == [[("equal", "a", "a"), ("sub", "b", "x"), ("equal", "c", "c"), ("ins", None, "d")], [("ins", None, "z")]]


def test_uids_and_gold(spark):
    g = spark.createDataFrame([("7", ["a"]), ("8", ["a", "b"]), ("9", [])], "row_id string, images array<string>")
    assert sorted(r["uid"] for r in M.explode_images(g).collect()) == ["7", "8_00", "8_01"]
    base = spark.createDataFrame([(1, (0.0, 0.0, 1.0, 1.0))], "uid long, box struct<x1:double,y1:double,x2:double,y2:double>")
    gold = spark.createDataFrame([(1, "labelstudio_pct", [1.0, 1.0, 1.0, 1.0], None, None, 0)], "uid long, format string, v array<double>, width int, height int, ord int")
    assert M.apply_gold(base, gold).first()["box"] is None


def test_mirror_needs_a_margin(spark):
    rows = spark.createDataFrame([(1, True, False, 0.54), (1, False, False, 0.5), (2, True, True, 0.9), (2, False, False, 0.5)], "uid long, mirrored boolean, reverse boolean, quality double")
    assert {r["uid"]: r["mirrored"] for r in M.mirror_pick(rows).collect()} == {1: None, 2: True}


def test_unscored_and_empty_crops(spark):
    rows = spark.createDataFrame([(1, 0, 500.0, 0.0, 600.0, 9.0, 0.9), (1, 1, 0.0, 0.0, 9.0, 9.0, None), (1, 2, 0.0, 0.0, 9.0, 9.0, 0.1)], BOX + ", score double")
    got = M.crops_topk(rows, 1, 0.5, F.lit(100), F.lit(100)).collect()
    assert [r["idx"] for r in got] == [1]


def test_groups_never_cross_splits_and_partitions_do_not_matter(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("row_id"))
    a = {r["row_id"]: r["split"] for r in S.split_greedy(df, "row_id").collect()}
    b = {r["row_id"]: r["split"] for r in S.split_greedy(df.repartition(17), "row_id").collect()}
    assert a == b and len(a) == 37 and set(a.values()) == {"train", "val", "test"}
    v = S.group_split(df, "row_id", 300).filter("validation").agg(F.sum("n")).first()[0]
    assert abs(v - 300) <= 27


def test_merge_is_idempotent(spark):
    df = spark.createDataFrame([(1, 0, 5, "a"), (1, 1, 0, "b"), (2, 0, 1, "c")], "uid long, shard long, line long, v string")
    once = S.merge_last_wins(df, "uid", ["shard", "line"])
    assert sorted((r["uid"], r["v"]) for r in once.collect()) == [(1, "b"), (2, "c")]
    assert sorted(S.merge_last_wins(once, "uid", ["shard", "line"]).collect()) == sorted(once.collect())


def test_audit_and_safety(spark):
    a = spark.createDataFrame([(1,), (None,)], "row_id long")
    r = S.audit_leak(a, spark.createDataFrame([(2,)], "row_id long")).first()
    assert (r["shared"], r["missing"], r["passed"]) == (0, 1, False)
    with pytest.raises(ValueError):
        S.split_safety({"split": "a"}, {"split": "a"}, True)
    with pytest.raises(ValueError):
        S.normalize_ratios((0, 0, 0))
    with pytest.raises(ValueError):
        S.regime_select({}, "real")


def test_best_epoch_and_tolerance(spark):
    e = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 0, 0.1)], "run_id long, epoch long, metric double")
    assert U.best_epoch(e).first()["epoch"] == 1
    f = spark.createDataFrame([("m", 0.5)], "k string, v double")
    assert U.compare_tables(f, spark.createDataFrame([("m", 0.75)], "k string, v double"), "k", ["v"], 0.25).count() == 0
    with pytest.raises(ValueError):
        U.compare_runs(e, "nope", 1)


def test_columns_win_ties(spark):
    rows = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 1.0, 1.0)], "uid long, idx long, ch string, x1 double, y1 double, x2 double, y2 double")
    assert D.auto_lines(D.tokens_of(rows)).first()["vertical"] is True


def test_decode_two_lines_right_to_left(spark):
    rows = [(1, i, c, x, y, x + 8.0, y + 8.0) for i, (c, x, y) in enumerate([("a", 40.0, 0.0), ("b", 30.0, 1.0), ("c", 20.0, 0.0), ("d", 41.0, 30.0), ("e", 21.0, 30.0)])]
    df = spark.createDataFrame(rows, "uid long, idx long, ch string, x1 double, y1 double, x2 double, y2 double")
    assert D.decode(df).first()["pred_text"] == "abc de"


def test_sources(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"uid": 1}\nnot json\n')
    assert io.read_jsonl_lenient(spark, str(tmp_path / "bad.jsonl"), "uid long").count() == 1
    assert io.read_jsonl_lenient(spark, str(tmp_path / "none.jsonl"), "uid long").count() == 0
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "uid long").collect()
    (tmp_path / "meta.csv").write_text("X,b\n1,2\n")
    with pytest.raises(ValueError):
        io.read_metadata_csv(spark, str(tmp_path / "meta.csv"))
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "u1.txt").write_text("0 .5 .5 .1 .1\n0 .5 .5 .1\n")
    assert [r["uid"] for r in io.read_yolo(spark, str(tmp_path / "y")).collect()] == ["u1"]
    (tmp_path / "ls.json").write_text('[{"data":{"uid":"u"},"annotations":[],"predictions":[{"result":[{"type":"rectanglelabels","value":{"x":1,"y":2,"width":3,"height":4}}]}]}]')
    assert [r["label"] for r in io.read_label_studio(spark, str(tmp_path / "ls.json"), True).collect()] == ["glyph"]


def test_prefix_sums_do_not_depend_on_blocks(spark):
    df = spark.range(50).select((F.col("id") * 3).alias("k"), (F.col("id") % 4).alias("n"))
    got = {r["k"]: r["s"] for r in io.prefix_sums(df, "k", "n", "s", 8).collect()}
    assert got == {i * 3: sum(j % 4 for j in range(i)) for i in range(50)}


def test_streams_equal_batch(spark, tmp_path):
    e = spark.range(200).select((F.col("id") % 7).alias("run_id"), F.col("id").alias("epoch"), ((F.col("id") * 31) % 50).cast("double").alias("metric"))
    e.repartition(3).write.json(str(tmp_path / "in"))
    got = streams.running_best(spark, str(tmp_path / "in"), "run_id LONG, epoch LONG, metric DOUBLE", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, U.best_epoch(e).collect()))


def test_quotas_add_up():
    assert S.quotas({"a": 1.0, "b": 1.0, "c": 1.0}, 1000) == {"a": 334, "b": 333, "c": 333}
    assert sum(S.quotas({"a": 0.1, "b": 0.7, "c": 0.2}, 17).values()) == 17


def test_weighted_mix_loses_no_draw(spark):
    df = spark.range(90).select(F.col("id").alias("uid"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("source_tag"))
    assert S.weighted_mix(df, {"a": 1.0, "b": 1.0, "c": 1.0, "none": 5.0}, 1000, 1).count() == 1000


def test_dense_index_does_not_depend_on_cells(spark):
    df = spark.range(500).select(F.col("id").alias("uid"), (F.col("id") % 2).alias("t"))
    one, two = ({r["uid"]: r["row_no"] for r in S.dense_index(df, "t", "uid", w).collect()} for w in (20_000, 1))
    assert one == two and sorted(one.values()) == sorted([*range(250)] * 2)


def test_confusion_pivot_minds_case(spark):
    rows = spark.createDataFrame([("sub", "a", "A", 3), ("sub", "A", "a", 2), ("del", "b", None, 1)], "op string, a string, b string, n long")
    got = {r["true_char"]: (r["pred_0061"], r["pred_0041"]) for r in E.confusion_pivot(rows, 5).collect()}
    assert got == {"a": (0, 3), "A": (2, 0)}


def test_run_folders(spark, tmp_path):
    for run, files in {"a": {"run_metadata.json": '{"epochs": 3}', "metrics.json": '{"map": 0.5}'}, "b": {"run_metadata.json": '{"epochs": 4}'}, "c": {"metrics.json": "no json"}}.items():
        (tmp_path / f"run={run}").mkdir()
        for name, text in files.items():
            (tmp_path / f"run={run}" / name).write_text(text)
    r = io.read_run_dirs(spark, str(tmp_path), {"run_metadata.json": "epochs LONG", "metrics.json": "map DOUBLE"})
    got = {x["run_id"]: (x["epochs"], x["map"]) for x in r.select("run_id", "run_metadata.epochs", "metrics.map").collect()}
    assert got == {"a": (3, 0.5), "b": (4, None), "c": (None, None)}


def test_images_and_other_files(spark, tmp_path):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", 5, 3, 8, 2, 0, 0, 0)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress((b"\0" + b"\1\2\3" * 5) * 3)) + chunk(b"IEND", b"")
    (tmp_path / "good.png").write_bytes(png)
    (tmp_path / "bad.png").write_bytes(b"nothing")
    (tmp_path / "cut.png").write_bytes(png[:-4])
    got = {r["name"]: (r["size"], r["format"], r["width"], r["height"], r["error"]) for r in io.read_binary(spark, str(tmp_path)).collect()}
    assert got == {"good.png": (len(png), "png", 5, 3, None), "bad.png": (7, None, None, None, "no image of a known format"), "cut.png": (len(png) - 4, "png", 5, 3, "png: file is cut off")}


def test_a_job_that_is_run_again(spark, tmp_path):
    todo = spark.range(10).select(F.col("id").alias("uid"))
    done = spark.createDataFrame([(0, "old")], "uid long, state string")
    work = lambda state: lambda rows: rows.select("uid", F.lit(state).alias("state"))
    M.resume_batch(todo.filter("uid < 4"), done, work("one"), 3, str(tmp_path / "shards")).count()
    got = {r["uid"]: r["state"] for r in M.resume_batch(todo, done, work("two"), 3, str(tmp_path / "shards")).collect()}
    assert got == {0: "old", 1: "one", 2: "one", 3: "one", **{i: "two" for i in range(4, 10)}}


def test_evaluation_with_detection(spark):
    manifest = spark.createDataFrame([(1, "val", "abc"), (2, "val", "xyz"), (3, "train", "q")], "uid long, split string, gt_text string")
    preds = spark.createDataFrame([("m", 1, "", "abc"), ("m", 2, None, "xy"), ("m", 3, "q", "z")], "approach string, uid long, gt_text string, pred_text string")
    gt = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 9.0), (3, 0, 0.0, 0.0, 9.0, 9.0)], BOX)
    boxes = spark.createDataFrame([("m", 1, 0, 0.0, 0.0, 9.0, 9.0, 0.9)], "approach string, " + BOX + ", score double")
    out = E.evaluate_approaches(preds, manifest, "VAL", 1, gt, boxes)
    m = out["metrics"].first()
    assert (m["n"], m["exact"]) == (2, 0.5)
    assert [(r["uid"], r["rank"]) for r in out["worst"].collect()] == [(2, 1)]
    assert out["detection"].select("ap", "precision").first() == (1.0, 1.0)


def test_label_files_and_coco_in_one_file(spark, tmp_path):
    b = F.struct(F.lit(0.5).alias("cx"), F.lit(0.5).alias("cy"), F.lit(0.1).alias("w"), F.lit(0.2).alias("h"))
    rows = spark.range(4).select(F.lit("train").alias("split"), (F.col("id") % 2).alias("uid"), F.col("id").alias("idx"), F.lit(7).alias("cls"), b.alias("box"))
    back = io.read_yolo_packed(spark, io.write_yolo(rows, str(tmp_path / "y")))
    assert sorted((r["uid"], r["line_no"], r["cls"], r["h"]) for r in back.collect()) == [("0", 0, 7, 0.2), ("0", 1, 7, 0.2), ("1", 0, 7, 0.2), ("1", 1, 7, 0.2)]
    ids = spark.createDataFrame([(1, "u")], "id long, uid string")
    io.write_coco(ids, spark.createDataFrame([(1, 1)], "id long, image_id long"), spark.createDataFrame([(0, "glyph")], "id long, name string"), str(tmp_path / "c"), single=True)
    text = "".join(r[0] for r in spark.read.text(str(tmp_path / "c" / "coco.json"), wholetext=True).collect()).replace("\n", "")
    assert text == '{"images":[{"id":1,"uid":"u"}],"annotations":[{"id":1,"image_id":1}],"categories":[{"id":0,"name":"glyph"}]}'


def test_long_edit_scripts(spark):
    """A thousand characters: the script turns the reference into the prediction with the least edits."""
    import random

    random.seed(1)
    a = "".join(random.choice("abcd") for _ in range(1000))
    b = "".join(c for c in a if random.random() > 0.1)
    df = spark.createDataFrame([(a, b)], "r string, p string")
    row = df.select(E.edit_script("r", "p").alias("s"), F.levenshtein("r", "p").alias("d")).first()
    assert "".join(s["b"] or "" for s in row["s"]) == b and "".join(s["a"] or "" for s in row["s"]) == a
    assert sum(s["op"] != "equal" for s in row["s"]) == row["d"]


def fold_of_groups(sizes, target):
    import hashlib

    order = sorted(sizes, key=lambda g: (hashlib.sha1(str(g).encode()).hexdigest(), g))
    v, seen, total, taken = 0, 0, sum(sizes.values()), {}
    for g in order:
        n, need = sizes[g], target - v
        taken[g] = need > 0 and (n <= 2 * need or total - seen - n < need)
        v, seen = v + n * taken[g], seen + n
    return taken


def test_group_split_is_the_fold_of_groups_in_order(spark):
    import random

    random.seed(3)
    for case, (groups, largest, share) in enumerate([(60, 5, 0.3), (60, 400, 0.1), (40, 9, 1.0), (40, 9, 1.2), (30, 1, 0.5), (50, 1000, 0.01), (1, 7, 0.5)]):
        sizes = {g: random.choice([1, 2, random.randint(1, largest)]) for g in range(groups)}
        target = round(sum(sizes.values()) * share)
        df = spark.createDataFrame([(g, n) for g, n in sizes.items()], "row_id long, n int").select("row_id", F.explode(F.sequence(F.lit(1), "n")))
        got = {r["row_id"]: r["validation"] for r in S.group_split(df, "row_id", target, width=20_000 if case % 2 else 1).collect()}
        assert got == fold_of_groups(sizes, target)
    assert not any(r["validation"] for r in S.group_split(df, "row_id", 0).collect())
    assert S.group_split(df.limit(0), "row_id", 5).count() == 0


def test_mapping_in_byte_ranges(spark, tmp_path):
    """One object on one line or many, braces and quotes in strings, cut anywhere: entries are those of a JSON parser."""
    import json

    entries = {f'k{i} "}}{{' if i % 9 == 0 else f"k{i}": {"Hebrew": "}" * (i % 4) + '"\\' * (i % 3) + "\u05d0{", "English": "x" * (i * 7 % 50), "Images": ["a}.png", '"b"'] if i % 2 else "none"} for i in range(120)}
    whole = {"n": 5, "list": [{"a": {"b": "}"}}, "]{"], **entries, "tail": [{"z": 1}], "s": "}"}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text(json.dumps(whole), encoding="utf-8")
    (tmp_path / "m" / "b.json").write_text(json.dumps({"other": {"Hebrew": "h"}, "empty": {}}, indent=2) + "\n\n", encoding="utf-8")
    (tmp_path / "m" / "c.json").write_text('{"k": {"Hebrew": "old"}, "gone": {"Hebrew": "x"}, "k": {"Hebrew": "new"}, "gone": 5}', encoding="utf-8")
    (tmp_path / "m" / "d.json").write_text("{}")
    want = {k: (v.get("Hebrew"), v["Images"] if isinstance(v.get("Images"), list) else []) for k, v in {**entries, "other": {"Hebrew": "h"}, "empty": {}, "k": {"Hebrew": "new"}}.items()}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "1000", "97"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert size == "128m" or spark.read.option("lineSep", "}").text(str(tmp_path / "m")).rdd.getNumPartitions() > 8
            got = [(r["row_id"], (r["hebrew"], r["images"])) for r in io.read_mapping(spark, str(tmp_path / "m")).collect()]
            assert len(got) == len(want) and dict(got) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_joined_file_keeps_order_and_repeats(spark, tmp_path):
    import json

    rows = spark.range(500).repartition(7).select((F.col("id") % 250).alias("k"), F.concat(F.lit('{"i":'), (F.col("id") % 250).cast("string"), F.lit("}")).alias("value"))
    io.write_joined([('{"a":[', rows), ('],"b":[', rows.limit(0)), ('],"c":[', rows.filter("k < 1"))], "]}", str(tmp_path / "j"))
    files = list((tmp_path / "j").glob("part-*"))
    got = json.loads(files[0].read_text())
    assert len(files) == 1 and [x["i"] for x in got["a"]] == sorted(i % 250 for i in range(500)) and got["b"] == [] and got["c"] == [{"i": 0}, {"i": 0}]
