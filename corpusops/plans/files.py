"""Sources and sinks, written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as T
from ..sources import io
from .columns import NAMES_SQL
from .fixtures import Inputs
from .fixtures import with_views as W
from .registry import Registry

R = Registry()
MANIFEST = "uid LONG, row_id LONG, split STRING, source STRING, lang STRING, text STRING, width LONG, height LONG"


@R("scan_manifest", W("v_manifest", rest="SELECT uid, row_id, split, source, lang, text, width, height FROM v_manifest"))
def scan_manifest(t: Inputs):
    path = io.write_jsonl(t.view("v_manifest"), io.scratch(t.spark, "manifest"))
    return io.read_jsonl(t.spark, path, MANIFEST)


@R("scan_manifest_lenient", "SELECT event_id AS uid, event_type AS kind FROM events WHERE event_id % 7 <> 0")
def scan_manifest_lenient(t: Inputs):
    line = F.to_json(F.struct(F.col("event_id").alias("uid"), F.col("event_type").alias("kind")))
    path = io.scratch(t.spark, "lenient")
    t.table("events").select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 8)).otherwise(line).alias("value")).write.text(path)
    return io.read_jsonl_lenient(t.spark, path, "uid LONG, kind STRING")


@R("scan_csv_metadata", "SELECT CAST(c_custkey AS VARCHAR) AS \"ID\", c_name, c_mktsegment FROM customer")
def scan_csv_metadata(t: Inputs):
    path = io.write_csv(t.table("customer").select(F.col("c_custkey").alias("ID"), "c_name", "c_mktsegment"), io.scratch(t.spark, "meta"))
    return io.read_metadata_csv(t.spark, path)


@R("scan_results_csv", "SELECT CAST(event_id AS VARCHAR) AS run, event_type AS regime, value AS metric FROM events")
def scan_results_csv(t: Inputs):
    path = io.write_csv(t.table("events").select(F.col("event_id").alias("run"), F.col("event_type").alias("regime"), F.col("value").alias("metric")), io.scratch(t.spark, "results"))
    return io.read_csv(t.spark, path).withColumn("metric", F.col("metric").try_cast("double"))


@R("scan_mapping_json", "SELECT CAST(n_nationkey AS VARCHAR) AS row_id, n_name AS hebrew, lower(n_name) AS english, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 2 END AS n_images FROM nation")
def scan_mapping_json(t: Inputs):
    images = F.when(F.col("n_nationkey") % 3 == 0, F.lit("none")).otherwise(F.lit('["a.png","b.png"]'))
    entry = F.concat(F.lit('"'), "n_nationkey", F.lit('":{"Hebrew":"'), "n_name", F.lit('","English":"'), F.lower("n_name"), F.lit('","Images":'), F.when(F.col("n_nationkey") % 3 == 0, F.lit('"none"')).otherwise(images), F.lit("}"))
    path = io.scratch(t.spark, "mapping")
    io.write_joined([('{"skip":3,', t.table("nation").select(F.col("n_nationkey").alias("k"), entry.alias("value")))], "}", path)
    return io.read_mapping(t.spark, path).select("row_id", "hebrew", "english", F.size("images").alias("n_images"))


@R("scan_binary")
def scan_binary(t: Inputs):
    """Every file of the tables' folder; none of them is an image."""
    return io.read_binary(t.spark, t.sf_dir).select("name", "size", "sha256", "format", "width", "height", "error")


def _image(kind: str, w, h):
    """Bytes of an image of some format whose header says w times h."""
    b = lambda n, digits: F.lpad(F.hex(n.cast("long")), digits, "0")
    le = lambda n, k: F.concat(*[F.substring(b(n, 2 * k), 2 * i + 1, 2) for i in reversed(range(k))])
    x = F.lit
    return F.unhex({
        "png": F.concat(x("89504E470D0A1A0A0000000D49484452"), b(w, 8), b(h, 8), x("0802000000000000000000000049454E44AE426082")),
        "jpeg": F.concat(x("FFD8FFE000084A46494600FFFFFFFE0004ABCDFFC0000B08"), b(h, 4), b(w, 4), x("0101110000FFDA0000FFD9")),
        "gif": F.concat(x("474946383961"), le(w, 2), le(h, 2), x("0000003B")),
        "bmp": F.concat(x("424D1A0000000000000000000000"), x("0C000000"), le(w, 4), le(h, 4)),
        "tiff": F.concat(x("49492A000800000002000001040001000000"), le(w, 4), x("0101030001000000"), le(h, 2), x("000000000000")),
        "webp": F.concat(x("524946461600000057454250565038580A00000000000000"), le(w - 1, 3), le(h - 1, 3)),
    }[kind])


KINDS = ("png", "jpeg", "gif", "bmp", "tiff", "webp")


@R("image_headers", "WITH c AS (SELECT c_custkey AS uid, ['png', 'jpeg', 'gif', 'bmp', 'tiff', 'webp'][c_custkey % 6 + 1] AS kind, 1 + c_custkey * 37 % 900 AS w, 1 + c_custkey * 91 % 700 AS h FROM customer), d AS (SELECT *, CASE WHEN uid % 5 = 1 THEN 'short' WHEN uid % 5 = 2 AND kind IN ('png', 'jpeg', 'gif', 'webp') THEN 'cut' WHEN uid % 5 = 3 THEN 'none' WHEN uid % 55 = 4 THEN 'empty' ELSE 'fine' END AS state FROM c) SELECT uid, CASE WHEN state NOT IN ('none', 'empty') THEN kind END AS format, CAST(CASE WHEN state IN ('fine', 'cut') THEN w END AS INTEGER) AS width, CAST(CASE WHEN state IN ('fine', 'cut') THEN h END AS INTEGER) AS height, CASE state WHEN 'short' THEN kind || ': header is cut off or damaged' WHEN 'cut' THEN kind || ': file is cut off' WHEN 'none' THEN 'no image of a known format' WHEN 'empty' THEN 'empty file' END AS error FROM d")
def image_headers(t: Inputs):
    """Sizes and defects of image bytes of six formats, made from the customers: whole, cut off, damaged, other, empty."""
    from ..functions.images import header

    uid = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (uid % 6 + 1).cast("int"))
    w, h = 1 + uid * 37 % 900, 1 + uid * 91 % 700
    whole = F.lit(None).cast("binary")
    for k in KINDS:
        whole = F.when(kind == k, _image(k, w, h)).otherwise(whole)
    some = lambda n: F.substring(F.col("whole"), F.lit(1), n.cast("int"))
    short = F.when(kind == "png", 20).when(kind == "jpeg", 24).when(kind == "gif", 7).when(kind == "bmp", 20).when(kind == "tiff", 16).otherwise(26)
    cut = (uid % 5 == 2) & kind.isin("png", "jpeg", "gif", "webp")
    content = F.when(uid % 5 == 1, some(short)).when(cut & (kind == "webp"), F.concat(F.unhex(F.lit("52494646FF00000057454250")), F.substring(F.col("whole"), 13, 99))).when(cut, some(F.length("whole") - 1)).when(uid % 5 == 3, F.encode(F.concat(F.lit("text "), "c_name"), "UTF-8")).when(uid % 55 == 4, F.lit("").cast("binary")).otherwise(F.col("whole"))
    rows = t.table("customer").withColumn("whole", whole).select(uid.alias("uid"), content.alias("content"))
    return rows.select("uid", header(F.col("content")).alias("h")).select("uid", "h.format", "h.width", "h.height", "h.error")


@R("scan_archive_listing", "SELECT url AS path FROM pages WHERE url LIKE '%1' ORDER BY length(url), url LIMIT 1")
def scan_archive_listing(t: Inputs):
    return io.find_in_archive(t.table("pages").select(F.col("url").alias("path")), "1")


@R("scan_lexicon", "SELECT trim(p_name) AS word FROM part WHERE p_partkey % 5 <> 0 AND trim(p_name) <> ''")
def scan_lexicon(t: Inputs):
    path = io.scratch(t.spark, "lexicon")
    t.table("part").select(F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("# "), "p_name")).otherwise(F.concat(F.lit("  "), "p_name")).alias("value")).write.text(path)
    return io.read_lexicon(t.spark, path)


@R("scan_run_dirs", "SELECT event_type AS run_id, count(*) AS epochs, max(value) AS best, CASE WHEN event_type NOT LIKE 'view%' THEN min(event_id) END AS first, CASE WHEN event_type LIKE 'c%' THEN max(user_id) END AS last_user FROM events GROUP BY event_type")
def scan_run_dirs(t: Inputs):
    """Run folders with metadata, and with detector and phase files where a run has them."""
    runs = t.table("events").groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("epochs"), F.max("value").alias("best"), F.min("event_id").alias("first"), F.max("user_id").alias("last_user"))
    some = {"run_metadata.json": (["epochs", "best"], F.lit(True)), "metrics_detector.json": (["first"], ~F.startswith("run", F.lit("view"))), "metrics_best.json": (["last_user"], F.startswith("run", F.lit("c")))}
    path = io.scratch(t.spark, "runs")
    for name, (fields, has) in some.items():
        runs.filter(has).select("run", F.lit(name).alias("file"), F.to_json(F.struct(*fields)).alias("value")).write.mode("append").partitionBy("run", "file").text(path)
    r = io.read_run_dirs(t.spark, path, {"run_metadata.json": "epochs LONG, best DOUBLE", "metrics_detector.json": "first LONG", "metrics_best.json": "last_user LONG"})
    return r.select("run_id", "run_metadata.epochs", "run_metadata.best", "metrics_detector.first", "metrics_best.last_user")


SIZES = W("v_boxes_gt", rest="SELECT uid, idx, cls, x1, y1, x2, y2 FROM v_boxes_gt")
PCT = "x1 / 500 * 100 AS x, y1 / 400 * 100 AS y, (x2 - x1) / 500 * 100 AS width, (y2 - y1) / 400 * 100 AS height"


def _labelled(t: Inputs):
    return t.view("v_boxes_gt").withColumn("label", F.concat(F.lit("c"), "cls"))


def _sizes(t: Inputs):
    return t.table("orders").select(F.col("o_orderkey").alias("uid"), F.lit(500).alias("width"), F.lit(400).alias("height")).distinct()


@R("scan_labelstudio", W("v_boxes_gt", rest=f"SELECT CAST(uid AS VARCHAR) AS uid, 'c' || CAST(cls AS VARCHAR) AS label, round(x1 / 500 * 100, 4) AS x, round(y1 / 400 * 100, 4) AS y, round((x2 - x1) / 500 * 100, 4) AS width, round((y2 - y1) / 400 * 100, 4) AS height FROM v_boxes_gt WHERE uid IN (SELECT o_orderkey FROM orders)"))
def scan_labelstudio(t: Inputs):
    path = io.scratch(t.spark, "tasks")
    io.label_studio_tasks(_labelled(t), _sizes(t)).write.text(path)
    return io.read_label_studio(t.spark, path).select("uid", "label", *[F.round(c, 4).alias(c) for c in ("x", "y", "width", "height")])


@R("scan_coco", W("v_boxes_gt", rest="SELECT o_orderkey AS uid, count(b.uid) AS n, coalesce(round(sum(x2), 4), 0) AS x2 FROM orders LEFT JOIN v_boxes_gt b ON b.uid = o_orderkey GROUP BY o_orderkey"))
def scan_coco(t: Inputs):
    images = t.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("uid")).distinct()
    marks = t.view("v_boxes_gt").select(F.col("uid").alias("image_id"), F.col("cls").alias("category_id"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"))
    kinds = t.view("v_boxes_gt").select(F.col("cls").alias("id")).distinct().filter("id < 20").withColumn("name", F.concat(F.lit("c"), "id"))
    path = io.write_jsonl(marks, io.scratch(t.spark, "coco"))
    out = io.read_coco(images, io.read_jsonl(t.spark, path, "image_id LONG, category_id LONG, bbox ARRAY<DOUBLE>"), kinds)
    return out.select("uid", F.size("boxes").cast("long").alias("n"), F.round(F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b["x2"]), 4).alias("x2"))


YOLO = "least(greatest((x1 + x2) / 2 / 500, 0), 1) AS cx, least(greatest((y1 + y2) / 2 / 400, 0), 1) AS cy, least(greatest((x2 - x1) / 500, 0), 1) AS w, least(greatest((y2 - y1) / 400, 0), 1) AS h"


@R("scan_yolo_labels", W("v_boxes_gt", rest=f", y AS (SELECT cls, {YOLO} FROM v_boxes_gt WHERE idx <> 3) SELECT CAST(cls AS INTEGER) AS cls, CAST(printf('%.6f', CAST(cx AS DOUBLE)) AS DOUBLE) AS cx, CAST(printf('%.6f', CAST(cy AS DOUBLE)) AS DOUBLE) AS cy, CAST(printf('%.6f', CAST(w AS DOUBLE)) AS DOUBLE) AS w, CAST(printf('%.6f', CAST(h AS DOUBLE)) AS DOUBLE) AS h FROM y"))
def scan_yolo_labels(t: Inputs):
    b = B.to_yolo(F.struct("x1", "y1", "x2", "y2"), F.lit(500), F.lit(400))
    lines = t.view("v_boxes_gt").select(F.when(F.col("idx") == 3, "short line here 1").otherwise(io.yolo_line(F.col("cls"), b)).alias("value"))
    path = io.scratch(t.spark, "yolo")
    lines.write.text(path)
    return io.read_yolo(t.spark, path).select("cls", "cx", "cy", "w", "h")


@R("sink_jsonl", "SELECT doc_id AS uid, text FROM documents")
def sink_jsonl(t: Inputs):
    path = io.write_jsonl(t.table("documents").select(F.col("doc_id").alias("uid"), "text"), io.scratch(t.spark, "jsonl"))
    return io.read_jsonl(t.spark, path, "uid LONG, text STRING")


@R("sink_manifest_csv", W("v_manifest", rest="SELECT CAST(uid AS VARCHAR) AS uid, split, CAST(width AS VARCHAR) AS image_width, lang AS meta_lang FROM v_manifest"))
def sink_manifest_csv(t: Inputs):
    nested = t.view("v_manifest").select("uid", "split", F.struct("width", "height").alias("image"), F.struct("lang").alias("meta"))
    flat = io.flat_manifest(nested, {"uid": "uid", "split": "split", "image_width": "image.width", "meta_lang": "meta.lang"})
    return io.read_csv(t.spark, io.write_csv(flat, io.scratch(t.spark, "csv")))


SPLIT = "CASE WHEN uid % 10 < 7 THEN 'train' ELSE 'validation' END"


@R("sink_yolo_labels", W("v_boxes_gt", rest=f", y AS (SELECT {SPLIT} AS split, uid, idx, cls, {YOLO} FROM v_boxes_gt) SELECT split, CAST(uid AS VARCHAR) AS uid, idx AS line_no, CAST(cls AS INTEGER) AS cls, CAST(printf('%.6f', CAST(cx AS DOUBLE)) AS DOUBLE) AS cx, CAST(printf('%.6f', CAST(cy AS DOUBLE)) AS DOUBLE) AS cy, CAST(printf('%.6f', CAST(w AS DOUBLE)) AS DOUBLE) AS w, CAST(printf('%.6f', CAST(h AS DOUBLE)) AS DOUBLE) AS h FROM y"))
def sink_yolo_labels(t: Inputs):
    b = B.to_yolo(F.struct("x1", "y1", "x2", "y2"), F.lit(500), F.lit(400))
    rows = t.view("v_boxes_gt").select("uid", "idx", "cls", F.when(F.col("uid") % 10 < 7, "train").otherwise("validation").alias("split"), b.alias("box"))
    path = io.write_yolo(rows, io.scratch(t.spark, "yolo-sink"))
    return io.read_yolo_packed(t.spark, path).select("split", "uid", F.col("line_no").cast("long").alias("line_no"), "cls", "cx", "cy", "w", "h")


@R("sink_coco", W("v_boxes_pred", rest="SELECT row_number() OVER (ORDER BY uid, idx) AS id, uid AS image_id, cls AS category_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS area, score FROM v_boxes_pred WHERE cls < 20 AND uid IN (SELECT o_orderkey FROM orders)"))
def sink_coco(t: Inputs):
    images = t.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("uid")).distinct()
    boxes = t.view("v_boxes_pred").withColumn("label", F.concat(F.lit("c"), "cls"))
    kinds = t.view("v_boxes_gt").select(F.col("cls").alias("id")).distinct().filter("id < 20").withColumn("name", F.concat(F.lit("c"), "id"))
    # there are at most 20 kinds: broadcast, so that boxes stay dealt by uid
    path = io.write_coco(images, io.coco_annotations(boxes, images, F.broadcast(kinds)), kinds, io.scratch(t.spark, "coco-sink"))
    back = io.read_jsonl(t.spark, f"{path}/annotations", "id LONG, image_id LONG, category_id LONG, bbox ARRAY<DOUBLE>, area DOUBLE, score DOUBLE")
    return back.select("id", "image_id", "category_id", *[F.col("bbox")[i].alias(c) for i, c in enumerate("xywh")], "area", "score")


@R("sink_labelstudio", W("v_boxes_gt", rest="SELECT uid, CAST(uid AS VARCHAR) || '_' || CAST(idx AS VARCHAR) AS id, 'img/' || CAST(uid AS VARCHAR) AS image, 'model' AS model_version, 'c' || CAST(cls AS VARCHAR) AS label, round(x1 / 500 * 100, 4) AS x, round(y1 / 400 * 100, 4) AS y, round((x2 - x1) / 500 * 100, 4) AS width, round((y2 - y1) / 400 * 100, 4) AS height FROM v_boxes_gt WHERE uid IN (SELECT o_orderkey FROM orders)"))
def sink_labelstudio(t: Inputs):
    path = io.scratch(t.spark, "tasks-sink")
    io.label_studio_tasks(_labelled(t), _sizes(t)).write.text(path)
    kind = "data STRUCT<image:STRING,uid:STRING>, predictions ARRAY<STRUCT<model_version:STRING,result:ARRAY<STRUCT<id:STRING,type:STRING,value:STRUCT<x:DOUBLE,y:DOUBLE,width:DOUBLE,height:DOUBLE,rectanglelabels:ARRAY<STRING>>>>>>"
    p = io.read_jsonl(t.spark, path, kind).select("data", F.explode("predictions").alias("p"))
    r = p.select(F.col("data.uid").cast("long").alias("uid"), "data.image", "p.model_version", F.explode("p.result").alias("r"))
    return r.select("uid", "r.id", "image", "model_version", F.col("r.value.rectanglelabels")[0].alias("label"), *[F.round(f"r.value.{c}", 4).alias(c) for c in ("x", "y", "width", "height")])


@R("sink_class_index", W("v_boxes_gt", rest=f", c AS (SELECT {SPLIT} AS split, uid, idx, cls, x1, y1, x2, y2, {NAMES_SQL}[cls + 1] AS class FROM v_boxes_gt WHERE cls < 20 AND uid % 10 < 7) SELECT split, class, substr(class, -1) AS letter, CAST(uid AS VARCHAR) AS uid, CAST(idx AS VARCHAR) AS idx, 'img/' || CAST(uid AS VARCHAR) AS src, printf('%d,%d,%d,%d', CAST(x1 AS INTEGER), CAST(y1 AS INTEGER), CAST(x2 AS INTEGER), CAST(y2 AS INTEGER)) AS bbox, split || '/' || class || '/' || CAST(uid AS VARCHAR) || '_' || printf('%03d', CAST(idx AS INTEGER)) || '.png' AS out_path FROM c"))
def sink_class_index(t: Inputs):
    """The crop index of the train split as CSV; two letters are not among the known ones."""
    letter = F.substring(F.lit(T.LETTERS), F.col("cls").cast("int") + 1, F.lit(1))
    rows = t.view("v_boxes_gt").withColumn("split", F.when(F.col("uid") % 10 < 7, "train").otherwise("validation")).withColumn("letter", letter).withColumn("src", F.concat(F.lit("img/"), F.col("uid").cast("string")))
    path = io.write_csv(io.class_index(rows, list(T.LETTERS[:20]), "Train"), io.scratch(t.spark, "classes"))
    return io.read_csv(t.spark, path)


@R("sink_report_json", "SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents")
def sink_report_json(t: Inputs):
    path = io.write_jsonl(t.table("documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).coalesce(1), io.scratch(t.spark, "report"))
    return io.read_jsonl(t.spark, path, "n LONG, chars LONG")


@R("append_manifest", "SELECT doc_id AS uid, source FROM documents UNION ALL SELECT page_id, url FROM pages")
def append_manifest(t: Inputs):
    path = io.scratch(t.spark, "append")
    io.write_jsonl(t.table("documents").select(F.col("doc_id").alias("uid"), "source"), path)
    io.write_jsonl(t.table("pages").select(F.col("page_id").alias("uid"), F.col("url").alias("source")), path, "append")
    return io.read_jsonl(t.spark, path, "uid LONG, source STRING")


@R("sink_result_tables", "WITH e AS (SELECT event_type AS model, count(*) AS n, count(DISTINCT user_id) AS u, min(event_id) AS f FROM events GROUP BY 1) SELECT 'table_detector' AS \"table\", model AS key, CAST(n AS VARCHAR) AS value FROM e UNION ALL SELECT 'table_classifier', model, CAST(u AS VARCHAR) FROM e UNION ALL SELECT 'ocr_baselines', model, CAST(f AS VARCHAR) FROM e UNION ALL SELECT 'summary', 'source', 'events' UNION ALL SELECT 'summary', k, CAST(count(*) AS VARCHAR) FROM e, (VALUES ('table_detector_rows'), ('table_classifier_rows'), ('ocr_baselines_rows')) v(k) GROUP BY k")
def sink_result_tables(t: Inputs):
    by = t.table("events").groupBy(F.col("event_type").alias("model"))
    tables = {"table_detector": by.agg(F.count("*").alias("value")), "table_classifier": by.agg(F.countDistinct("user_id").alias("value")), "ocr_baselines": by.agg(F.min("event_id").alias("value"))}
    path = io.write_result_tables(tables, {"source": "events"}, t.spark, io.scratch(t.spark, "tables"))
    out = io.read_jsonl(t.spark, f"{path}/run_summary.json", "key STRING, value STRING").select(F.lit("summary").alias("table"), "key", "value")
    for name in tables:
        out = out.unionByName(io.read_csv(t.spark, f"{path}/{name}").select(F.lit(name).alias("table"), F.col("model").alias("key"), "value"))
    return out