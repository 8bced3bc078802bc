"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as T
from ..functions import vectors as V
from ..operators import manifest as M
from .fixtures import Inputs
from .fixtures import with_views as W
from .registry import Registry

R = Registry()


def _box():
    return F.struct("x1", "y1", "x2", "y2")


@R("text_variants", r"SELECT doc_id, md5(text) AS raw, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS stripped, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed_ws, md5(regexp_replace(text, '\s+', '', 'g')) AS no_space, md5(trim(regexp_replace(replace(replace(text, '[', ''), ']', ''), '\s+', ' ', 'g'))) AS no_brackets FROM documents")
def text_variants(t: Inputs):
    v = t.table("documents").select("doc_id", T.text_variants(F.col("text")).alias("v"))
    return v.select("doc_id", *[F.md5(F.col(f"v.{c}").cast("binary")).alias(c) for c in ("raw", "stripped", "collapsed_ws", "no_space", "no_brackets")])


@R("collapse_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
def collapse_text(t: Inputs):
    return t.table("documents").select("doc_id", F.md5(T.blanks(F.col("text")).cast("binary")).alias("h"))


@R("script_ratio", "SELECT doc_id, round(len(regexp_extract_all(text, '[a-z]')) / CAST(greatest(1, length(text)) AS DOUBLE), 6) AS ratio FROM documents")
def script_ratio(t: Inputs):
    return t.table("documents").select("doc_id", F.round(T.script_ratio(F.col("text"), "a-z"), 6).alias("ratio"))


@R("normalize_script", r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(p_name, '[xq]', '', 'g'), 'y', 'i'), 'w', 'v'), '[^a-v\n ]', ' ', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS name FROM part")
def normalize_script(t: Inputs):
    return t.table("part").select("p_partkey", T.normalize_script(F.col("p_name"), "a-v", "yw", "iv", "xq").alias("name"))


@R("apply_final_forms", "SELECT p_partkey, regexp_replace(regexp_replace(p_name, '([a-z]{1})e([^a-z]|$)', '\\1E\\2', 'g'), '([a-z]{1})n([^a-z]|$)', '\\1N\\2', 'g') AS name FROM part")
def apply_final_forms(t: Inputs):
    return t.table("part").select("p_partkey", T.apply_final_forms(F.col("p_name"), 2, "en", "EN", "a-z").alias("name"))


@R("normalize_letter", "SELECT p_partkey, CASE WHEN translate(substr(p_name, 1, 1), 'yw', 'iv') IN ('a','b','c','i','v','s') THEN translate(substr(p_name, 1, 1), 'yw', 'iv') END AS letter FROM part")
def normalize_letter(t: Inputs):
    return t.table("part").select("p_partkey", T.normalize_letter(F.substring("p_name", 1, 1), "abcivs", "yw", "iv").alias("letter"))


NAMES_SQL = "[" + ", ".join(f"'{k:02d}_{n}_{c}'" for k, (c, n) in enumerate(zip(T.LETTERS, T.NAMES), 1)) + "]"


@R("class_name_map", W("v_boxes_gt", rest=f"SELECT uid, idx, {NAMES_SQL}[cls + 1] AS name FROM v_boxes_gt"))
def class_name_map(t: Inputs):
    letter = F.substring(F.lit(T.LETTERS), F.col("cls").cast("int") + 1, F.lit(1))
    return t.view("v_boxes_gt").select("uid", "idx", T.class_name(letter).alias("name"))


@R("safe_stem", "SELECT page_id, substr(regexp_replace(url, '[^0-9A-Za-z_.-]+', '_', 'g'), 1, 180) AS stem FROM pages")
def safe_stem(t: Inputs):
    return t.table("pages").select("page_id", T.safe_stem(F.col("url")).alias("stem"))


@R("uid_key", "SELECT page_id, substr(md5(url), 1, 8) || '_' || CAST(page_id AS VARCHAR) AS key FROM pages")
def uid_key(t: Inputs):
    return t.table("pages").select("page_id", T.uid_key(F.col("url"), F.col("page_id")).alias("key"))


@R("normalize_manifest", "SELECT doc_id AS uid, md5(text) AS gt_text, CASE WHEN doc_id % 3 = 0 THEN 'abs/' ELSE 'rel/' END || CAST(doc_id AS VARCHAR) AS image_path FROM documents")
def normalize_manifest(t: Inputs):
    d = t.table("documents")
    name = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("abs/"), F.col("doc_id").cast("string")).alias("abs_path"), F.lit("x").alias("rel_path")))).otherwise(F.to_json(F.struct(F.concat(F.lit("rel/"), F.col("doc_id").cast("string")).alias("rel_path"))))
    gt = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.to_json(F.struct(F.col("text").alias("raw"))))
    return M.normalize_manifest(d.select(F.col("doc_id").alias("uid"), gt.alias("gt"), name.alias("image"))).select("uid", F.md5(F.col("gt_text").cast("binary")).alias("gt_text"), "image_path")


@R("resolve_image_path", "SELECT doc_id AS uid, CASE WHEN doc_id IN (SELECT page_id FROM pages) THEN 'a' || CAST(doc_id AS VARCHAR) WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'b' || CAST(doc_id AS VARCHAR) END AS resolved FROM documents")
def resolve_image_path(t: Inputs):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    listing = t.table("pages").select(name("a", "page_id").alias("path")).unionAll(t.table("labels").select(name("b", "doc_id")))
    rows = t.table("documents").select(F.col("doc_id").alias("uid"), name("a", "doc_id").alias("p1"), name("b", "doc_id").alias("p2"))
    return M.resolve_path(rows, listing, ["p1", "p2"])


@R("nested_get", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def nested_get(t: Inputs):
    return t.table("events").select("event_id", F.from_json("props", "k STRING").alias("p")).select("event_id", F.col("p.k").alias("k"))


@R("filter_split", W("v_manifest", rest="SELECT uid, split FROM v_manifest WHERE lower(split) = 'validation'"))
def filter_split(t: Inputs):
    return M.filter_split(t.view("v_manifest"), "VALIDATION").select("uid", "split")


@R("filter_missing", "SELECT doc_id AS uid FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def filter_missing(t: Inputs):
    rows = M.mark_exists(t.table("documents").select("doc_id"), t.table("labels"), "doc_id")
    return M.filter_missing(rows).select(F.col("doc_id").alias("uid"))


@R("yolo_box", W("v_boxes_gt", rest="SELECT uid, idx, round(least(greatest((x1 + x2) / 2 / 400, 0), 1), 6) AS cx, round(least(greatest((y1 + y2) / 2 / 300, 0), 1), 6) AS cy, round(least(greatest((x2 - x1) / 400, 0), 1), 6) AS w, round(least(greatest((y2 - y1) / 300, 0), 1), 6) AS h FROM v_boxes_gt"))
def yolo_box(t: Inputs):
    y = t.view("v_boxes_gt").select("uid", "idx", B.to_yolo(_box(), F.lit(400), F.lit(300)).alias("y"))
    return y.select("uid", "idx", *[F.round(f"y.{c}", 6).alias(c) for c in ("cx", "cy", "w", "h")])


@R("box_from_pct", W("v_boxes_gt", rest="SELECT uid, idx, CASE WHEN idx % 3 > 0 THEN round(x1 / 100 * 640, 6) END AS x1, CASE WHEN idx % 3 > 0 THEN round(y1 / 100 * 480, 6) END AS y1, CASE WHEN idx % 3 > 0 THEN round((x1 + x2) / 100 * 640, 6) END AS x2, CASE WHEN idx % 3 > 0 THEN round((y1 + y2) / 100 * 480, 6) END AS y2 FROM v_boxes_gt"))
def box_from_pct(t: Inputs):
    w = F.when(F.col("idx") % 3 > 0, 640)
    b = t.view("v_boxes_gt").select("uid", "idx", B.from_pct(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), w, F.lit(480)).alias("b"))
    return b.select("uid", "idx", *[F.round(f"b.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@R("box_from_yolo", W("v_boxes_gt", rest="SELECT uid, idx, round((x1 / 500 - x2 / 1000) * 640, 6) AS x1, round((y1 / 500 - y2 / 1000) * 480, 6) AS y1, round((x1 / 500 + x2 / 1000) * 640, 6) AS x2, round((y1 / 500 + y2 / 1000) * 480, 6) AS y2 FROM v_boxes_gt"))
def box_from_yolo(t: Inputs):
    c = F.col
    b = t.view("v_boxes_gt").select("uid", "idx", B.from_yolo(c("x1") / 500, c("y1") / 500, c("x2") / 500, c("y2") / 500, F.lit(640), F.lit(480)).alias("b"))
    return b.select("uid", "idx", *[F.round(f"b.{k}", 6).alias(k) for k in ("x1", "y1", "x2", "y2")])


@R("clamp_box", W("v_boxes_gt", rest=", c AS (SELECT uid, idx, x1, y1, x2, y2, least(greatest(round_even(x1 - 20, 0), 0), 199) AS a, least(greatest(round_even(y1, 0), 0), 149) AS b FROM v_boxes_gt) SELECT uid, idx, a AS x1, b AS y1, least(greatest(round_even(x2 - 20, 0), a + 1), 200) AS x2, least(greatest(round_even(y2, 0), b + 1), 150) AS y2 FROM c"))
def clamp_box(t: Inputs):
    moved = F.struct((F.col("x1") - 20).alias("x1"), F.col("y1"), (F.col("x2") - 20).alias("x2"), F.col("y2"))
    return t.view("v_boxes_gt").select("uid", "idx", B.clamp_box(moved, F.lit(200), F.lit(150)).alias("b")).select("uid", "idx", "b.x1", "b.y1", "b.x2", "b.y2")


@R("pad_crop_square", W("v_boxes_gt", rest=", s AS (SELECT uid, idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(x2 - x1, y2 - y1) AS m FROM v_boxes_gt) SELECT uid, idx, round(cx - (m / 2 + round_even(m * 0.125, 0)), 6) AS x1, round(cy - (m / 2 + round_even(m * 0.125, 0)), 6) AS y1, round(cx + (m / 2 + round_even(m * 0.125, 0)), 6) AS x2, round(cy + (m / 2 + round_even(m * 0.125, 0)), 6) AS y2 FROM s"))
def pad_crop_square(t: Inputs):
    b = t.view("v_boxes_gt").select("uid", "idx", B.pad_square(_box(), 0.125).alias("b"))
    return b.select("uid", "idx", *[F.round(f"b.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


CROP = "greatest(CAST(trunc(x1 - (x2 - x1) * 0.25) AS INTEGER), 0) AS a, greatest(CAST(trunc(y1 - (y2 - y1) * 0.25) AS INTEGER), 0) AS b, least(CAST(trunc(x2 + (x2 - x1) * 0.25) AS INTEGER), 300) AS c, least(CAST(trunc(y2 + (y2 - y1) * 0.25) AS INTEGER), 200) AS d"


@R("crop_box", W("v_boxes_gt", rest=f", k AS (SELECT uid, idx, {CROP} FROM v_boxes_gt) SELECT uid, idx, CAST(a AS DOUBLE) AS x1, CAST(b AS DOUBLE) AS y1, CAST(c AS DOUBLE) AS x2, CAST(d AS DOUBLE) AS y2 FROM k WHERE c > a AND d > b"))
def crop_box(t: Inputs):
    return t.view("v_boxes_gt").select("uid", "idx", B.crop_box(_box(), 0.25, F.lit(300), F.lit(200)).alias("b")).filter("b IS NOT NULL").select("uid", "idx", "b.x1", "b.y1", "b.x2", "b.y2")


IOU = "CASE WHEN (ga + pa - iw * ih) > 0 THEN iw * ih / (ga + pa - iw * ih) ELSE 0 END"
JOINED = ", j AS (SELECT g.uid, g.idx AS gt_idx, p.idx AS pred_idx, p.score, (g.x2 - g.x1) * (g.y2 - g.y1) AS ga, (p.x2 - p.x1) * (p.y2 - p.y1) AS pa, greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) AS iw, greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0) AS ih, greatest(g.x2, p.x2) - least(g.x1, p.x1) AS ux FROM v_boxes_gt g JOIN v_boxes_pred p ON g.uid = p.uid)"


def _same_index(t: Inputs):
    g = t.view("v_boxes_gt").select("uid", "idx", _box().alias("a"))
    return g.join(t.view("v_boxes_pred").select("uid", "idx", "score", _box().alias("b")), ["uid", "idx"])


@R("box_iou", W("v_boxes_gt", "v_boxes_pred", rest=f"{JOINED} SELECT uid, gt_idx AS idx, round({IOU}, 6) AS iou FROM j WHERE gt_idx = pred_idx"))
def box_iou(t: Inputs):
    return _same_index(t).select("uid", "idx", F.round(B.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@R("axis_iou", W("v_boxes_gt", "v_boxes_pred", rest=f"{JOINED} SELECT uid, gt_idx AS idx, round(CASE WHEN ux > 0 THEN iw / ux ELSE 0 END, 6) AS iou FROM j WHERE gt_idx = pred_idx"))
def axis_iou(t: Inputs):
    return _same_index(t).select("uid", "idx", F.round(B.axis_iou(F.col("a"), F.col("b"), "x"), 6).alias("iou"))


@R("box_candidate_filter", W("v_boxes_gt", rest="SELECT uid, idx, round(least(1, (x2 - x1) * (y2 - y1) / 600), 6) AS score FROM v_boxes_gt WHERE (x2 - x1) * (y2 - y1) BETWEEN 600 AND 120000 * 0.01 AND x2 - x1 >= 20 AND y2 - y1 >= 3 AND (x2 - x1) / (y2 - y1) BETWEEN 0.5 AND 2"))
def box_candidate_filter(t: Inputs):
    ok = B.is_candidate(_box(), F.lit(400), F.lit(300), 600.0, 0.01, 3.0, (0.5, 2.0)) & (F.col("x2") - F.col("x1") >= 20)
    return t.view("v_boxes_gt").filter(ok).select("uid", "idx", F.round(F.least(F.lit(1.0), B.area(_box()) / 600), 6).alias("score"))


LOGITS = "WITH l AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS x FROM embeddings), e AS (SELECT vec_id, label, x, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM l), p AS (SELECT vec_id, label, x, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)"


def _logits(t: Inputs):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return t.table("embeddings").select("vec_id", F.col("label").alias("y_true"), x.alias("x")).withColumn("p", V.softmax(F.col("x")))


def _millionths(x):
    return F.array_join(F.transform(x, lambda v: F.round(v * 1000000).cast("long").cast("string")), ",")


#: Names of classes by number; components beyond them have none.
CLASSES = [chr(i) for i in range(0x4E00, 0x4E00 + 64)]


@R("softmax", f"{LOGITS} SELECT vec_id, array_to_string([CAST(CAST(round(v * 1000000) AS BIGINT) AS VARCHAR) FOR v IN p], ',') AS p FROM p")
def softmax(t: Inputs):
    return _logits(t).select("vec_id", _millionths(F.col("p")).alias("p"))


@R("pick_char", f"{LOGITS} SELECT vec_id, CASE WHEN list_max(p) < 0.02 OR list_position(p, list_max(p)) > 64 THEN '[?]' ELSE chr(CAST(19967 + list_position(p, list_max(p)) AS INTEGER)) END AS ch FROM p")
def pick_char(t: Inputs):
    return _logits(t).select("vec_id", V.pick_char(F.col("p"), F.array(*map(F.lit, CLASSES)), 0.02).alias("ch"))


@R("normalize_probs", "WITH l AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS x FROM embeddings) SELECT vec_id, array_to_string([CAST(CAST(round(CASE WHEN list_sum(x) > 0 THEN v / list_sum(x) ELSE 1.0 / len(x) END * 100) AS BIGINT) AS VARCHAR) FOR v IN x], ',') AS p FROM l WHERE abs(list_sum(x)) > 0.01")
def normalize_probs(t: Inputs):
    rows = _logits(t).withColumn("s", V.total(F.col("x"))).filter(F.abs("s") > 0.01)
    return rows.select("vec_id", F.array_join(F.transform(V.normalize(F.col("x")), lambda v: F.round(v * 100).cast("long").cast("string")), ",").alias("p"))


@R("topk_to_probs", "WITH l AS (SELECT vec_id, [CASE WHEN i % 3 = 0 THEN abs(CAST(embedding[i] AS DOUBLE)) ELSE 0.0 END FOR i IN range(1, len(embedding) + 1)] AS x FROM embeddings) SELECT vec_id, array_to_string([CAST(CAST(round(CASE WHEN list_sum(x) > 0 THEN v / list_sum(x) ELSE v END * 10000) AS BIGINT) AS VARCHAR) FOR v IN x], ',') AS p FROM l")
def topk_to_probs(t: Inputs):
    """Every third component as a sparse list of classes, back to a dense vector."""
    e = t.table("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).filter("(i + 1) % 3 = 0")
    topk = e.groupBy("vec_id").agg(F.collect_list(F.struct(F.format_string("c%d", "i").alias("label"), F.abs(F.col("v").cast("double")).alias("conf"))).alias("topk"))
    sized = t.table("embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.concat(F.lit("c"), i.cast("string"))).alias("classes"))
    rows = sized.join(topk, "vec_id")
    return rows.select("vec_id", F.array_join(F.transform(V.topk_to_probs(F.col("topk"), F.col("classes")), lambda v: F.round(v * 10000).cast("long").cast("string")), ",").alias("p"))


@R("align_classes", f"{LOGITS} SELECT vec_id, array_to_string([CAST(CAST(round(v * 1000000) AS BIGINT) AS VARCHAR) FOR v IN list_concat([0.0], list_reverse(p))], ',') AS p FROM p")
def align_classes(t: Inputs):
    """All classes in reverse order, after one that the model does not know."""
    names = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.concat(F.lit("c"), i.cast("string")))
    wanted = F.concat(F.array(F.lit("none")), F.reverse(names))
    return _logits(t).select("vec_id", _millionths(V.align_classes(F.col("p"), names, wanted)).alias("p"))


@R("join_tokens", "SELECT p_partkey, replace(replace(p_name, 'a', '?'), '?', '[?]') AS joined FROM part")
def join_tokens(t: Inputs):
    chars = F.filter(F.split(F.replace("p_name", F.lit("a"), F.lit("?")), ""), lambda c: c != "")
    return t.table("part").select("p_partkey", T.join_tokens(chars).alias("joined"))


@R("cleanup_text", r"SELECT p_partkey, trim(regexp_replace(replace(replace(replace(replace(replace(p_name, 'e', '[?]'), 'o', '/'), '[?][?]', '[?]'), '|', ' '), '/', ' '), '\s+', ' ', 'g')) AS clean FROM part")
def cleanup_text(t: Inputs):
    dirty = F.replace(F.replace("p_name", F.lit("e"), F.lit("[?]")), F.lit("o"), F.lit("/"))
    return t.table("part").select("p_partkey", T.cleanup_text(dirty).alias("clean"))


@R("postprocess_pred", W("v_pairs", rest="SELECT uid, CASE WHEN uid % 2 = 0 THEN reverse(trim(pred_text)) ELSE trim(pred_text) END AS pred_text FROM v_pairs"))
def postprocess_pred(t: Inputs):
    return t.view("v_pairs").select("uid", T.postprocess_pred(F.col("pred_text"), F.col("uid") % 2 == 0).alias("pred_text"))


@R("route_prompt", W("v_manifest", rest="SELECT uid, CASE WHEN lang = 'en' THEN 'plain' WHEN lang = 'fr' THEN CASE WHEN source = 'src1' THEN 'dense' ELSE 'plain' END WHEN width / 1000.0 >= 0.5 THEN 'dense' ELSE 'plain' END AS prompt FROM v_manifest"))
def route_prompt(t: Inputs):
    mode = F.when(F.col("lang") == "en", "fixed").when(F.col("lang") == "fr", "by_doc_kind").otherwise("auto")
    kind = F.when(F.col("source") == "src1", "dense").otherwise("other")
    return t.view("v_manifest").select("uid", T.route_prompt(mode, kind, F.col("width") / 1000, 0.5).alias("prompt"))


def _shard_sql(n: int) -> str:
    parts = [f"CAST('0x' || substr(m, {1 + 8 * i}, 8) AS BIGINT)" for i in range(4)]
    r = "0"
    for p in parts:
        r = f"(({r} * 4294967296 + {p}) % {n})"
    return r


@R("shard_of", f"WITH d AS (SELECT doc_id AS uid, md5(CAST(doc_id AS VARCHAR)) AS m FROM documents) SELECT uid, CAST({_shard_sql(7)} AS INTEGER) AS shard FROM d")
def shard_of(t: Inputs):
    return t.table("documents").select(F.col("doc_id").alias("uid"), T.shard_of(F.col("doc_id"), 7).alias("shard"))


@R("stable_seed", "WITH d AS (SELECT doc_id AS uid, md5(CAST(doc_id AS VARCHAR)) AS m FROM documents) SELECT uid, CAST(CAST('0x' || substr(m, 1, 2) AS BIGINT) % 5 AS INTEGER) AS style, CAST('0x' || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2) AS BIGINT) + 42 AS seed FROM d")
def stable_seed(t: Inputs):
    return t.table("documents").select(F.col("doc_id").alias("uid"), T.style_index(F.col("doc_id"), 5).alias("style"), T.stable_seed(F.col("doc_id"), 42).alias("seed"))


@R("curriculum_fraction", W("v_epochs", rest="SELECT run_id, epoch, round(0.9 + (0.1 - 0.9) * least(epoch, 9) / 9.0, 6) AS fraction FROM v_epochs"))
def curriculum_fraction(t: Inputs):
    return t.view("v_epochs").select("run_id", "epoch", F.round(T.curriculum_fraction(F.col("epoch"), 10, 0.9, 0.1), 6).alias("fraction"))


@R("canonical_cache_key", "SELECT doc_id, substr(sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}'), 1, 20) AS key FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def canonical_cache_key(t: Inputs):
    d = t.table("documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    return d.select("doc_id", T.canonical_key({"source": F.col("source"), "lang": F.col("lang")}).alias("key"))


@R("fingerprint_set", "WITH d AS (SELECT DISTINCT source, lang FROM documents) SELECT source, substr(sha256(string_agg(lang, ',' ORDER BY lang) || ':' || CAST(count(*) AS VARCHAR)), 1, 16) AS print FROM d GROUP BY source")
def fingerprint_set(t: Inputs):
    return M.fingerprint_sets(t.table("documents"), ["source"], "lang")


@R("fingerprint_large_set", "WITH d AS (SELECT DISTINCT source, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE doc_id IS NOT NULL) SELECT source, substr(sha256(CAST(sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) || ':' || CAST(sum(CAST(CAST('0x' || substr(h, 16, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) || ':' || CAST(count(*) AS VARCHAR)), 1, 16) AS print FROM d GROUP BY source")
def fingerprint_large_set(t: Inputs):
    """The documents of each source, as a set of any size."""
    return M.fingerprint_sets(t.table("documents"), ["source"], "doc_id", large=True)


@R("restyle_manifest", W("v_manifest", rest="SELECT uid, 'styled/' || CAST(uid AS VARCHAR) || '.png' AS image_path, true AS styled, lang AS style, row_id FROM v_manifest"))
def restyle_manifest(t: Inputs):
    out = M.restyle(t.view("v_manifest"), F.concat(F.lit("styled/"), F.col("uid").cast("string"), F.lit(".png")), F.col("lang"))
    return out.select("uid", "image_path", "meta.styled", "meta.style", "row_id")


@R("regime_from_name", "WITH n AS (SELECT event_id, event_type, CAST(event_id % 9 AS VARCHAR) AS m FROM events) SELECT event_id, CASE WHEN event_type LIKE '%view%' THEN 'R' WHEN event_type LIKE '%c%' THEN 'A+R' ELSE 'A' END AS regime, CASE WHEN event_type LIKE '%view%' THEN 'm' || m WHEN event_type = 'click' THEN 'm' || m || '__base' ELSE 'x__m' || m END AS model FROM n")
def regime_from_name(t: Inputs):
    m = F.concat(F.lit("m"), (F.col("event_id") % 9).cast("string"))
    name = F.when(F.contains("event_type", F.lit("view")), F.concat(F.lit("sweep_real__"), m, F.lit("_ph1_view"))).when(F.col("event_type") == "click", F.concat(F.lit("sweep__"), m, F.lit("__base_ph0_ph1_c"))).otherwise(F.concat(F.lit("x__"), m, F.lit("_ph0"), "event_type"))
    rows = t.table("events").select("event_id", name.alias("name"))
    regime = T.regime_of(F.col("name"), [("view", "R"), ("c", "A+R")], "A")
    return rows.select("event_id", regime.alias("regime"), T.model_of(F.col("name"), ["sweep_real__", "sweep__"], ["_ph0", "_ph1"]).alias("model"))


@R("parse_weights", "SELECT event_id, CASE WHEN greatest(value, 0) > 0 THEN greatest(value, 0) END AS a, CASE WHEN greatest(value, 0) > 0 THEN 0.0 END AS b FROM events")
def parse_weights(t: Inputs):
    w = T.parse_weights(F.concat(F.lit("a:"), F.col("value").cast("string"), F.lit(", b:-1, c:2x")), ["a", "b"])
    return t.table("events").select("event_id", w.alias("w")).select("event_id", F.col("w")[0].alias("a"), F.col("w")[1].alias("b"))


@R("numeric_or_nan", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE -1 END AS x FROM events")
def numeric_or_nan(t: Inputs):
    text = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).when(F.col("event_id") % 3 == 1, "").otherwise("n/a")
    return t.table("events").select("event_id", F.nanvl(T.numeric_or_nan(text), F.lit(-1.0)).alias("x"))


@R("phrase_filter", r"SELECT p_partkey, p_name FROM part WHERE len(list_filter(regexp_split_to_array(p_name, '\s+'), lambda w: w <> '')) BETWEEN 1 AND 3")
def phrase_filter(t: Inputs):
    return t.table("part").filter(F.size(T.tokens(F.col("p_name"))).between(1, 3)).select("p_partkey", "p_name")


@R("image_ref", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'archive' ELSE 'dir' END AS type, CASE WHEN page_id % 2 = 0 THEN 'a.zip' ELSE url END AS path, CASE WHEN page_id % 2 = 0 THEN url END AS inner_path FROM pages")
def image_ref(t: Inputs):
    return t.table("pages").select("page_id", M.image_ref(F.col("url"), F.when(F.col("page_id") % 2 == 0, "a.zip")).alias("r")).select("page_id", "r.*")


@R("explode_boxes", W("v_boxes_pred", rest="SELECT uid, sum(x1) AS x1, round(sum(CASE WHEN idx = 0 THEN 0 ELSE score END), 4) AS score, count(*) AS n FROM v_boxes_pred GROUP BY uid"))
def explode_boxes(t: Inputs):
    g = t.view("v_boxes_pred").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("idx", "x1", "y1", "x2", "y2", F.when(F.col("idx") > 0, F.col("score")).alias("score")))).alias("a"))
    rows = g.select("uid", F.transform("a", lambda b: F.struct(b["x1"].alias("x1"), b["y1"].alias("y1"), b["x2"].alias("x2"), b["y2"].alias("y2"))).alias("boxes"), F.transform("a", lambda b: b["score"]).alias("scores"))
    return M.explode_boxes(rows).groupBy("uid").agg(F.sum("x1").alias("x1"), F.round(F.sum("score"), 4).alias("score"), F.count("*").alias("n"))


@R("order_boxes", W("v_boxes_gt", rest="SELECT uid, string_agg(CAST(CAST(y1 AS INTEGER) AS VARCHAR) || ':' || CAST(CAST(x1 AS INTEGER) AS VARCHAR), ',' ORDER BY y1, x1) AS boxes FROM v_boxes_gt GROUP BY uid"))
def order_boxes(t: Inputs):
    g = t.view("v_boxes_gt").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("y1", "x1"))).alias("a"))
    return g.select("uid", F.array_join(F.transform("a", lambda b: F.concat(b["y1"].cast("int").cast("string"), F.lit(":"), b["x1"].cast("int").cast("string"))), ",").alias("boxes"))


@R("detection_input", "SELECT event_id, 1 + event_id % 4 AS n FROM events")
def detection_input(t: Inputs):
    """Detections as a bare list or under one of four names."""
    boxes = F.to_json(F.array_repeat(F.struct(F.col("value").alias("score")), (1 + F.col("event_id") % 4).cast("int")))
    name = F.get(F.array(*map(F.lit, ("detections", "instances", "preds", "objects"))), (F.col("event_id") % 5).cast("int"))
    text = F.when(name.isNull(), boxes).otherwise(F.concat(F.lit('{"'), name, F.lit('":'), boxes, F.lit("}")))
    kind = "array<struct<score:double>>"
    rows = t.table("events").select("event_id", text.alias("j")).select("event_id", "j", F.from_json("j", f"detections {kind}, instances {kind}, preds {kind}, objects {kind}").alias("o"))
    found = F.when(F.startswith("j", F.lit("[")), F.from_json("j", kind)).otherwise(F.coalesce("o.detections", "o.instances", "o.preds", "o.objects"))
    return rows.select("event_id", F.size(found).cast("long").alias("n"))


@R("char_to_class", "SELECT p_partkey, CASE substr(p_name, 1, 1) WHEN 'a' THEN 0 WHEN 'b' THEN 1 ELSE -1 END AS cls FROM part")
def char_to_class(t: Inputs):
    known = F.create_map(F.lit("a"), F.lit(0), F.lit("b"), F.lit(1))
    return t.table("part").select("p_partkey", F.coalesce(F.element_at(known, F.substring("p_name", 1, 1)), F.lit(-1)).alias("cls"))
