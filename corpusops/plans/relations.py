"""Joins, audits and run tables over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import manifest as M
from ..operators import runs as U
from ..operators import splits as S
from ..sources import io
from .fixtures import Inputs
from .fixtures import with_views as W
from .registry import Registry

R = Registry()


@R("join_metadata", "SELECT o_orderkey AS uid, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def join_metadata(t: Inputs):
    return M.join_metadata(t.table("orders"), t.table("customer"), "o_custkey", "c_custkey", ["c_name", "c_mktsegment"]).select(F.col("o_orderkey").alias("uid"), "c_name", "c_mktsegment")


@R("explode_images", "WITH g AS (SELECT user_id AS row_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT CASE WHEN n > 1 THEN CAST(row_id AS VARCHAR) || '_' || CASE WHEN k < 10 THEN '0' ELSE '' END || CAST(k AS VARCHAR) ELSE CAST(row_id AS VARCHAR) END AS uid, event_id AS image FROM g")
def explode_images(t: Inputs):
    g = t.table("events").groupBy(F.col("user_id").alias("row_id")).agg(F.sort_array(F.collect_list("event_id")).alias("images"))
    return M.explode_images(g).select("uid", "image")


@R("mark_exists", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS \"exists\" FROM documents")
def mark_exists(t: Inputs):
    return M.mark_exists(t.table("documents").select("doc_id"), t.table("labels"), "doc_id")


@R("join_proposals", W("v_boxes_gt", rest="SELECT o_orderkey AS uid, count(b.uid) AS n, coalesce(sum(x1), 0) AS x1, true AS \"exists\" FROM orders LEFT JOIN v_boxes_gt b ON b.uid = o_orderkey GROUP BY o_orderkey"))
def join_proposals(t: Inputs):
    m = t.table("orders").select(F.col("o_orderkey").alias("uid")).distinct()
    out = M.join_proposals(m, t.view("v_boxes_gt"))
    return out.select("uid", F.size("boxes").cast("long").alias("n"), F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b["x1"]).alias("x1"), "exists")


@R("apply_gold", W("v_boxes_gt", rest=", f AS (SELECT uid, x1, x2 FROM v_boxes_gt WHERE idx = 0), l AS (SELECT uid, max(idx) AS k FROM v_boxes_gt WHERE idx > 0 AND uid % 2 = 0 GROUP BY uid), g AS (SELECT b.uid, CASE WHEN b.uid % 4 = 0 THEN x1 ELSE x1 / 100 * 640 END AS x1, CASE WHEN b.uid % 4 = 0 THEN x2 ELSE (x1 + x2) / 100 * 640 END AS x2 FROM v_boxes_gt b JOIN l ON l.uid = b.uid AND l.k = b.idx) SELECT f.uid, round(coalesce(g.x1, f.x1), 6) AS x1, round(coalesce(g.x2, f.x2), 6) AS x2 FROM f LEFT JOIN g ON g.uid = f.uid"))
def apply_gold(t: Inputs):
    b = t.view("v_boxes_gt")
    base = b.filter("idx = 0").select("uid", F.struct("x1", "y1", "x2", "y2").alias("box"))
    gold = b.filter("idx > 0 AND uid % 2 = 0").select("uid", F.when(F.col("uid") % 4 == 0, "xyxy_px").otherwise("labelstudio_pct").alias("format"), F.array("x1", "y1", "x2", "y2").alias("v"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.col("idx").alias("ord"))
    return M.apply_gold(base, gold).select("uid", F.round("box.x1", 6).alias("x1"), F.round("box.x2", 6).alias("x2"))


@R("upsert_annotations", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.toxic = 1 THEN 'toxic' ELSE d.source END AS source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def upsert_annotations(t: Inputs):
    edits = t.table("labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("source"))
    return M.upsert(t.table("documents").select("doc_id", "source"), edits, "doc_id", ["source"])


@R("join_detect", W("v_boxes_pred", rest="SELECT o_orderkey AS uid, o_custkey, idx FROM orders JOIN v_boxes_pred b ON b.uid = o_orderkey"))
def join_detect(t: Inputs):
    m = t.table("orders").select(F.col("o_orderkey").alias("uid"), "o_custkey")
    return M.join_detect(m, t.view("v_boxes_pred").select("uid", "idx"))


@R("join_classify", W("v_boxes_pred", rest="SELECT CAST(uid AS VARCHAR) || '_det' || lpad(CAST(idx AS VARCHAR), 6, '0') AS id, cls % 3 > 0 AS decodable FROM v_boxes_pred"))
def join_classify(t: Inputs):
    det = t.view("v_boxes_pred").select("uid", "idx")
    cls = t.view("v_boxes_pred").filter("cls % 3 > 0").select(F.format_string("%s_det%06d", F.col("uid").cast("string"), F.col("idx").cast("int")).alias("id"), F.col("cls").alias("label"))
    return M.join_classify(det, cls).select("id", "decodable")


@R("fill_gt", W("v_pairs", rest="SELECT uid, CASE WHEN trim(pred_text) = '' THEN coalesce(ref_text, '') ELSE trim(pred_text) END AS gt_text FROM v_pairs"))
def fill_gt(t: Inputs):
    p = t.view("v_pairs")
    return M.fill_gt(p.select("uid", F.col("pred_text").alias("gt_text")), p.select("uid", F.col("ref_text").alias("gt_text")))


@R("gallery_join", W("v_pairs", "v_boxes_pred", rest=", n AS (SELECT uid, count(*) AS n_boxes FROM v_boxes_pred GROUP BY uid) SELECT p.uid, 'i' || CAST(o_orderkey AS VARCHAR) AS image, coalesce(n_boxes, 0) AS n_boxes FROM v_pairs p JOIN orders ON o_orderkey = p.uid LEFT JOIN n ON n.uid = p.uid"))
def gallery_join(t: Inputs):
    m = t.table("orders").select(F.col("o_orderkey").alias("uid"), F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("image"))
    return M.gallery(t.view("v_pairs").select("uid"), m, t.view("v_boxes_pred"))


@R("anti_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_done(t: Inputs):
    return M.anti_done(t.table("documents").select("doc_id"), t.table("labels"), "doc_id")


@R("style_assign", "WITH d AS (SELECT doc_id AS uid, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS BIGINT) % 25 AS s FROM documents) SELECT uid, n_name AS style FROM d JOIN nation ON n_nationkey = s")
def style_assign(t: Inputs):
    styles = t.table("nation").select(F.col("n_nationkey").cast("int").alias("style_idx"), F.col("n_name").alias("style"))
    return M.style_assign(t.table("documents").select(F.col("doc_id").alias("uid")), styles, T.style_index(F.col("uid"), 25)).select("uid", "style")


@R("leak_overlap", W("v_manifest", rest="SELECT row_id FROM v_manifest WHERE split = 'train' INTERSECT SELECT row_id FROM v_manifest WHERE split = 'validation'"))
def leak_overlap(t: Inputs):
    sets = S.split_extract(t.view("v_manifest"))
    return S.overlap(sets["train"], sets["val"], "row_id")


@R("intersect_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def intersect_ids(t: Inputs):
    return S.overlap(t.table("documents"), t.table("labels").filter("quality = 1"), "doc_id")


@R("compare_tables", "SELECT event_type AS regime, 'mean' AS \"column\", CASE WHEN event_type = 'view' THEN 'missing row' ELSE 'differs' END AS problem FROM events GROUP BY event_type HAVING event_type IN ('view', 'click')")
def compare_tables(t: Inputs):
    made = t.table("events").groupBy(F.col("event_type").alias("regime")).agg(F.avg("value").alias("mean"), F.count("*").cast("double").alias("n"))
    frozen = made.select("regime", (F.col("mean") + F.when(F.col("regime") == "click", 1.0).otherwise(0.0)).alias("mean"), F.lit("n/a").alias("n"))
    return U.compare_tables(frozen, made.filter("regime <> 'view'"), "regime", ["mean", "n"], 1e-3)


@R("manifest_stats", W("v_manifest", rest="SELECT split, count(*) AS n, count(DISTINCT row_id) AS groups, round(avg(width), 6) AS mean_width, min(height) AS min_height, max(height) AS max_height FROM v_manifest GROUP BY split"))
def manifest_stats(t: Inputs):
    return t.view("v_manifest").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("groups"), F.round(F.avg("width"), 6).alias("mean_width"), F.min("height").alias("min_height"), F.max("height").alias("max_height"))


@R("proposal_stats", W("v_boxes_pred", rest="SELECT count(DISTINCT o_orderkey) AS images, count(DISTINCT b.uid) AS with_boxes, count(b.uid) AS boxes FROM orders LEFT JOIN v_boxes_pred b ON b.uid = o_orderkey"))
def proposal_stats(t: Inputs):
    images = t.table("orders").select(F.col("o_orderkey").alias("uid")).distinct()
    n = t.view("v_boxes_pred").groupBy("uid").agg(F.count("*").alias("n"))
    return images.join(n, "uid", "left").agg(F.count("*").alias("images"), F.count("n").alias("with_boxes"), F.sum("n").alias("boxes"))


@R("export_stats", "SELECT count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS written, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS skipped FROM documents")
def export_stats(t: Inputs):
    rows = M.mark_exists(t.table("documents").select("doc_id"), t.table("labels"), "doc_id")
    return rows.agg(F.count_if("exists").alias("written"), F.count_if(~F.col("exists")).alias("skipped"))


@R("class_balance", W("v_boxes_gt", rest="SELECT CASE WHEN uid % 10 < 7 THEN 'train' ELSE 'validation' END AS split, cls, count(*) AS n FROM v_boxes_gt GROUP BY 1, 2"))
def class_balance(t: Inputs):
    return t.view("v_boxes_gt").groupBy(F.when(F.col("uid") % 10 < 7, "train").otherwise("validation").alias("split"), "cls").agg(F.count("*").alias("n"))


@R("source_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(t: Inputs):
    return t.table("documents").groupBy("source").agg(F.count("*").alias("n"))


@R("release_counts", W("v_manifest", rest="SELECT split, count(*) AS records, count(DISTINCT row_id) AS ids FROM v_manifest GROUP BY split"))
def release_counts(t: Inputs):
    return S.release_counts(t.view("v_manifest"), "split", "row_id")


@R("by_split_sets", W("v_manifest", rest="SELECT DISTINCT split, row_id FROM v_manifest"))
def by_split_sets(t: Inputs):
    return t.view("v_manifest").select("split", "row_id").distinct()


@R("audit_leak", W("v_manifest", rest=", s AS (SELECT row_id FROM v_manifest WHERE split = 'train' INTERSECT SELECT row_id FROM v_manifest WHERE split = 'validation') SELECT (SELECT count(*) FROM s) AS shared, (SELECT count(*) FROM v_manifest WHERE row_id IS NULL) AS missing, (SELECT count(*) FROM s) = 0 AND (SELECT count(*) FROM v_manifest WHERE row_id IS NULL) = 0 AS passed"))
def audit_leak(t: Inputs):
    sets = S.split_extract(t.view("v_manifest"))
    return S.audit_leak(sets["train"], sets["val"])


@R("verify_release", W("v_manifest", rest=", s AS (SELECT row_id FROM v_manifest WHERE split = 'train' INTERSECT SELECT row_id FROM v_manifest WHERE split = 'validation'), g AS (SELECT count(*) AS n FROM (SELECT DISTINCT row_id, split FROM v_manifest) WHERE split <> CASE WHEN row_id % 3 = 0 THEN 'validation' ELSE 'train' END) SELECT 'count:' || split AS \"check\", CASE WHEN count(*) = 700 AND split = 'train' OR count(*) = 307 THEN 'ok' ELSE 'error' END AS level, CAST(count(*) AS VARCHAR) AS detail FROM v_manifest GROUP BY split UNION ALL SELECT 'leak', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'error' END, CAST(count(*) AS VARCHAR) FROM s UNION ALL SELECT 'table:labels', 'ok', 'present' UNION ALL SELECT 'table:masks', 'error', 'missing' UNION ALL SELECT 'group_split', CASE WHEN n = 0 THEN 'ok' ELSE 'warning' END, CAST(n AS VARCHAR) FROM g"))
def verify_release(t: Inputs):
    m = t.view("v_manifest")
    groups = m.select("row_id", F.when(F.col("row_id") % 3 == 0, "validation").otherwise("train").alias("split")).distinct()
    return S.verify_release(m, {"train": 700, "validation": 307}, tables={"labels": t.table("labels")}, required=("labels", "masks"), groups=groups)


@R("split_extract", W("v_manifest", rest="SELECT split, uid FROM v_manifest UNION ALL SELECT DISTINCT 'val_ids', row_id FROM v_manifest WHERE split = 'validation'"))
def split_extract(t: Inputs):
    s = S.split_extract(t.view("v_manifest"))
    return s["train"].select("split", "uid").unionAll(s["val"].select("split", "uid")).unionAll(s["val_ids"].select(F.lit("val_ids"), "row_id"))


@R("merge_last_wins", W("v_shard_rows", rest=", r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY shard_id DESC, line_no DESC) AS k FROM v_shard_rows) SELECT uid, shard_id, line_no, event_type FROM r WHERE k = 1"))
def merge_last_wins(t: Inputs):
    return S.merge_last_wins(t.view("v_shard_rows"), "uid", ["shard_id", "line_no"]).select("uid", "shard_id", "line_no", "event_type")


@R("distinct_sorted", "SELECT lower(url) AS path, min(page_id) AS first FROM pages GROUP BY 1")
def distinct_sorted(t: Inputs):
    return S.distinct_ordered(t.table("pages").select(F.lower("url").alias("path"), "page_id"), "path", "page_id")


@R("head_n", W("v_shard_rows", rest="SELECT uid, line_no FROM v_shard_rows ORDER BY uid, line_no LIMIT 50"))
def head_n(t: Inputs):
    return S.head_n(t.view("v_shard_rows"), 50, ["uid", "line_no"]).select("uid", "line_no")


@R("best_epoch", W("v_epochs", rest=", r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY metric DESC, epoch) AS k FROM v_epochs) SELECT run_id, epoch, metric FROM r WHERE k = 1"))
def best_epoch(t: Inputs):
    return U.best_epoch(t.view("v_epochs"))


@R("last_epoch", W("v_epochs", rest=", r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS k FROM v_epochs) SELECT run_id, epoch, regime, metric FROM r WHERE k = 1"))
def last_epoch(t: Inputs):
    return U.last_epoch(t.view("v_epochs"))


BEST = "SELECT run_id % 7 AS model, regime, round(max(metric), 6) AS best FROM v_epochs GROUP BY 1, 2"


def _best(t: Inputs):
    return U.best_per_model_regime(t.view("v_epochs").withColumn("model", F.col("run_id") % 7), "model", "regime", "metric", "run_id")


@R("best_per_model_regime", W("v_epochs", rest=", r AS (SELECT run_id % 7 AS model, regime, metric, run_id, row_number() OVER (PARTITION BY run_id % 7, regime ORDER BY metric DESC, run_id) AS k FROM v_epochs) SELECT model, regime, round(metric, 6) AS best, run_id AS source FROM r WHERE k = 1"))
def best_per_model_regime(t: Inputs):
    return _best(t)


@R("pivot_regimes", W("v_epochs", rest=f", b AS ({BEST}) SELECT model, round_even(max(CASE WHEN regime = 'click' THEN best END), 3) AS click, round_even(max(CASE WHEN regime = 'view' THEN best END), 3) AS \"view\", round_even(round_even(max(CASE WHEN regime = 'click' THEN best END), 3) - round_even(max(CASE WHEN regime = 'view' THEN best END), 3), 3) AS delta FROM b GROUP BY model"))
def pivot_regimes(t: Inputs):
    return U.pivot_regimes(_best(t), "model", "regime", ["click", "view"], ("click", "view"))


@R("last_phase_metrics", W("v_epochs", rest=", p AS (SELECT run_id, epoch // 10 AS phase, max(CASE WHEN regime = 'view' THEN metric END) AS best FROM v_epochs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY phase DESC) AS k FROM p WHERE best IS NOT NULL), f AS (SELECT run_id, min(metric) AS best FROM v_epochs WHERE regime = 'click' GROUP BY run_id) SELECT coalesce(r.run_id, f.run_id) AS run_id, phase, coalesce(r.best, f.best) AS best FROM (SELECT * FROM r WHERE k = 1) r FULL JOIN f ON f.run_id = r.run_id"))
def last_phase_metrics(t: Inputs):
    """The best of the last phase that has one; runs without phases fall back to their flat metric."""
    e = t.view("v_epochs")
    p = e.groupBy("run_id", F.floor(F.col("epoch") / 10).alias("phase")).agg(F.max(F.when(F.col("regime") == "view", F.col("metric"))).alias("best"))
    flat = e.filter("regime = 'click'").groupBy("run_id").agg(F.min("metric").alias("best"))
    return U.last_metrics(p, flat, "run_id", "phase", "best")


@R("runs_summary", W("v_epochs", rest=", ".join(["SELECT run_id"] + [f"max(CASE WHEN regime = '{k}' THEN metric END) AS \"{k}\"" for k in ("click", "error", "purchase", "signup", "view")]) + " FROM v_epochs GROUP BY run_id"))
def runs_summary(t: Inputs):
    """A column for each metric that any run has."""
    best = t.view("v_epochs").groupBy("run_id", "regime").agg(F.max("metric").alias("m"))
    return U.runs_summary(best.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("regime", "m"))).alias("metrics")), "run_id", "metrics")


@R("val_sanity", W("v_epochs", rest="SELECT count(DISTINCT regime) AS sets, count(DISTINCT run_id) AS runs, count(DISTINCT regime) = 1 AS ok FROM v_epochs"))
def val_sanity(t: Inputs):
    return U.val_sanity(t.view("v_epochs"), "run_id", "regime")


@R("compare_runs", W("v_epochs", rest=", b AS (SELECT run_id, max(metric) AS metric FROM v_epochs GROUP BY run_id) SELECT run_id, metric FROM b ORDER BY metric DESC NULLS LAST, run_id LIMIT 20"))
def compare_runs(t: Inputs):
    return U.compare_runs(U.best_epoch(t.view("v_epochs")).select("run_id", "metric"), "metric", 20)


@R("reproduce_tables", W("v_epochs", rest=", b AS (SELECT run_id % 7 AS model, regime, round(max(metric), 6) AS best FROM v_epochs GROUP BY 1, 2), w AS (SELECT model, round_even(max(CASE WHEN regime = 'click' THEN best END), 3) AS click FROM b GROUP BY model) SELECT 'm' || CAST(model AS VARCHAR) AS model, 'R' AS \"column\", 'differs' AS problem FROM w WHERE model % 2 = 0 AND click IS NOT NULL UNION ALL SELECT 'gone', 'R', 'missing row' UNION ALL SELECT 'gone', 'AplusR', 'missing row'"))
def reproduce_tables(t: Inputs):
    """Run folders are scanned, named and put in a table; the frozen one has display names, and some values moved."""
    best = t.view("v_epochs").filter("regime IN ('click', 'view')").groupBy((F.col("run_id") % 7).alias("m"), "regime").agg(F.max("metric").alias("metric"))
    name = F.concat(F.when(F.col("regime") == "click", "sweep_real_only__m").otherwise("sweep_stagea__m"), F.col("m").cast("string"), F.lit("_ph1"))
    path = io.scratch(t.spark, "run-dirs")
    best.select(name.alias("run"), F.lit("metrics.json").alias("file"), F.to_json(F.struct("metric")).alias("value")).write.partitionBy("run", "file").text(path)
    runs = io.read_run_dirs(t.spark, path, {"metrics.json": "metric DOUBLE"}).select(F.col("run_id").alias("name"), "metrics.metric")
    rules, prefixes, suffixes = [("stagea", "AplusR"), ("real_only", "R")], ["sweep_real_only__", "sweep_stagea__"], ["_ph0", "_ph1"]
    args = (rules, prefixes, suffixes, ["AplusR", "R"], ("AplusR", "R"))
    made, _ = U.reproduce_tables(runs, runs.limit(0).select(F.lit("").alias("model"), F.lit(0.0).alias("AplusR"), F.lit(0.0).alias("R")), *args)
    number = F.regexp_extract("model", r"(\d+)", 1).cast("int")
    frozen = made.select(F.concat(F.lit("Model "), number.cast("string")).alias("model"), "AplusR", (F.col("R") + F.when(number % 2 == 0, 0.5).otherwise(0.0)).alias("R"))
    frozen = frozen.unionByName(t.spark.range(1).select(F.lit("gone").alias("model"), F.lit(0.5).alias("AplusR"), F.lit(0.5).alias("R")))
    _, problems = U.reproduce_tables(runs, frozen, *args, names={f"Model {k}": f"m{k}" for k in range(7)})
    return problems


@R("build_manifest", "WITH g AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS row_id, c_name, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS n FROM customer), i AS (SELECT *, unnest(range(n)) AS j FROM g), r AS (SELECT k, row_id, CASE WHEN n > 1 THEN row_id || '_0' || CAST(j AS VARCHAR) ELSE row_id END AS uid, row_id || '_' || CAST(j AS VARCHAR) || '.png' AS path, c_name, c_mktsegment, j, n FROM i), b AS (SELECT row_id, n, coalesce(sum(n) OVER (ORDER BY sha1(row_id), row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, round_even(sum(n) OVER () * 0.8, 0) AS t, round_even(sum(n) OVER () * 0.1, 0) AS v FROM (SELECT row_id, count(*) AS n FROM r GROUP BY row_id)), f AS (SELECT min(b) AS b0 FROM b WHERE b >= t), s AS (SELECT row_id, CASE WHEN b < t THEN 'train' WHEN b = b0 OR b - b0 < v THEN 'val' ELSE 'test' END AS split FROM b, f), m AS (SELECT uid, r.row_id, path, k % 2 = 0 AS \"exists\", split, replace(replace(replace(c_name, 'o', '[o]'), ' ', ''), ' ', '') AS no_space, c_name AS no_brackets, c_mktsegment AS segment FROM r JOIN s ON s.row_id = r.row_id) SELECT m.*, count(*) OVER (PARTITION BY split) AS split_n, CAST(sum(CASE WHEN \"exists\" THEN 0 ELSE 1 END) OVER (PARTITION BY split) AS BIGINT) AS split_missing FROM m")
def build_manifest(t: Inputs):
    """The whole build: mapping JSON and metadata CSV are scanned, joined, exploded, checked, split and counted."""
    c = t.table("customer")
    name = lambda i: F.concat(F.col("c_custkey").cast("string"), F.lit(f"_{i}.png"))
    images = F.when(F.col("c_custkey") % 5 == 0, F.array().cast("array<string>")).when(F.col("c_custkey") % 3 == 0, F.array(name(0))).otherwise(F.array(name(0), name(1)))
    entry = F.concat(F.lit('"'), F.col("c_custkey").cast("string"), F.lit('":'), F.to_json(F.struct(F.replace("c_name", F.lit("o"), F.lit("[o]")).alias("Hebrew"), F.lower("c_mktsegment").alias("English"), images.alias("Images"))))
    mapping, meta = io.scratch(t.spark, "mapping"), io.scratch(t.spark, "meta")
    io.write_joined([("{", c.select(F.col("c_custkey").alias("k"), entry.alias("value")))], "}", mapping)
    io.write_csv(c.select(F.col("c_custkey").alias("ID"), F.col("c_mktsegment").alias("segment")), meta)
    listing = c.filter("c_custkey % 2 = 0").select(F.explode(F.array(name(0), name(1))).alias("path"))
    out, stats = M.build_manifest(io.read_mapping(t.spark, mapping), io.read_metadata_csv(t.spark, meta), ["segment"], listing)
    rows = out.select("uid", "row_id", "path", "exists", "split", "hebrew.no_space", "hebrew.no_brackets", "csv.segment")
    return rows.join(stats.select("split", F.col("n").alias("split_n"), F.col("missing").alias("split_missing")), "split")


@R("resume_batch", W("v_manifest", rest=", d AS (SELECT uid, lang FROM v_manifest WHERE uid NOT IN (SELECT doc_id FROM labels)) SELECT uid, lang AS style, CASE WHEN uid % 2 = 0 THEN 'first' ELSE 'second' END AS state FROM d UNION ALL SELECT doc_id, 'done', 'done' FROM labels"))
def resume_batch(t: Inputs):
    """A job that stops half way and is run again: shards are appended, nothing is done twice, all is merged."""
    done = t.table("labels").select(F.col("doc_id").alias("uid"), F.lit("done").alias("style"), F.lit("done").alias("state")).distinct()
    path = io.scratch(t.spark, "resume")
    work = lambda state: lambda rows: rows.select("uid", F.col("lang").alias("style"), F.lit(state).alias("state"))
    m = t.view("v_manifest").select("uid", "lang")
    M.resume_batch(m.filter("uid % 2 = 0"), done, work("first"), 4, path)
    return M.resume_batch(m, done, work("second"), 4, path)


@R("sources_by_regime", "SELECT doc_id AS uid, 'real' AS source_tag FROM documents UNION ALL SELECT page_id, 'synth' FROM pages")
def sources_by_regime(t: Inputs):
    return S.regime_select({"real": t.table("documents").select(F.col("doc_id").alias("uid")), "synth": t.table("pages").select(F.col("page_id").alias("uid"))}, "mixed")
