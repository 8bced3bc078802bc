"""Error rates, classification, detection and decoding over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as T
from ..functions import vectors as V
from ..operators import decoding as D
from ..operators import evaluation as E
from ..operators import manifest as M
from ..operators import plugins
from .columns import IOU, JOINED, _logits
from .fixtures import Inputs
from .fixtures import with_views as W
from .registry import Registry

R = Registry()
RATE = "CASE WHEN length({r}) = 0 THEN CASE WHEN length({p}) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein({r}, {p}) / CAST(length({r}) AS DOUBLE) END"
CER = RATE.format(r="ref_text", p="pred_text")
WORDS = r", t AS (SELECT *, list_filter(regexp_split_to_array(ref_text, '\s+'), lambda w: w <> '') AS a, list_filter(regexp_split_to_array(pred_text, '\s+'), lambda w: w <> '') AS b FROM v_pairs), k AS (SELECT *, list_sort(list_distinct(list_concat(a, b))) AS k FROM t), s AS (SELECT *, array_to_string(list_transform(a, lambda w: chr(CAST(33 + list_position(k, w) AS INTEGER))), '') AS sa, array_to_string(list_transform(b, lambda w: chr(CAST(33 + list_position(k, w) AS INTEGER))), '') AS sb, replace(ref_text, ' ', '') AS rs, replace(pred_text, ' ', '') AS ps FROM k)"
WER = RATE.format(r="sa", p="sb")
METRICS = f"count(*) AS n, round(avg(CASE WHEN ref_text = pred_text THEN 1 ELSE 0 END), 6) AS exact, round(avg(CASE WHEN rs = ps THEN 1 ELSE 0 END), 6) AS exact_nospace, round(avg({CER}), 6) AS cer_macro, round(sum(levenshtein(ref_text, pred_text)) / CAST(greatest(1, sum(length(ref_text))) AS DOUBLE), 6) AS cer_micro, round(avg({RATE.format(r='rs', p='ps')}), 6) AS cer_nospace_macro, round(sum(levenshtein(rs, ps)) / CAST(greatest(1, sum(length(rs))) AS DOUBLE), 6) AS cer_nospace_micro, round(avg({WER}), 6) AS wer_macro, round(sum(levenshtein(sa, sb)) / CAST(greatest(1, sum(length(sa))) AS DOUBLE), 6) AS wer_micro"


@R("cer", W("v_pairs", rest=f"SELECT uid, round({CER}, 6) AS cer FROM v_pairs"))
def cer(t: Inputs):
    return t.view("v_pairs").select("uid", F.round(T.cer(F.col("ref_text"), F.col("pred_text")), 6).alias("cer"))


@R("wer", W("v_pairs", rest=f"{WORDS} SELECT uid, round({WER}, 6) AS wer FROM s"))
def wer(t: Inputs):
    return t.view("v_pairs").select("uid", F.round(T.wer(F.col("ref_text"), F.col("pred_text")), 6).alias("wer"))


@R("ocr_metrics", W("v_pairs", rest=f"{WORDS} SELECT {METRICS} FROM s"))
def ocr_metrics(t: Inputs):
    return E.ocr_metrics(t.view("v_pairs"))


@R("metrics_table", W("v_pairs", rest=f"{WORDS} SELECT {METRICS} FROM s"))
def metrics_table(t: Inputs):
    """Field names fall back: gt_text or gt, pred_text or pred."""
    p = t.view("v_pairs").select(F.when(F.col("uid") % 2 == 0, F.col("ref_text")).alias("gt_text"), F.when(F.col("uid") % 2 == 1, F.col("ref_text")).alias("gt"), F.when(F.col("uid") % 3 == 0, F.col("pred_text")).alias("pred_text"), F.when(F.col("uid") % 3 > 0, F.col("pred_text")).alias("pred"))
    return E.ocr_metrics(p.select(F.coalesce("gt_text", "gt").alias("ref_text"), F.coalesce("pred_text", "pred").alias("pred_text")))


APPROACHES = ", a AS (SELECT 'plain' AS approach, uid, ref_text, pred_text FROM v_pairs UNION ALL SELECT 'reversed', uid, ref_text, reverse(pred_text) FROM v_pairs WHERE uid % 2 = 0), v_used AS (SELECT * FROM a WHERE uid % 10 < 7)"


@R("evaluate_approaches", W("v_pairs", rest=APPROACHES + WORDS.replace("FROM v_pairs", "FROM v_used") + f", m AS (SELECT approach, {METRICS} FROM s GROUP BY approach), w AS (SELECT approach, uid, row_number() OVER (PARTITION BY approach ORDER BY {CER} DESC, {WER} DESC, uid) AS k FROM s) SELECT m.*, worst FROM m JOIN (SELECT approach, string_agg(CAST(uid AS VARCHAR), ',' ORDER BY k) AS worst FROM w WHERE k <= 10 GROUP BY approach) USING (approach)"))
def evaluate_approaches(t: Inputs):
    """Two approaches over the train split, ground truth of the second one filled from the manifest, and the ten worst."""
    p = t.view("v_pairs")
    manifest = p.select("uid", F.when(F.col("uid") % 10 < 7, "train").otherwise("validation").alias("split"), F.col("ref_text").alias("gt_text"))
    one = p.select(F.lit("plain").alias("approach"), "uid", F.col("ref_text").alias("gt_text"), "pred_text")
    two = p.filter("uid % 2 = 0").select(F.lit("reversed").alias("approach"), "uid", F.lit(" ").alias("gt_text"), F.reverse("pred_text").alias("pred_text"))
    found = E.evaluate_approaches(one.unionByName(two), manifest, "TRAIN", 10)
    worst = found["worst"].groupBy("approach").agg(F.sort_array(F.collect_list(F.struct("rank", "uid"))).alias("w"))
    return found["metrics"].join(worst.select("approach", F.array_join(F.transform("w", lambda x: x["uid"].cast("string")), ",").alias("worst")), "approach")


DETECTION = ", h AS (SELECT 'sure' AS approach, uid, idx, score, g FROM (SELECT * FROM m WHERE threshold = 0.5 AND k > 0) UNION ALL SELECT 'twice', uid, idx + 1000 * c, score, CASE WHEN c = 0 THEN g END FROM (SELECT * FROM m WHERE threshold = 0.5 AND k > 0), (VALUES (0), (1)) v(c)), o AS (SELECT *, CASE WHEN g IS NULL THEN 0 ELSE 1 END AS tp FROM h WHERE uid % 10 < 7), n AS (SELECT count(*) AS n FROM v_boxes_gt WHERE uid % 10 < 7), c AS (SELECT *, sum(tp) OVER w AS cum_tp, count(*) OVER w AS seen FROM o WINDOW w AS (PARTITION BY approach ORDER BY score DESC, uid, idx ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, cum_tp / CAST(seen AS DOUBLE) AS precision, cum_tp / CAST(n AS DOUBLE) AS recall FROM c, n), e AS (SELECT *, max(precision) OVER (PARTITION BY approach ORDER BY score DESC, uid, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM p), s AS (SELECT approach, tp, recall, envelope, lag(recall, 1, 0.0) OVER w AS r0, lag(envelope) OVER w AS p0, row_number() OVER w AS k, count(*) OVER (PARTITION BY approach) AS n FROM e WINDOW w AS (PARTITION BY approach ORDER BY score DESC, uid, idx)) SELECT approach, round(sum((recall - r0) * (envelope + coalesce(p0, envelope)) / 2) + sum(CASE WHEN k = n THEN (1 - recall) * envelope / 2 ELSE 0 END), 5) AS ap, round(max(recall), 6) AS recall, round(avg(tp), 6) AS precision FROM s GROUP BY approach"


@R("evaluate_detection")
def evaluate_detection(t: Inputs):
    """The detection part of the evaluation of approaches over the train split: the second one finds each box once more far
    outside, a false positive."""
    found = t.view("v_boxes_pred")
    images = t.view("v_boxes_gt").select("uid").distinct().select("uid", F.when(F.col("uid") % 10 < 7, "train").otherwise("validation").alias("split"), F.lit("").alias("gt_text"))
    again = found.withColumns({"idx": F.col("idx") + 1000, "x1": F.col("x1") + 9000, "x2": F.col("x2") + 9000}).unionByName(found)
    boxes = found.withColumn("approach", F.lit("sure")).unionByName(again.withColumn("approach", F.lit("twice")))
    preds = images.select(F.lit("sure").alias("approach"), "uid", "gt_text", F.lit("").alias("pred_text"))
    d = E.evaluate_approaches(preds, images, "train", 1, t.view("v_boxes_gt"), boxes)["detection"]
    return d.select("approach", F.round("ap", 5).alias("ap"), F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@R("worst_cases", W("v_pairs", rest=f"{WORDS} SELECT uid, round({CER}, 6) AS cer, round({WER}, 6) AS wer FROM s ORDER BY {CER} DESC, {WER} DESC, uid LIMIT 100"))
def worst_cases(t: Inputs):
    return E.worst_cases(t.view("v_pairs"), 100).select("uid", F.round("cer", 6).alias("cer"), F.round("wer", 6).alias("wer"))


@R("worst_gallery", W("v_pairs", rest=f"SELECT uid, round({CER}, 6) AS cer FROM v_pairs WHERE {CER} >= 0.3 ORDER BY {CER} DESC, uid LIMIT 100"))
def worst_gallery(t: Inputs):
    return E.worst_gallery(t.view("v_pairs"), 0.3, 100).select("uid", F.round("cer", 6).alias("cer"))


FLIP = RATE.format(r="ref_text", p="reverse(pred_text)")


@R("auto_reverse", W("v_pairs", rest=f"SELECT uid, {FLIP} < {CER} AS reversed, CASE WHEN {FLIP} < {CER} THEN reverse(pred_text) ELSE pred_text END AS pred_text FROM v_pairs"))
def auto_reverse(t: Inputs):
    return E.auto_reverse(t.view("v_pairs")).select("uid", "reversed", "pred_text")


@R("edit_script", W("v_pairs", rest="SELECT uid, levenshtein(ref_text, pred_text) AS edits, ref_text AS ref, pred_text AS pred FROM v_pairs"))
def edit_script(t: Inputs):
    """Edits of each script, and the two texts read back from it."""
    s = t.view("v_pairs").select("uid", E.edit_script("ref_text", "pred_text").alias("s"))
    side = lambda c: F.array_join(F.transform(F.filter("s", lambda x: x[c].isNotNull()), lambda x: x[c]), "")
    return s.select("uid", F.size(F.filter("s", lambda x: x["op"] != "equal")).cast("long").alias("edits"), side("a").alias("ref"), side("b").alias("pred"))


#: Distances row by row, insertions as a running minimum, then the way back: diagonal before deletion before insertion.
ALIGNED = ", ch AS (SELECT uid, list_filter(string_split(ref_text, ''), lambda x: x <> '') AS a, list_filter(string_split(coalesce(pred_text, ''), ''), lambda x: x <> '') AS b FROM v_pairs), dp AS (SELECT uid, a, b, CAST(0 AS BIGINT) AS i, range(0, len(b) + 1) AS up, [range(0, len(b) + 1)] AS d FROM ch UNION ALL SELECT uid, a, b, i + 1, row, list_append(d, row) FROM (SELECT *, list_transform(range(0, len(b) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: CASE WHEN k = 0 THEN i + 1 ELSE least(up[k] + CASE WHEN a[i + 1] = b[k] THEN 0 ELSE 1 END, up[k + 1] + 1) END - k))) AS row FROM dp WHERE i < len(a))), bk AS (SELECT uid, a, b, d, CAST(len(a) AS BIGINT) AS i, CAST(len(b) AS BIGINT) AS j, '' AS op, CAST(NULL AS VARCHAR) AS x, CAST(NULL AS VARCHAR) AS y FROM dp WHERE i = len(a) UNION ALL SELECT uid, a, b, d, CASE WHEN st <> 'ins' THEN i - 1 ELSE i END, CASE WHEN st <> 'del' THEN j - 1 ELSE j END, st, CASE WHEN st <> 'ins' THEN a[i] END, CASE WHEN st <> 'del' THEN b[j] END FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND d[i + 1][j + 1] = d[i][j] + CASE WHEN a[i] = b[j] THEN 0 ELSE 1 END THEN CASE WHEN a[i] = b[j] THEN 'equal' ELSE 'sub' END WHEN i > 0 AND d[i + 1][j + 1] = d[i][j + 1] + 1 THEN 'del' ELSE 'ins' END AS st FROM bk WHERE i > 0 OR j > 0)), al AS (SELECT op, x AS a, y AS b, count(*) AS n FROM bk WHERE op NOT IN ('', 'equal') GROUP BY 1, 2, 3)"


@R("aligned_confusion", W("v_pairs", rest=f"{ALIGNED} SELECT op, a, b, n FROM al").replace("WITH ", "WITH RECURSIVE ", 1))
def aligned_confusion(t: Inputs):
    return E.aligned_confusion(t.view("v_pairs"))


@R("confusion_pivot", W("v_pairs", rest=f"{ALIGNED}, top AS (SELECT a AS c FROM al WHERE op IN ('sub', 'del') GROUP BY a ORDER BY sum(n) DESC, a LIMIT 10), s AS (SELECT a, b, n FROM al WHERE op = 'sub' AND a IN (SELECT c FROM top) AND b IN (SELECT c FROM top)) SELECT t.a AS true_char, 'pred_' || printf('%04x', unicode(c)) AS pred, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM s WHERE s.a = t.a AND s.b = c), 0) AS n FROM (SELECT DISTINCT a FROM s) t, top").replace("WITH ", "WITH RECURSIVE ", 1))
def confusion_pivot(t: Inputs):
    """The matrix as rows: one for each cell."""
    m = E.confusion_pivot(E.aligned_confusion(t.view("v_pairs")), 10)
    return m.unpivot("true_char", [c for c in m.columns if c != "true_char"], "pred", "n")


PRED = "WITH l AS (SELECT vec_id, label AS y_true, [CAST(x AS DOUBLE) FOR x IN embedding] AS x FROM embeddings), c AS (SELECT vec_id, y_true, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS y_pred, x FROM l), n AS (SELECT y_true, y_pred, count(*) AS n FROM c GROUP BY 1, 2), k AS (SELECT coalesce(a.label, b.label) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted FROM (SELECT y_true AS label, count(*) AS support, sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS tp FROM c GROUP BY 1) a FULL JOIN (SELECT y_pred AS label, count(*) AS predicted FROM c GROUP BY 1) b ON a.label = b.label), m AS (SELECT label, support, tp / (predicted + 1e-12) AS p, tp / (support + 1e-12) AS r FROM k), f AS (SELECT label, support, p, r, 2 * p * r / (p + r + 1e-12) AS f1 FROM m)"


def _counts(t: Inputs):
    return E.confusion(_logits(t).select("y_true", V.argmax(F.col("x")).alias("y_pred")))


@R("confusion", f"{PRED} SELECT y_true, y_pred, n FROM n")
def confusion(t: Inputs):
    return _counts(t)


@R("class_metrics", f"{PRED} SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f")
def class_metrics(t: Inputs):
    return E.class_metrics(_counts(t)).select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@R("summary_metrics", f"{PRED}, s AS (SELECT avg(p) AS macro_precision, avg(r) AS macro_recall, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM f WHERE support > 0), a AS (SELECT sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS accuracy FROM n) SELECT round(accuracy, 6) AS accuracy, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM s, a")
def summary_metrics(t: Inputs):
    return E.summary_metrics(_counts(t)).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")])


@R("topk_accuracy", f"{PRED}, u AS (SELECT vec_id, y_true, unnest(x) AS v, unnest(range(len(x))) AS i FROM c), r AS (SELECT vec_id, y_true, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM u) SELECT round(sum(CASE WHEN i = y_true AND k <= 3 THEN 1 ELSE 0 END) / CAST((SELECT count(*) FROM c) AS DOUBLE), 6) AS accuracy, (SELECT count(*) FROM c) AS n FROM r")
def topk_accuracy(t: Inputs):
    return E.topk_accuracy(_logits(t).withColumnRenamed("x", "scores"), 3)


@R("top_confusions", f"{PRED} SELECT y_true, y_pred, n FROM n WHERE y_true <> y_pred ORDER BY n DESC, y_true, y_pred LIMIT 20")
def top_confusions(t: Inputs):
    return E.top_confusions(_counts(t))


@R("worst_classes", f"{PRED} SELECT label, round(f1, 6) AS f1 FROM f WHERE support > 0 ORDER BY f.f1, label LIMIT 3")
def worst_classes(t: Inputs):
    return E.worst_classes(_counts(t), 3).select("label", F.round("f1", 6).alias("f1"))


@R("batch_predict", f"{PRED}, e AS (SELECT vec_id, y_pred, x, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM c), p AS (SELECT vec_id, y_pred, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e), u AS (SELECT vec_id, unnest(p) AS v, unnest(range(len(p))) AS i FROM p), r AS (SELECT vec_id, v, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM u) SELECT vec_id AS uid, max(CASE WHEN k = 1 THEN 'c' || CAST(i AS VARCHAR) END) AS label, round(max(CASE WHEN k = 1 THEN v END), 5) AS conf, string_agg('c' || CAST(i AS VARCHAR), ',' ORDER BY k) AS topk, 64 AS n_probs FROM r WHERE k <= 3 GROUP BY vec_id")
def batch_predict(t: Inputs):
    """A caller's model with label, confidence, top 3 and probabilities; a cache holds the rows of even class, and the
    results of a first call over a part of the rows are in the store when the second one runs."""
    names = [f"c{i}" for i in range(64)]
    rows = _logits(t).select(F.col("vec_id").alias("uid"), "x", "p")
    kind = plugins.contract("classifier", "uid long", probs=True)
    known = F.array(*map(F.lit, names))
    top = V.top_k(F.col("p"), known, 3)
    cache = rows.filter(V.argmax(F.col("x")) % 2 == 0).select("uid", F.get(known, V.argmax(F.col("x"))).alias("label"), F.array_max("p").alias("conf"), top.alias("topk"), F.col("p").alias("probs"))
    from ..sources import io

    model, store = (lambda: lambda pdf: plugins.from_logits(pdf, "uid", "x", names, 3)), io.scratch(t.spark, "predictions")
    plugins.batch_predict(rows.select("uid", "x").filter("uid % 3 = 0"), model, kind, cache, store=store)
    out = plugins.batch_predict(rows.select("uid", "x"), model, kind, cache, store=store)
    return out.select("uid", "label", F.round("conf", 5).alias("conf"), F.array_join(F.transform("topk", lambda x: x["label"]), ",").alias("topk"), F.size("probs").alias("n_probs"))


@R("plugin_approach", W("v_pairs", rest="SELECT uid, ref_text AS gt_text, reverse(pred_text) AS pred_text FROM v_pairs"))
def plugin_approach(t: Inputs):
    plugins.register("reversed")(lambda df: df.select("uid", F.col("ref_text").alias("gt_text"), F.reverse("pred_text").alias("pred_text"), "grp"))
    return plugins.run_approach("reversed", t.view("v_pairs"))


@R("iou_pairs", W("v_boxes_gt", "v_boxes_pred", rest=f"{JOINED} SELECT uid, gt_idx, pred_idx, round({IOU}, 6) AS iou FROM j WHERE iw > 0 AND ih > 0"))
def iou_pairs(t: Inputs):
    return E.iou_pairs(t.view("v_boxes_gt"), t.view("v_boxes_pred")).select("uid", "gt_idx", "pred_idx", F.round("iou", 6).alias("iou"))


MATCHES = f"{JOINED}, pr AS (SELECT uid, idx, score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, idx) AS k FROM v_boxes_pred WHERE uid IN (SELECT uid FROM v_boxes_gt)), ca AS (SELECT uid, pred_idx, list({{'g': gt_idx, 'v': {IOU}}} ORDER BY {IOU} DESC, gt_idx) AS c FROM j GROUP BY uid, pred_idx), q AS (SELECT pr.uid, pr.idx, pr.score, pr.k, c FROM pr JOIN ca ON ca.uid = pr.uid AND ca.pred_idx = pr.idx), th AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS threshold), m AS (SELECT uid, CAST(threshold AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS BIGINT) AS g FROM (SELECT DISTINCT uid FROM q), th UNION ALL SELECT uid, threshold, k, CASE WHEN g IS NULL THEN used ELSE list_append(used, g) END, idx, score, g FROM (SELECT m.uid, m.threshold, q.k, m.used, q.idx, q.score, list_filter(q.c, lambda x: x.v >= m.threshold AND NOT list_contains(m.used, x.g))[1].g AS g FROM m JOIN q ON q.uid = m.uid AND q.k = m.k + 1))"


@R("match_detections", W("v_boxes_gt", "v_boxes_pred", rest=f"{MATCHES} SELECT uid, threshold, idx, score, CASE WHEN g IS NULL THEN 0 ELSE 1 END AS tp FROM m WHERE k > 0").replace("WITH ", "WITH RECURSIVE ", 1))
def match_detections(t: Inputs):
    return E.match_detections(t.view("v_boxes_gt"), t.view("v_boxes_pred"))


HITS = f"{JOINED}, h AS (SELECT uid, gt_idx AS idx, score, CASE WHEN {IOU} >= 0.8 THEN 1 ELSE 0 END AS tp FROM j WHERE gt_idx = pred_idx), c AS (SELECT uid, idx, score, tp, sum(tp) OVER w AS cum_tp, count(*) OVER w AS seen FROM h WINDOW w AS (ORDER BY score DESC, uid, idx ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, cum_tp / CAST(seen AS DOUBLE) AS precision, cum_tp / CAST((SELECT count(*) FROM v_boxes_gt) AS DOUBLE) AS recall FROM c), e AS (SELECT *, max(precision) OVER (ORDER BY score DESC, uid, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM p)"


R.sql["evaluate_detection"] = W("v_boxes_gt", "v_boxes_pred", rest=MATCHES + DETECTION).replace("WITH ", "WITH RECURSIVE ", 1)


def _curve(t: Inputs):
    j = _pairs_at_index(t)
    return E.pr_curve(j, t.view("v_boxes_gt").agg(F.count("*").alias("n_gt")), [])


def _pairs_at_index(t: Inputs):
    b = F.struct("x1", "y1", "x2", "y2")
    g = t.view("v_boxes_gt").select("uid", "idx", b.alias("a"))
    j = g.join(t.view("v_boxes_pred").select("uid", "idx", "score", b.alias("b")), ["uid", "idx"])
    return j.select("uid", "idx", "score", F.when(B.iou(F.col("a"), F.col("b")) >= 0.8, 1).otherwise(0).alias("tp"))


@R("pr_curve", W("v_boxes_gt", "v_boxes_pred", rest=f"{HITS} SELECT uid, idx, CAST(cum_tp AS BIGINT) AS cum_tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(envelope, 6) AS envelope FROM e"))
def pr_curve(t: Inputs):
    return _curve(t).select("uid", "idx", "cum_tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "envelope")])


@R("average_precision", W("v_boxes_gt", "v_boxes_pred", rest=f"{HITS}, s AS (SELECT recall, envelope, lag(recall, 1, 0.0) OVER w AS r0, lag(envelope) OVER w AS p0, row_number() OVER w AS k, count(*) OVER () AS n FROM e WINDOW w AS (ORDER BY score DESC, uid, idx)) SELECT round(sum((recall - r0) * (envelope + coalesce(p0, envelope)) / 2) + sum(CASE WHEN k = n THEN (1 - recall) * envelope / 2 ELSE 0 END), 5) AS ap FROM s"))
def average_precision(t: Inputs):
    return E.average_precision(_curve(t), []).select(F.round("ap", 5).alias("ap"))


@R("detection_metrics", W("v_boxes_gt", "v_boxes_pred", rest=f"{MATCHES}, h AS (SELECT uid, threshold, idx, score, CASE WHEN g IS NULL THEN 0 ELSE 1 END AS tp FROM m WHERE k > 0), n AS (SELECT count(*) AS n FROM v_boxes_gt), c AS (SELECT *, sum(tp) OVER w AS cum_tp, count(*) OVER w AS seen FROM h WINDOW w AS (PARTITION BY threshold ORDER BY score DESC, uid, idx ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, cum_tp / CAST(seen AS DOUBLE) AS precision, cum_tp / CAST(n AS DOUBLE) AS recall FROM c, n), e AS (SELECT *, max(precision) OVER (PARTITION BY threshold ORDER BY score DESC, uid, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM p), s AS (SELECT threshold, tp, recall, envelope, lag(recall, 1, 0.0) OVER w AS r0, lag(envelope) OVER w AS p0, row_number() OVER w AS k, count(*) OVER (PARTITION BY threshold) AS n FROM e WINDOW w AS (PARTITION BY threshold ORDER BY score DESC, uid, idx)) SELECT threshold, round(sum((recall - r0) * (envelope + coalesce(p0, envelope)) / 2) + sum(CASE WHEN k = n THEN (1 - recall) * envelope / 2 ELSE 0 END), 5) AS ap, round(max(recall), 6) AS recall, round(avg(tp), 6) AS precision FROM s GROUP BY threshold").replace("WITH ", "WITH RECURSIVE ", 1))
def detection_metrics(t: Inputs):
    d = E.detection_metrics(t.view("v_boxes_gt"), t.view("v_boxes_pred"))
    return d.select("threshold", F.round("ap", 5).alias("ap"), F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


GROWN = "greatest(least(box.x2, b[j].x2) - greatest(box.x1, b[j].x1), 0) * greatest(least(box.y2, b[j].y2) - greatest(box.y1, b[j].y1), 0)"
AREAS = f"((box.x2 - box.x1) * (box.y2 - box.y1) + (b[j].x2 - b[j].x1) * (b[j].y2 - b[j].y1) - {GROWN})"
MERGED = f", o AS (SELECT uid, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY score DESC, idx) AS b, count(*) AS n FROM v_boxes_pred GROUP BY uid), m AS (SELECT uid, b, n, CAST(1 AS BIGINT) AS i, CAST(2 AS BIGINT) AS j, b[1] AS box, [CAST(1 AS BIGINT)] AS used, CAST(0 AS BIGINT) AS done, CAST(0 AS DOUBLE) AS width, false AS ended FROM o UNION ALL SELECT uid, b, n, CASE WHEN j <= n THEN i ELSE nx END, CASE WHEN j <= n THEN j + 1 ELSE nx + 1 END, CASE WHEN j > n THEN b[nx] WHEN hit THEN {{'x1': least(box.x1, b[j].x1), 'y1': least(box.y1, b[j].y1), 'x2': greatest(box.x2, b[j].x2), 'y2': greatest(box.y2, b[j].y2)}} ELSE box END, CASE WHEN hit THEN list_append(used, j) WHEN j > n AND nx IS NOT NULL THEN list_append(used, nx) ELSE used END, CASE WHEN j <= n THEN done ELSE done + 1 END, CASE WHEN j <= n THEN width ELSE width + box.x2 - box.x1 END, j > n AND nx IS NULL FROM (SELECT *, j <= n AND NOT list_contains(used, j) AND CASE WHEN {AREAS} > 0 THEN {GROWN} / {AREAS} ELSE 0 END >= 0.3 AS hit, list_filter(range(i + 1, n + 1), lambda x: NOT list_contains(used, x))[1] AS nx FROM m WHERE NOT ended))"


@R("merge_boxes", W("v_boxes_pred", rest=f"{MERGED} SELECT uid, done AS n, width FROM m WHERE ended").replace("WITH ", "WITH RECURSIVE ", 1))
def merge_boxes(t: Inputs):
    return E.merge_boxes(t.view("v_boxes_pred"), 0.3).select("uid", F.size("boxes").cast("long").alias("n"), F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b["x2"] - b["x1"]).alias("width"))


@R("crops_topk", W("v_boxes_pred", rest=", k AS (SELECT uid, idx, score, least(CAST(trunc(x2 + (x2 - x1) * 0.05) AS INTEGER), 350) > greatest(CAST(trunc(x1 - (x2 - x1) * 0.05) AS INTEGER), 0) AS ok FROM v_boxes_pred), r AS (SELECT uid, idx, row_number() OVER (PARTITION BY uid ORDER BY score DESC, idx) AS rank FROM k WHERE ok AND score >= 0.2) SELECT uid, idx, rank FROM r WHERE rank <= 2"))
def crops_topk(t: Inputs):
    return M.crops_topk(t.view("v_boxes_pred"), 2, 0.2, F.lit(350), F.lit(480)).select("uid", "idx", "rank")


def _angles(t: Inputs):
    uids = t.view("v_pairs").select("uid", F.explode(F.array(*[F.lit(a) for a in (0, 90, 180, 270)])).alias("angle"))
    proj, cc = ((F.col("uid") * 37 + F.col("angle") * 11) % 101) / 10.0, F.col("angle") / 90.0
    return uids.select("uid", "angle", proj.alias("proj"), cc.alias("cc"), F.lit(-0.1).alias("penalty"), (F.col("uid") % 7 / 10.0).alias("density"), (F.col("uid") % 3 + 1).alias("lines"))


ROTATIONS = "a AS (SELECT uid, angle, ((uid * 37 + angle * 11) % 101) / 10.0 AS proj, angle / 90.0 AS cc FROM (SELECT DISTINCT p_partkey AS uid FROM part), (VALUES (0), (90), (180), (270)) x(angle)), t AS (SELECT *, proj + 0.15 * cc + -0.1 AS total FROM a), r AS (SELECT uid, angle, cc, total, row_number() OVER w AS k, lead(total) OVER w AS second FROM t WINDOW w AS (PARTITION BY uid ORDER BY total DESC, angle)), rot AS (SELECT uid, angle, cc, (total - coalesce(second, 0.0)) / (abs(total) + 1e-6) AS confidence FROM r WHERE k = 1)"


@R("rotation_pick", f"WITH {ROTATIONS} SELECT uid, angle, round(confidence, 6) AS confidence FROM rot")
def rotation_pick(t: Inputs):
    return M.rotation_pick(_angles(t)).select("uid", "angle", F.round("confidence", 6).alias("confidence"))


def _readings(t: Inputs):
    """Four candidates of each text; mirroring swaps some letters."""
    p = t.view("v_pairs")
    flags = F.explode(F.array(*[F.struct(F.lit(m).alias("mirrored"), F.lit(r).alias("reverse")) for m in (False, True) for r in (False, True)]))
    rows = p.select("uid", "pred_text", flags.alias("f")).select("uid", "pred_text", "f.*")
    text = F.when(F.col("mirrored"), F.translate("pred_text", "abdel", "zyxwv")).otherwise(F.col("pred_text"))
    return rows.select("uid", "mirrored", "reverse", F.when(F.col("reverse"), F.reverse(text)).otherwise(text).alias("text"))


def _truth(t: Inputs):
    return t.view("v_pairs").select("uid", F.when(F.col("uid") % 3 > 0, F.col("ref_text")).alias("gt_text"))


READINGS = r"c AS (SELECT uid, ref_text, m.m AS mirrored, v.v AS rev, CASE WHEN v.v THEN reverse(x) ELSE x END AS text FROM (SELECT uid, ref_text, pred_text, mm, CASE WHEN mm THEN translate(pred_text, 'abdel', 'zyxwv') ELSE pred_text END AS x FROM v_pairs, (VALUES (false), (true)) q(mm)) y, LATERAL (SELECT y.mm AS m) m, (VALUES (false), (true)) v(v)), b AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS b, regexp_replace(text, '\s+', '', 'g') AS plain, CASE WHEN uid % 3 > 0 THEN regexp_replace(ref_text, '\s+', '', 'g') ELSE '' END AS truth FROM c), d AS (SELECT *, length(regexp_replace(b, '[^a-m]', '', 'g')) / CAST(greatest(1, length(b)) AS DOUBLE) AS ratio FROM b), ql AS (SELECT uid, mirrored, rev, CASE WHEN truth <> '' THEN -(levenshtein(truth, plain) / CAST(length(truth) AS DOUBLE)) + 0.15 * ratio ELSE ratio + 0.01 * least(40, length(plain)) END AS quality FROM d), mi AS (SELECT uid, max(CASE WHEN mirrored THEN quality END) AS m, max(CASE WHEN NOT mirrored THEN quality END) AS s FROM ql GROUP BY uid), rv AS (SELECT uid, rev, row_number() OVER (PARTITION BY uid ORDER BY quality DESC, mirrored, rev) AS k FROM ql), mir AS (SELECT mi.uid, CASE WHEN abs(m - s) >= 0.05 THEN m > s END AS mirrored, rev AS reverse FROM mi JOIN rv ON rv.uid = mi.uid AND k = 1)"


@R("mirror_pick", W("v_pairs", rest=f", {READINGS} SELECT uid, mirrored, reverse FROM mir"))
def mirror_pick(t: Inputs):
    rows = _readings(t).join(_truth(t).hint("merge"), "uid").withColumn("quality", M.reading_quality(F.col("text"), F.col("gt_text"), "a-m"))
    return M.mirror_pick(rows)


def _glyphs(t: Inputs):
    return t.view("v_boxes_pred").withColumn("ch", F.chr(F.col("cls") + 97))


def _lines_sql(source: str, p: str) -> str:
    """CTEs {p}line (uid, vertical, n_lines, ord, text): reading order of the boxes of a view, groups grown one by one."""
    over = "greatest(least(g.{a}2, k.{a}2) - greatest(g.{a}1, k.{a}1), 0) / nullif(greatest(g.{a}2, k.{a}2) - least(g.{a}1, k.{a}1), 0)"
    near = f"coalesce(CASE WHEN axis = 'y' THEN {over.format(a='y')} ELSE {over.format(a='x')} END, 0) >= 0.35"
    token = "{'cy': (y1 + y2) / 2, 'cx': (x1 + x2) / 2, 'idx': idx, 'ch': chr(CAST(cls + 97 AS INTEGER)), 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
    grown = "{'x1': least(g.x1, k.x1), 'y1': least(g.y1, k.y1), 'x2': greatest(g.x2, k.x2), 'y2': greatest(g.y2, k.y2), 'm': list_append(g.m, k)}"
    opened = "{'x1': k.x1, 'y1': k.y1, 'x2': k.x2, 'y2': k.y2, 'm': [k]}"
    return (
        f", {p}tok AS (SELECT uid, list({token} ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, idx) AS t, count(*) AS n FROM {source} GROUP BY uid), "
        f"{p}grp AS (SELECT uid, axis, t, n, CAST(1 AS BIGINT) AS at_, [{opened.replace('k', 't[1]')}] AS gs FROM {p}tok, (VALUES ('x'), ('y')) a(axis) "
        f"UNION ALL SELECT uid, axis, t, n, at_ + 1, CASE WHEN hit > 0 THEN list_transform(gs, lambda g, i: CASE WHEN i = hit THEN {grown} ELSE g END) ELSE list_append(gs, {opened}) END FROM (SELECT *, t[at_ + 1] AS k, coalesce(list_position(list_transform(gs, lambda g: {near.replace('k.', 't[at_ + 1].')}), true), 0) AS hit FROM {p}grp WHERE at_ < n)), "
        f"{p}sco AS (SELECT uid, axis, gs, len(gs) AS c, len(list_filter(gs, lambda g: len(g.m) = 1)) / CAST(len(gs) AS DOUBLE) - 0.01 * CAST(n AS DOUBLE) / len(gs) AS f FROM {p}grp WHERE at_ = n), "
        f"{p}cho AS (SELECT v.uid, (v.c < h.c OR (v.c = h.c AND v.f <= h.f)) AS vertical, CASE WHEN v.c < h.c OR (v.c = h.c AND v.f <= h.f) THEN v.gs ELSE h.gs END AS gs FROM {p}sco v JOIN {p}sco h ON v.uid = h.uid AND v.axis = 'x' AND h.axis = 'y'), "
        f"{p}one AS (SELECT uid, vertical, unnest(gs) AS g, unnest(range(len(gs))) AS i FROM {p}cho), "
        f"{p}mem AS (SELECT uid, vertical, i, CASE WHEN vertical THEN -(g.x1 + g.x2) / 2 ELSE (g.y1 + g.y2) / 2 END AS a, CASE WHEN vertical THEN (g.y1 + g.y2) / 2 ELSE -(g.x1 + g.x2) / 2 END AS b, unnest(g.m) AS k FROM {p}one), "
        f"{p}row AS (SELECT uid, vertical, i, a, b, string_agg(k.ch, '' ORDER BY CASE WHEN vertical THEN k.cy ELSE -k.cx END, k.idx) AS text, string_agg(CAST(k.idx AS VARCHAR), ',' ORDER BY CASE WHEN vertical THEN k.cy ELSE -k.cx END, k.idx) AS ord FROM {p}mem GROUP BY ALL), "
        f"{p}line AS (SELECT uid, vertical, CAST(count(*) AS INTEGER) AS n_lines, string_agg(ord, ',' ORDER BY a, b, i) AS ord, string_agg(text, ' ' ORDER BY a, b, i) AS text FROM {p}row GROUP BY uid, vertical)"
    )


LINES = _lines_sql("v_boxes_pred", "p_")


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@R("group_lines", _recursive(W("v_boxes_pred", rest=f"{LINES} SELECT uid, vertical, n_lines FROM p_line")))
def group_lines(t: Inputs):
    return D.reading(D.tokens_of(_glyphs(t))).select("uid", "vertical", "n_lines")


@R("order_tokens", _recursive(W("v_boxes_pred", rest=f"{LINES} SELECT uid, ord AS \"order\" FROM p_line")))
def order_tokens(t: Inputs):
    return D.reading(D.tokens_of(_glyphs(t))).select("uid", F.array_join(F.col("read").cast("array<string>"), ",").alias("order"))


@R("decode", _recursive(W("v_boxes_pred", rest=f"{LINES} SELECT uid, n_lines, text AS pred_text FROM p_line")))
def decode(t: Inputs):
    return D.decode(_glyphs(t))


BOTH = ", v_sure AS (SELECT * FROM v_boxes_pred WHERE score >= 0.1)" + _lines_sql("v_boxes_gt", "g_") + _lines_sql("v_sure", "s_") + ", v_pairs AS (SELECT g.uid, g.text AS ref_text, coalesce(s.text, '') AS pred_text FROM g_line g LEFT JOIN s_line s ON s.uid = g.uid)"


@R("end_to_end", _recursive(W("v_boxes_gt", "v_boxes_pred", rest=f"{BOTH} {WORDS} SELECT {METRICS} FROM s")))
def end_to_end(t: Inputs):
    """Detections, classes, decoding and metrics in one plan: text from detections against text from ground truth."""
    gt = D.decode(t.view("v_boxes_gt").withColumn("ch", F.chr(F.col("cls") + 97))).select("uid", F.col("pred_text").alias("ref_text"))
    pred = D.decode(_glyphs(t).filter("score >= 0.1")).select("uid", "pred_text")
    return E.ocr_metrics(gt.join(pred, "uid", "left"))


@R("yolo_export", W("v_boxes_gt", rest="SELECT CASE WHEN uid % 10 < 7 THEN 'train' ELSE 'validation' END AS split, CAST(count(DISTINCT uid) FILTER (WHERE uid % 5 <> 1 AND uid IN (SELECT o_orderkey FROM orders)) AS BIGINT) AS written, CAST(count(DISTINCT uid) FILTER (WHERE NOT (uid % 5 <> 1 AND uid IN (SELECT o_orderkey FROM orders))) AS BIGINT) AS skipped, CAST(count(*) FILTER (WHERE uid % 5 <> 1 AND uid IN (SELECT o_orderkey FROM orders)) AS BIGINT) AS lines FROM v_boxes_gt GROUP BY 1"))
def yolo_export(t: Inputs):
    """Label files of all images whose path is found under one of two names, and what was written and skipped by split."""
    from ..sources import io

    boxes = t.view("v_boxes_gt").withColumn("split", F.when(F.col("uid") % 10 < 7, "train").otherwise("validation")).withColumn("box", B.to_yolo(F.struct("x1", "y1", "x2", "y2"), F.lit(640), F.lit(480)))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    listing = t.table("orders").filter("o_orderkey % 5 <> 1").select(F.when(F.col("o_orderkey") % 2 == 0, name("abs/", "o_orderkey")).otherwise(name("rel/", "o_orderkey")).alias("path"))
    path = io.scratch(t.spark, "yolo-export")
    stats = M.yolo_export(boxes.withColumn("abs_path", name("abs/", "uid")).withColumn("rel_path", name("rel/", "uid")), listing, ["abs_path", "rel_path"], path)
    lines = io.read_yolo_packed(t.spark, path).groupBy("split").agg(F.count("*").alias("lines"))
    return stats.join(lines, "split")


STATS = "SELECT 'rotation' AS measure, CAST(angle AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM rot GROUP BY angle UNION ALL SELECT 'mirrored', coalesce(CAST(mirrored AS VARCHAR), 'none'), count(*) FROM mir GROUP BY 2 UNION ALL SELECT 'reverse_pred', CAST(reverse AS VARCHAR), count(*) FROM mir GROUP BY 2 UNION ALL SELECT 'orientation_confidence', 'mean', round(avg(confidence), 5) FROM rot UNION ALL SELECT 'orientation_confidence', 'median', round(median(confidence), 5) FROM rot UNION ALL SELECT 'binarize_density', 'mean', round(avg(uid % 7 / 10.0), 5) FROM rot UNION ALL SELECT 'binarize_density', 'median', round(median(uid % 7 / 10.0), 5) FROM rot UNION ALL SELECT 'n_lines_est', 'mean', round(avg(uid % 3 + 1), 5) FROM rot UNION ALL SELECT 'n_lines_est', 'median', round(median(uid % 3 + 1), 5) FROM rot"


def _oriented(t: Inputs):
    df = _truth(t).withColumn("meta", F.struct(F.lit("part").alias("source")))
    return M.orient_rows(df, _angles(t), _readings(t), None, 42, "a-m")


@R("orient_manifest", W("v_pairs", rest=f", {READINGS}, {ROTATIONS} SELECT rot.uid, 'part' AS source, angle AS orientation_deg, round(confidence, 5) AS orientation_confidence, mirrored, reverse AS reverse_pred, 'rtl' AS reading_dir FROM rot JOIN mir ON mir.uid = rot.uid"))
def orient_manifest(t: Inputs):
    return _oriented(t).select("uid", "meta.source", "meta.orientation_deg", F.round("meta.orientation_confidence", 5).alias("orientation_confidence"), "meta.mirrored", "meta.reverse_pred", "meta.reading_dir")


@R("orientation_stats", W("v_pairs", rest=f", {READINGS}, {ROTATIONS} {STATS}"))
def orientation_stats(t: Inputs):
    stats = M.orientation_stats(_oriented(t).filter("meta.orientation_deg IS NOT NULL").select("meta.*"))
    return stats.select("measure", "key", F.round("value", 5).alias("value"))


@R("label_roundtrip", W("v_boxes_gt", rest="SELECT uid, idx, round(x1, 4) AS x1, round(y2, 4) AS y2 FROM v_boxes_gt WHERE uid IN (SELECT o_orderkey FROM orders)"))
def label_roundtrip(t: Inputs):
    """Boxes out in percent as tasks, back in as pixels."""
    from ..sources import io

    sizes = t.table("orders").select(F.col("o_orderkey").alias("uid"), F.lit(640).alias("width"), F.lit(480).alias("height")).distinct()
    path = io.scratch(t.spark, "roundtrip")
    io.label_studio_tasks(t.view("v_boxes_gt").withColumn("label", F.col("idx").cast("string")), sizes).write.text(path)
    back = io.read_label_studio(t.spark, path)
    px = B.from_pct(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.lit(640), F.lit(480))
    return back.select(F.col("uid").cast("long").alias("uid"), F.col("label").cast("long").alias("idx"), px.alias("b")).select("uid", "idx", F.round("b.x1", 4).alias("x1"), F.round("b.y2", 4).alias("y2"))
