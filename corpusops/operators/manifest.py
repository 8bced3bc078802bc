"""Joins, filters and updates of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as T


def normalize_manifest(df: DataFrame, gt: str = "gt", image: str = "image") -> DataFrame:
    """Text from a JSON string that is either the text or an object {raw, text}; path from the first name given."""
    g = F.from_json(gt, "raw STRING, text STRING")
    text = F.when(F.startswith(F.trim(gt), F.lit("{")), F.coalesce(g["raw"], g["text"])).otherwise(F.col(gt))
    i = F.from_json(image, "abs_path STRING, path STRING, rel_path STRING")
    return df.withColumn("gt_text", text).withColumn("image_path", F.coalesce(i["abs_path"], i["path"], i["rel_path"]))


def resolve_path(df: DataFrame, listing: DataFrame, candidates: list[str], key: str = "uid") -> DataFrame:
    """(key, resolved): the first candidate path of each row that the listing has."""
    tried = df.select(key, F.posexplode(F.array(*candidates)).alias("ord", "path")).filter("path IS NOT NULL")
    found = tried.join(listing.select("path").distinct(), "path", "left_semi")
    best = found.groupBy(key).agg(F.min_by("path", "ord").alias("resolved"))
    return df.select(key).join(best, key, "left")


def filter_split(df: DataFrame, split: str, case_sensitive: bool = False) -> DataFrame:
    return df.filter(F.col("split") == split if case_sensitive else F.lower("split") == split.lower())


def filter_missing(df: DataFrame, flag: str = "exists", strict: bool = False) -> DataFrame:
    """Rows whose flag holds; strict raises if any does not."""
    if strict and df.filter(~F.coalesce(F.col(flag), F.lit(False))).limit(1).count():
        raise ValueError("files are missing")
    return df.filter(flag)


def image_ref(path: Column, archive: Column) -> Column:
    kind = F.when(archive.isNotNull(), "archive").otherwise("dir")
    return F.struct(kind.alias("type"), F.coalesce(archive, path).alias("path"), F.when(archive.isNotNull(), path).alias("inner_path"))


def join_metadata(df: DataFrame, meta: DataFrame, key: str, meta_key: str, columns: list[str], small: bool = False) -> DataFrame:
    """Left join by key as text. Repeated keys in meta raise. small broadcasts meta: the caller has checked its size."""
    if meta.groupBy(meta_key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{meta_key} repeats")
    side = meta.select(F.col(meta_key).cast("string").alias("_key"), *columns)
    return df.join(F.broadcast(side) if small else side, F.col(key).cast("string") == F.col("_key"), "left").drop("_key")


def explode_images(groups: DataFrame, images: str = "images", row_id: str = "row_id") -> DataFrame:
    """One row per image; uid is row_id, or row_id_NN where a group has several."""
    rows = groups.select("*", F.size(images).alias("_n"), F.posexplode(images).alias("image_no", "image"))
    uid = F.when(F.col("_n") > 1, F.format_string("%s_%02d", F.col(row_id).cast("string"), F.col("image_no"))).otherwise(F.col(row_id).cast("string"))
    return rows.withColumn("uid", uid).drop("_n", images)


def mark_exists(df: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    known = listing.select(key).distinct().withColumn("_there", F.lit(True))
    return df.join(known, key, "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")


def join_proposals(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes of each uid, [] where there are none; exists is true unless given."""
    b = boxes.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("y1", "x1", "x2", "y2"))).alias("boxes"))
    out = df.join(b, "uid", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast("array<struct<y1:double,x1:double,x2:double,y2:double>>")))
    return out.withColumn("exists", F.coalesce("exists", F.lit(True)) if "exists" in df.columns else F.lit(True))


def gold_boxes(gold: DataFrame) -> DataFrame:
    """Gold rows (uid, format, v array<double>, width, height, ord) as pixel boxes; the last row of a uid wins."""
    v, w, h = F.col("v"), F.col("width"), F.col("height")
    pixel = F.when(F.col("format") == "xyxy_px", B.box(v[0], v[1], v[2], v[3])).when(F.col("format") == "labelstudio_pct", B.from_pct(v[0], v[1], v[2], v[3], w, h)).otherwise(B.from_yolo(v[0], v[1], v[2], v[3], w, h))
    last = gold.withColumn("box", pixel).groupBy("uid").agg(F.max_by("box", "ord").alias("box"))
    return last


def apply_gold(df: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold boxes replace those of df (box); rows without gold stay as they are."""
    g = gold_boxes(gold).withColumnRenamed("box", "_box").withColumn("_has", F.lit(True))
    return df.join(g, "uid", "left").withColumn("box", F.when(F.col("_has"), F.col("_box")).otherwise(F.col("box"))).drop("_box", "_has")


def upsert(df: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Edited values replace those of the same key; null edits keep the old value."""
    e = edits.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(e, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out


def join_detect(df: DataFrame, detections: DataFrame) -> DataFrame:
    return df.join(detections, "uid")


def join_classify(detections: DataFrame, classified: DataFrame) -> DataFrame:
    """Detections keyed uid_det%06d with their class; `decodable` is false where none is known."""
    keyed = detections.withColumn("id", F.format_string("%s_det%06d", F.col("uid").cast("string"), F.col("idx").cast("int")))
    return keyed.join(classified, "id", "left").withColumn("decodable", F.col("label").isNotNull())


def fill_gt(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    m = manifest.select("uid", F.col("gt_text").alias("_gt"))
    return rows.join(m, "uid", "left").withColumn("gt_text", F.coalesce(F.nullif(F.trim("gt_text"), F.lit("")), F.col("_gt"), F.lit(""))).drop("_gt")


def gallery(worst: DataFrame, manifest: DataFrame, detections: DataFrame) -> DataFrame:
    """Worst rows with their image and number of detections; rows without an image go."""
    n = detections.groupBy("uid").agg(F.count("*").alias("n_boxes"))
    return worst.join(manifest, "uid", "left").filter(F.col("image").isNotNull()).join(n, "uid", "left").na.fill(0, ["n_boxes"])


def anti_done(df: DataFrame, done: DataFrame, key: str = "uid") -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def cached_or_new(df: DataFrame, cache: DataFrame, compute, key: str = "uid") -> DataFrame:
    """Rows of the cache as they are, and compute(rows not in it)."""
    kept = cache.join(df.select(key).distinct(), key, "left_semi")
    return kept.unionByName(compute(anti_done(df, cache, key)))


def style_assign(df: DataFrame, styles: DataFrame, index: Column) -> DataFrame:
    return df.withColumn("style_idx", index).join(styles, "style_idx")


def restyle(df: DataFrame, path: Column, style: Column) -> DataFrame:
    """The record with another image path and style metadata; labels stay."""
    return df.withColumn("image_path", path).withColumn("meta", F.struct(F.lit(True).alias("styled"), style.alias("style")))


def build_manifest(mapping: DataFrame, meta: DataFrame, columns: list[str], listing: DataFrame, ratios=(0.8, 0.1, 0.1), strict: bool = False, drop_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """The manifest and its statistics by split.

    mapping (row_id, hebrew, english, transliteration, images) is joined with the metadata (ID and columns), exploded to
    one row per image, checked against the listing (path), given its text variants and split by row_id.
    """
    from .splits import split_greedy

    rows = join_metadata(mapping, meta, "row_id", "ID", columns)
    rows = explode_images(rows).withColumnRenamed("image", "path")
    rows = mark_exists(rows, listing.select("path"), "path")
    if strict or drop_missing:
        rows = filter_missing(rows, strict=strict)
    rows = rows.join(split_greedy(rows, "row_id", ratios).select("row_id", "split"), "row_id")
    out = rows.select("uid", "row_id", "path", "exists", "split", T.text_variants(F.col("hebrew")).alias("hebrew"), "english", "transliteration", F.struct(*columns).alias("csv"))
    stats = out.groupBy("split").agg(F.count("*").alias("n"), F.count_if(~F.col("exists")).alias("missing"), F.countDistinct("row_id").alias("groups"))
    return out, stats


def resume_batch(todo: DataFrame, done: DataFrame, transform, shards: int, path: str, key: str = "uid") -> DataFrame:
    """Records not done yet go through transform and are appended to the shard files below path; then all shards, old
    records (shard -1) first, are merged, the last record of a key winning. Run again, it finds nothing new to do."""
    from ..sources import io
    from .splits import merge_last_wins

    spark = todo.sparkSession
    kind = ", ".join(f"{c} {t}" for c, t in done.dtypes)
    written = io.read_jsonl_lenient(spark, path, kind, nested=True)
    new = transform(anti_done(anti_done(todo, done, key), written, key)).withColumn("shard_id", T.shard_of(F.col(key), shards))
    new.write.mode("append").partitionBy("shard_id").json(path)
    made = io.read_jsonl_lenient(spark, path, kind, nested=True)
    both = done.withColumn("_new", F.lit(0)).unionByName(made.select(*done.columns).withColumn("_new", F.lit(1)))
    return merge_last_wins(both, key, ["_new"]).drop("_new")


def orient_rows(df: DataFrame, rotations: DataFrame, readings: DataFrame, n: int | None = None, seed: int = 42, chars: str = "֐-׿") -> DataFrame:
    """The manifest (uid, gt_text, meta struct) with orientation, mirroring and reading direction written into meta for a
    sample of n rows (all, if n is None).

    rotations: (uid, angle, proj, cc, penalty, density, lines); readings: (uid, mirrored, reverse, text) of four candidates.
    Joins merge, as all sides grow with the manifest and none of them is to pass through the driver.
    """
    from .splits import sample_n

    some = df if n is None else sample_n(df, n, seed)
    picked = rotation_pick(rotations.join(some.select("uid").hint("merge"), "uid", "left_semi"))
    picked = picked.join(rotations.select("uid", "angle", "cc", "density", "lines").hint("merge"), ["uid", "angle"])
    scored = readings.join(some.select("uid", "gt_text").hint("merge"), "uid").withColumn("quality", reading_quality(F.col("text"), F.col("gt_text"), chars))
    both = picked.join(mirror_pick(scored).hint("merge"), "uid", "left")
    both = both.select("uid", F.struct(F.col("angle").alias("orientation_deg"), F.col("confidence").alias("orientation_confidence"), F.col("density").alias("binarize_density"), F.col("lines").alias("n_lines_est"), F.col("cc").alias("cc_score"), "mirrored", F.coalesce("reverse", F.lit(True)).alias("reverse_pred"), F.lit("rtl").alias("reading_dir")).alias("_o"))
    out = df.join(both.hint("merge"), "uid", "left")
    kept = [f for f in df.schema["meta"].dataType.names]
    meta = F.struct(*[F.col(f"meta.{f}").alias(f) for f in kept], *[F.col(f"_o.{f}").alias(f) for f in both.schema["_o"].dataType.names])
    return out.withColumn("meta", meta).drop("_o")


def orient_manifest(df: DataFrame, rotations: DataFrame, readings: DataFrame, n: int | None = None, seed: int = 42, chars: str = "֐-׿") -> tuple[DataFrame, DataFrame]:
    """What `orient_rows` gives, and the statistics of what was written."""
    out = orient_rows(df, rotations, readings, n, seed, chars)
    return out, orientation_stats(out.filter("meta.orientation_deg IS NOT NULL").select("meta.*"))


def orientation_stats(rows: DataFrame) -> DataFrame:
    """(measure, key, value): counts by rotation, mirroring and reversal; mean and median of three measures.

    The rows are read once and leave as counts of distinct values, which are written; all figures come from those.
    """
    from ..sources.io import kept
    from .evaluation import medians

    named = {"rotation": F.col("orientation_deg").cast("string"), **{c: F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("mirrored", "reverse_pred")}}
    measures = ("orientation_confidence", "binarize_density", "n_lines_est")
    none = F.lit(None)
    long = [F.struct(F.lit(m).alias("measure"), k.alias("key"), none.cast("double").alias("v")) for m, k in named.items()]
    long += [F.struct(F.lit(m).alias("measure"), none.cast("string").alias("key"), F.col(m).cast("double").alias("v")) for m in measures]
    counted = kept(rows.select(F.explode(F.array(*long)).alias("r")).select("r.*").groupBy("measure", "key", "v").agg(F.count("*").alias("n")), "measures")
    counts = counted.filter(F.col("measure").isin(*named)).select("measure", "key", F.col("n").cast("double").alias("value"))
    values = counted.filter(F.col("measure").isin(*measures) & F.col("v").isNotNull())
    means = values.groupBy("measure").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("value")).withColumn("key", F.lit("mean"))
    middle = medians(values, ["measure"], "v", "n").select("measure", F.col("median").alias("value"), F.lit("median").alias("key"))
    wanted = rows.sparkSession.createDataFrame([(m, k) for m in measures for k in ("mean", "median")], "measure string, key string")
    found = wanted.join(means.unionByName(middle), ["measure", "key"], "left").select("measure", "key", F.coalesce("value", F.lit(0.0)).alias("value"))
    return counts.unionByName(found)


def yolo_export(boxes: DataFrame, listing: DataFrame, candidates: list[str], path: str) -> DataFrame:
    """Writes the label files of boxes (split, uid, idx, cls, box, candidate paths) whose image the listing has.

    Gives (split, written, skipped): images by split.
    """
    from ..sources import io

    images = boxes.select("split", "uid", *candidates).distinct()
    found = images.join(resolve_path(images, listing, candidates), "uid").withColumn("exists", F.col("resolved").isNotNull())
    kept = boxes.join(filter_missing(found).select("uid"), "uid", "left_semi")
    io.write_yolo(kept, path)
    return found.groupBy("split").agg(F.count_if("exists").alias("written"), F.count_if(~F.col("exists")).alias("skipped"))


def explode_boxes(df: DataFrame, boxes: str = "boxes", scores: str = "scores") -> DataFrame:
    """One row per box; missing scores are 0; rows without uid go."""
    rows = df.filter("uid IS NOT NULL").select("uid", F.posexplode(F.arrays_zip(F.col(boxes).alias("b"), F.col(scores).alias("s"))).alias("idx", "z"))
    return rows.filter("z.b IS NOT NULL").select("uid", F.col("idx").cast("long").alias("idx"), "z.b.*", F.coalesce("z.s", F.lit(0.0)).alias("score"))


def crops_topk(det: DataFrame, k: int, least: float, width: Column, height: Column, pad: float = 0.05) -> DataFrame:
    """The first k crops of each image by score; unscored boxes pass the limit and sort as 0, empty crops do not count."""
    b = F.struct("x1", "y1", "x2", "y2")
    rows = det.withColumn("crop", B.crop_box(b, pad, width, height)).filter((F.col("score").isNull() | (F.col("score") >= least)) & F.col("crop").isNotNull())
    w = Window.partitionBy("uid").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "idx")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def reading_quality(text: Column, gt: Column, chars: str = "֐-׿") -> Column:
    """How well a candidate reads: minus its CER (blanks left out) plus 0.15 times the share of script characters where
    there is ground truth, else that share plus 0.01 for each of up to 40 characters."""
    plain, truth = F.regexp_replace(T.blanks(text), r"\s+", ""), F.regexp_replace(gt, r"\s+", "")
    ratio = T.script_ratio(T.blanks(text), chars)
    guess = ratio + 0.01 * F.least(F.lit(40), F.length(plain))
    return F.when(F.coalesce(truth, F.lit("")) != "", -T.cer(truth, plain) + 0.15 * ratio).otherwise(guess)


def rotation_pick(cands: DataFrame, key: str = "uid") -> DataFrame:
    """(key, angle, confidence) from rows (key, angle, proj, cc, penalty): least angle among equal scores."""
    rows = cands.withColumn("total", F.col("proj") + 0.15 * F.col("cc") + F.col("penalty"))
    w = Window.partitionBy(key).orderBy(F.desc("total"), "angle")
    best = rows.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("total").over(w)).filter("rn = 1")
    return best.select(key, "angle", ((F.col("total") - F.coalesce("second", F.lit(0.0))) / (F.abs("total") + 1e-6)).alias("confidence"))


def mirror_pick(cands: DataFrame, key: str = "uid", margin: float = 0.05) -> DataFrame:
    """(key, mirrored, reverse) from rows (key, mirrored, reverse, quality): mirrored is null unless the best mirrored
    and straight readings differ by the margin."""
    rank = F.struct(F.col("quality"), (~F.col("mirrored")).alias("a"), (~F.col("reverse")).alias("b"))
    out = cands.groupBy(key).agg(F.max_by("reverse", rank).alias("reverse"), F.max(F.when(F.col("mirrored"), F.col("quality"))).alias("m"), F.max(F.when(~F.col("mirrored"), F.col("quality"))).alias("s"))
    decided = F.coalesce(F.abs(F.col("m") - F.col("s")) >= margin, F.lit(False))
    return out.select(key, F.when(decided, F.col("m") > F.col("s")).alias("mirrored"), "reverse")


def fingerprint_sets(df: DataFrame, by: list[str], value: str, large: bool = False, length: int = 16) -> DataFrame:
    """(by, print): a digest of the set of values, whatever their order and repeats; null values do not count.

    Small sets are sorted and joined by commas, with their size. large: sets of any size, as sums of two 60-bit parts of
    each value's SHA-256 and the size, so that nothing is gathered; only equal sets have equal digests, but for chance.
    """
    values = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("string").alias("_v")).distinct()
    digest = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, length)
    if large:
        h = F.sha2(F.col("_v").cast("binary"), 256)
        part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
        return values.groupBy(*by).agg(digest(F.concat_ws(":", part(1), part(16), F.count("*").cast("string"))).alias("print"))
    g = values.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("s"))
    return g.select(*by, digest(F.concat(F.array_join("s", ","), F.lit(":"), F.size("s").cast("string"))).alias("print"))
