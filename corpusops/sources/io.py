"""Sources and sinks: manifests, metadata, label formats, listings, run folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of the session. Only a session in one process may do without: it gets a folder
    of its own machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.sparkContext._jvm.java.nio.file.Files.createTempDirectory("corpusops").toString()
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A malformed line raises; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str, nested: bool = False) -> DataFrame:
    """A missing path is an empty table; malformed lines go. nested: files in folders below, whatever their names say."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    kind = f"{schema}, _bad STRING"
    rows = spark.read.option("recursiveFileLookup", nested).text(path).filter(F.trim("value") != "")
    return rows.select(F.from_json("value", kind, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).filter("r._bad IS NULL").select("r.*").drop("_bad")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, all columns strings."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def read_metadata_csv(spark: SparkSession, path: str, key: str = "ID") -> DataFrame:
    rows = read_csv(spark, path)
    if key not in rows.columns:
        raise ValueError(f"{path} has no column {key}")
    return rows.withColumn(key, F.trim(key))


def _running(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the sum of value over what comes earlier in a file: inside its byte range, and over the ranges."""
    inside = Window.partitionBy("file", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = df.groupBy("file", "block").agg(F.sum(value).alias("_t"))
    starts = ranges.select("file", "block", F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_o"))
    rows = df.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, ["file", "block"])
    return rows.withColumn(out, F.col("_i") + F.col("_o")).drop("_i", "_o")


def json_members(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, i, key, value): the members of the JSON object that each file of path is, values as JSON text.

    A file is read by byte ranges, whatever its size and its line ends: pieces end at closing braces, as Spark's text
    source cuts them. A piece is counted for both cases, that it starts in a string or not; running sums of quotes tell
    which one holds, running sums of brackets how deep it is. Members of depth 1 are put together and parsed each by
    itself, with those beside it that are no objects. (block, i) is the order in the file.
    """
    read = spark.read.option("lineSep", "}").text(path)
    pieces = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    count = lambda text, others: F.length(F.regexp_replace(text, others, ""))
    quotes = count(plain, r'[^"]')

    def deeper(inside: int) -> Column:
        code = F.regexp_replace(F.concat(F.lit('"' * inside), plain), r'"[^"]*("|\z)', "")
        closes = F.when((quotes + inside) % 2 == 0, 1).otherwise(0)
        return count(code, r"[^\[{]") - count(code, r"[^\]]") - closes

    pieces = kept(pieces.select("*", quotes.alias("quotes"), deeper(0).alias("d0"), deeper(1).alias("d1")), "json-pieces")
    rows = _running(pieces.drop("value"), "quotes", "q")
    rows = _running(rows.withColumn("d", F.when(F.col("q") % 2 == 0, F.col("d0")).otherwise(F.col("d1"))), "d", "depth")
    outside = (F.col("q") + F.col("quotes")) % 2 == 0
    end = F.col("depth") + F.col("d")
    rows = _running(rows.filter("depth + d >= 0").withColumn("ends", F.when(outside & (end == 1), 1).otherwise(0)), "ends", "member")
    rows = rows.select("file", "block", "i", "member", (outside & (end == 0)).alias("root"))
    whole = F.concat("value", F.when(F.col("root"), "").otherwise("}")).alias("text")
    members = rows.join(pieces.select("file", "block", "i", "value"), ["file", "block", "i"]).groupBy("file", "member").agg(F.sort_array(F.collect_list(F.struct("block", "i", whole))).alias("t"))
    text = F.regexp_replace(F.array_join(F.transform("t", lambda x: x["text"]), ""), "^\ufeff?\\s*[{,]", "")
    made = members.select("file", F.col("t")[0]["block"].alias("block"), F.col("t")[0]["i"].alias("i"), F.from_json(F.concat(F.lit("{"), text, F.lit("}")), "map<string,string>").alias("m"))
    return made.select("file", "block", "i", F.posexplode("m").alias("pos", "key", "value"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object {row_id: {Hebrew, English, Transliteration, Images}}; of a repeated key the last entry counts,
    entries that are no objects go."""
    last = json_members(spark, path).groupBy("file", F.col("key").alias("row_id")).agg(F.max_by("value", F.struct("block", "i", "pos")).alias("entry"))
    entries = last.filter(F.startswith(F.trim("entry"), F.lit("{")))
    e = F.from_json("entry", "Hebrew STRING, English STRING, Transliteration STRING, Images STRING")
    images = F.coalesce(F.from_json(e["Images"], "array<string>"), F.array().cast("array<string>"))
    return entries.select("row_id", e["Hebrew"].alias("hebrew"), e["English"].alias("english"), e["Transliteration"].alias("transliteration"), images.alias("images"))


def write_joined(sections: list[tuple[str, DataFrame]], end: str, path: str) -> str:
    """One text file below path: of each section its opening and its texts (k, value), a line each, in order of the number
    k and with commas between; then the end.

    The order is made by ranges in parallel; as it is one file, one task writes it, row after row, and no row holds more
    than one text.
    """
    bodies = [df.select(F.lit(2 * s + 1).alias("s"), F.col("k").cast("long").alias("k"), "value") for s, (_, df) in enumerate(sections)]
    rows = bodies[0]
    for more in bodies[1:]:
        rows = rows.unionByName(more)
    rows = kept(rows.withColumn("u", F.monotonically_increasing_id()), "joined-rows")
    first = [r["f"]["u"] for r in rows.groupBy("s").agg(F.min(F.struct("k", "u")).alias("f")).collect()]  # one a section
    texts = rows.select("s", "k", "u", F.concat(F.when(F.col("u").isin(first), "").otherwise(","), "value").alias("value"))
    marks = [(2 * s, 0, 0, opening) for s, (opening, _) in enumerate(sections)] + [(2 * len(sections), 0, 0, end)]
    lines = texts.unionByName(rows.sparkSession.createDataFrame(marks, "s int, k long, u long, value string"))
    lines.orderBy("s", "k", "u").select("value").coalesce(1).write.text(path)
    return path


def read_binary(spark: SparkSession, path: str, suffixes: str = "*", whole: int = 1 << 28) -> DataFrame:
    """(path, name, size, sha256, format, width, height, error) of each file; what is no whole image has an error that
    says why. Files up to whole bytes are read once, in a row each, larger ones by ranges (`large_files`) - but for packed
    files, which Spark's text source would unpack."""
    from ..functions.images import header
    from .large import PACKED, large_files, resumable

    options = {"recursiveFileLookup": True, "pathGlobFilter": suffixes}
    files = spark.read.format("binaryFile").options(**options).load(path)
    large, packed = F.col("_metadata.file_size") > whole, F.col("_metadata.file_path").rlike(PACKED)
    own = lambda df: df.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), header(F.col("content")).alias("h"))
    # filters on metadata choose files before these are opened
    if resumable() and files.filter(large & ~packed).select("path").limit(1).count():
        lines = spark.read.options(lineSep="\n", **options).text(path)
        rows = own(files.filter(~large)).unionByName(own(files.filter(large & packed))).unionByName(large_files(lines, whole))
    else:
        rows = own(files)
    rows = rows.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "size", "sha256", "h.format", "h.width", "h.height", "h.error")


def find_in_archive(listing: DataFrame, suffix: str, path: str = "path") -> DataFrame:
    """The shortest inner path (first by name among equals) that ends in suffix."""
    return listing.filter(F.endswith(F.col(path), F.lit(suffix))).select(path).orderBy(F.length(path), path).limit(1)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path).select(F.trim("value").alias("word"))
    return lines.filter((F.col("word") != "") & ~F.startswith("word", F.lit("#")))


def read_run_dirs(spark: SparkSession, path: str, files: dict[str, str]) -> DataFrame:
    """(run_id, a struct for each file): one row per run folder path/run=ID, from JSON files of the given schemas.

    A file is path/run=ID/NAME or a part of the folder path/run=ID/file=NAME; what a run does not have is null. A file
    that is no JSON has null fields.
    """
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    rows = texts.select(F.regexp_extract(where, r"/run=([^/]+)/", 1).alias("run_id"), F.regexp_extract(where, r"/run=[^/]+/(?:file=)?([^/]+)", 1).alias("file"), "value")
    made = rows.filter("run_id <> ''").groupBy("run_id").agg(*[F.max(F.when(F.col("file") == n, F.col("value"))).alias(f"_{k}") for k, n in enumerate(files)])
    return made.select("run_id", *[F.from_json(f"_{k}", schema).alias(n.rsplit(".", 1)[0]) for k, (n, schema) in enumerate(files.items())])


def read_label_studio(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(uid, x, y, width, height, label): human annotations where there are any, else predictions."""
    result = "array<struct<type:string,value:struct<x:double,y:double,width:double,height:double,rectanglelabels:array<string>>>>"
    tasks = spark.read.schema(f"data struct<image:string,uid:string>, annotations array<struct<result:{result}>>, predictions array<struct<result:{result}>>").option("multiLine", multi_line).json(path)
    sets = F.when(F.size(F.coalesce("annotations", F.array())) > 0, F.col("annotations")).otherwise(F.col("predictions"))
    r = tasks.select("data.uid", F.explode(sets).alias("s")).select("uid", F.explode("s.result").alias("r")).filter("r.type = 'rectanglelabels'")
    return r.select("uid", "r.value.x", "r.value.y", "r.value.width", "r.value.height", F.coalesce(F.get("r.value.rectanglelabels", F.lit(0)), F.lit("glyph")).alias("label"))


def read_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(uid, boxes array<struct<x1,y1,x2,y2,label>>); images without annotations keep an empty array."""
    b = annotations.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id", "left")
    xy = F.struct(F.col("bbox")[0].alias("x1"), F.col("bbox")[1].alias("y1"), (F.col("bbox")[0] + F.col("bbox")[2]).alias("x2"), (F.col("bbox")[1] + F.col("bbox")[3]).alias("y2"), F.coalesce("name", F.lit("glyph")).alias("label"))
    boxes = b.groupBy("image_id").agg(F.sort_array(F.collect_list(xy)).alias("boxes"))
    return images.join(boxes, images["id"] == boxes["image_id"], "left").select("uid", F.coalesce("boxes", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,label:string>>")).alias("boxes"))


def read_yolo(spark: SparkSession, path: str) -> DataFrame:
    """(uid, cls, cx, cy, w, h) of lines with exactly five fields; uid is the file stem."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("uid"), F.split(F.trim("value"), r"\s+").alias("f"))
    return lines.filter(F.size("f") == 5).select("uid", F.col("f")[0].cast("int").alias("cls"), *[F.col("f")[i].cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)])


def yolo_line(cls: Column, b: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, b["cx"], b["cy"], b["w"], b["h"])


def write_yolo(boxes: DataFrame, path: str, by: str = "split") -> str:
    """Label files of boxes (by, uid, idx, cls, box<cx,cy,w,h>): one row {name, content} for each image, packed in JSONL
    by split, as a file system does not hold a file for each of very many images."""
    lines = boxes.groupBy(by, "uid").agg(F.sort_array(F.collect_list(F.struct("idx", yolo_line(F.col("cls"), F.col("box")).alias("line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    lines.select(by, F.concat(F.col("uid").cast("string"), F.lit(".txt")).alias("name"), text.alias("content")).write.partitionBy(by).json(path)
    return path


def read_yolo_packed(spark: SparkSession, path: str, by: str = "split") -> DataFrame:
    """(by, uid, line_no, cls, cx, cy, w, h) of the lines with exactly five fields."""
    rows = spark.read.schema(f"name STRING, content STRING, {by} STRING").json(path)
    lines = rows.select(by, F.regexp_replace("name", r"\.txt$", "").alias("uid"), F.posexplode(F.split("content", "\n", -1)).alias("line_no", "value"))
    lines = lines.withColumn("f", F.split(F.trim("value"), r"\s+")).filter(F.size("f") == 5)
    return lines.select(by, "uid", "line_no", F.col("f")[0].cast("int").alias("cls"), *[F.col("f")[i].cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)])


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, single: bool = False) -> str:
    """images, annotations and categories as JSONL folders below path; single: also all in one COCO file, in order of id,
    below path/coco.json."""
    tables = (("images", images), ("annotations", annotations), ("categories", categories))
    for name, df in tables:
        df.write.json(f"{path}/{name}")
    if single:
        rows = [df.select(F.col("id").alias("k"), F.to_json(F.struct(*df.columns)).alias("value")) for _, df in tables]
        openings = ['{"images":[', '],"annotations":[', '],"categories":[']
        write_joined(list(zip(openings, rows)), "]}", f"{path}/coco.json")
    return path


def class_index(boxes: DataFrame, letters: list[str], split: str | None = None) -> DataFrame:
    """Rows of the crop index from (split, uid, idx, letter, src, x1, y1, x2, y2): only known letters, boxes with an area,
    and the split asked for; class folder NN_name_letter and path of the crop."""
    from ..functions import text as T

    rows = boxes.filter(F.col("letter").isin(letters) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    rows = rows.filter(F.lower("split") == split.lower()) if split else rows
    folder = T.class_name(F.col("letter")) if set(letters) <= set(T.LETTERS) else F.col("letter")
    rows = rows.withColumn("class_folder", folder)
    name = F.format_string("%s_%03d.png", T.safe_stem(F.col("uid").cast("string")), F.col("idx").cast("int"))
    box = F.format_string("%d,%d,%d,%d", *[F.bround(c).cast("int") for c in ("x1", "y1", "x2", "y2")])
    return rows.select("split", F.col("class_folder").alias("class"), "letter", "uid", "idx", "src", box.alias("bbox"), F.concat_ws("/", "split", "class_folder", name).alias("out_path"))


def write_result_tables(tables: dict[str, DataFrame], summary: dict[str, str], spark: SparkSession, path: str) -> str:
    """Each table as header CSV below path, and run_summary.json with the summary and the tables' row counts."""
    counts = {}
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}")
        counts[f"{name}_rows"] = str(read_csv(spark, f"{path}/{name}").count())
    spark.createDataFrame([(k, v) for k, v in sorted({**summary, **counts}.items())], "key string, value string").coalesce(1).write.json(f"{path}/run_summary.json")
    return path


def coco_annotations(boxes: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, image_id, category_id, bbox, area, score): dense ids from 1 in order of (uid, idx); unknown labels go.

    Ids are a prefix sum over images, so no window spans all boxes.
    """
    known = boxes.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("label")), "label").join(images.select(F.col("id").alias("image_id"), "uid"), "uid")
    sizes = known.groupBy("image_id").agg(F.count("*").alias("n"))
    starts = prefix_sums(sizes, "image_id", "n", "start")
    rank = F.row_number().over(_window("image_id", "idx"))
    out = known.join(starts, "image_id").withColumn("id", (F.col("start") + rank).cast("long"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return out.select("id", "image_id", "category_id", F.array("x1", "y1", w, h).alias("bbox"), (w * h).alias("area"), "score")


def _window(part: str, order: str):
    return Window.partitionBy(part).orderBy(order)


def prefix_sums(df: DataFrame, order: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """Sum of value over rows of smaller order (a non-negative whole number), in two levels of blocks of that order."""
    block = F.floor(F.col(order) / width)
    within = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_b", block).withColumn("_w", F.coalesce(F.sum(value).over(within), F.lit(0)))
    totals = df.groupBy(block.alias("_b")).agg(F.sum(value).alias("_t"))
    upper = totals.withColumn("_c", F.floor(F.col("_b") / width))
    across = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.withColumn("_u", F.coalesce(F.sum("_t").over(across), F.lit(0)))
    tops = upper.groupBy("_c").agg(F.sum("_t").alias("_s"))  # one row for width * width values of order
    tops = tops.withColumn("_v", F.coalesce(F.sum("_s").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = upper.join(tops, "_c").select("_b", (F.col("_u") + F.col("_v")).alias("_o"))
    return rows.join(starts, "_b").withColumn(out, F.col("_w") + F.col("_o")).drop("_b", "_w", "_o")


def label_studio_tasks(boxes: DataFrame, sizes: DataFrame, version: str = "model") -> DataFrame:
    """(value): JSON task of each uid, boxes in percent, result ids uid_i."""
    from ..functions.boxes import to_pct

    b = F.struct("x1", "y1", "x2", "y2")
    joined = boxes.join(sizes, "uid").withColumn("p", to_pct(b, F.col("width"), F.col("height")))
    value = F.struct("p.x", "p.y", "p.width", "p.height", F.array("label").alias("rectanglelabels"))
    result = F.struct(F.col("idx"), F.concat_ws("_", F.col("uid").cast("string"), F.col("idx").cast("string")).alias("id"), F.lit("rectanglelabels").alias("type"), value.alias("value"))
    grouped = joined.groupBy("uid").agg(F.sort_array(F.collect_list(result)).alias("r"))
    data = F.struct(F.concat(F.lit("img/"), F.col("uid").cast("string")).alias("image"), F.col("uid").cast("string").alias("uid"))
    predictions = F.array(F.struct(F.lit(version).alias("model_version"), F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), x["value"].alias("value"))).alias("result")))
    return grouped.select(F.to_json(F.struct(data.alias("data"), predictions.alias("predictions"))).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> str:
    df.write.mode(mode).json(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


def flat_manifest(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Nested fields as flat columns, by dotted path."""
    return df.select(*[F.col(path).alias(name) for name, path in fields.items()])
