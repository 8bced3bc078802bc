"""Hand-made rows with literal expectations."""

import pytest
from pyspark.sql import functions as F

from corpusops.functions import boxes as B
from corpusops.functions import text as T
from corpusops.functions import vectors as V


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("ref,pred,want", [("", "", 0.0), ("", "ab", 1.0), ("abcd", "abxd", 0.25), ("é", "e", 1.0), (None, None, 0.0)])
def test_cer(spark, ref, pred, want):
    df = spark.createDataFrame([(ref, pred)], "r string, p string")
    assert df.select(T.cer(F.col("r"), F.col("p")).alias("x")).first()["x"] == want


def test_wer(spark):
    assert one(spark, T.wer(F.lit("a b c d"), F.lit("a x c"))) == 0.5


def test_text_variants(spark):
    v = one(spark, T.text_variants(F.lit(" a [b]\tc ")))
    assert (v["stripped"], v["collapsed_ws"], v["no_space"], v["no_brackets"]) == ("a [b]\tc", "a [b] c", "a[b]c", "a b c")
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(T.text_variants(F.col("t"))["no_space"].alias("x")).first()["x"] is None


def test_scripts(spark):
    assert one(spark, T.apply_final_forms(F.lit("שלומ נ"))) == "שלום נ"
    got = [one(spark, T.normalize_letter(F.lit(x))) for x in ("ך", " א ", "x", "")]
    assert got == ["כ", "א", None, None]
    assert one(spark, T.normalize_script(F.lit("שָׁלוֹם, x  \n עולם"))) == "שלומ\nעולמ"
    assert one(spark, T.class_name(F.lit("א"))) == "01_aleph_א"
    assert one(spark, T.cleanup_text(F.lit("[?][?][?]א"))) == "[?][?]א"


def test_keys(spark):
    assert one(spark, T.shard_of(F.lit("syn_000001"), 7)) == 5
    assert one(spark, T.parse_weights(F.lit("a:0.7, b:-2"), ["a", "b", "c"])) == [0.7, 0.0, 0.0]
    assert one(spark, T.parse_weights(F.lit("a:0"), ["a"])) is None


def test_boxes(spark):
    b = one(spark, B.clamp_box(B.box(*map(F.lit, (500, 500, 600, 600))), F.lit(100), F.lit(50)))
    assert (b["x1"], b["x2"], b["y1"], b["y2"]) == (99, 100, 49, 50)
    same = B.box(*map(F.lit, (0, 0, 2, 2)))
    assert one(spark, B.iou(same, same)) == 1.0
    assert one(spark, B.iou(same, B.box(*map(F.lit, (5, 5, 5, 5))))) == 0.0
    assert one(spark, B.crop_box(B.box(*map(F.lit, (500, 0, 600, 10))), 0.1, F.lit(100), F.lit(100))) is None


def test_vectors(spark):
    classes = F.array(F.lit("a"), F.lit("<blank>"))
    assert one(spark, V.pick_char(F.array(F.lit(0.5), F.lit(0.5)), classes)) == "a"
    assert one(spark, V.pick_char(F.array(F.lit(0.34), F.lit(0.33)), classes)) == "[?]"
    assert one(spark, V.pick_char(F.array(F.lit(0.1), F.lit(0.9)), classes)) == "[?]"
    assert one(spark, V.normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.5, 0.5]
    topk = F.array().cast("array<struct<label:string,conf:double>>")
    assert one(spark, V.topk_to_probs(topk, classes)) == [0.0, 0.0]


def test_names_that_must_match(spark):
    assert T.NAMES[0] == "aleph" and len(T.NAMES) == len(T.LETTERS) == 22


def test_keys_do_not_depend_on_the_order_of_fields(spark):
    a, b = F.lit(1), F.lit("x")
    assert one(spark, T.canonical_key({"a": a, "b": b})) == one(spark, T.canonical_key({"b": b, "a": a}))


def test_models_of_names(spark):
    got = [one(spark, T.model_of(F.lit(x), ["sweep_real__", "sweep__"], ["_ph1", "_ph0"])) for x in ("sweep_real__yolo_ph1", "sweep__yolo_ph0_x", "other", "a_ph0_ph1")]
    assert got == ["yolo", "yolo", "other", "a_ph0"]


def test_wer_of_many_tokens(spark):
    """More distinct tokens than there are characters below the surrogates."""
    n = 60_000
    a = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: i.cast("string"))
    many = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string"))
    code = F.when(F.lit(n) + 255 < 0xD800, 0).otherwise(1)
    assert one(spark, code) == 1 and one(spark, T.word_edits(a, a)) == 0
    sign = F.decode(F.unhex(F.lpad(F.hex(F.array_position(many, F.lit(str(n))) + 255 + 0x800), 8, "0")), "UTF-32")
    assert one(spark, F.length(sign)) == 1


def test_top_k(spark):
    classes = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    got = one(spark, V.top_k(F.array(F.lit(0.2), F.lit(0.6), F.lit(0.2)), classes, 2))
    assert [(x["label"], x["conf"]) for x in got] == [("b", 0.6), ("a", 0.2)]
