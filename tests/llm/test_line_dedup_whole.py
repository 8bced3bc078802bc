"""Line dedup against brute force where buckets are crowded, words are long and lines are short."""

import itertools
import random

import pytest

pytest.importorskip("corpusops.llm")
from corpusops.llm import line_dedup  # noqa: E402


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def similarity(x, y):
    a, b = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (x, y))
    return len(a & b) / len(a | b)


def groups(texts):
    least = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if least[a] != least[b] and similarity(texts[a], texts[b]) >= 0.8:
                least[a] = least[b] = min(least[a], least[b])
    return least


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 7)
    random.seed(7)
    word = lambda n: "".join(random.choice("abcdefghijklmnop") for _ in range(n))
    common = word(200)
    texts = []
    for _ in range(40):  # lines of one bucket, similar in pairs only
        line = common + word(120)
        texts += [line, line[:-4] + word(4)]
    want = groups(texts)
    assert len(set(want)) == 40
    got = {r["doc_id"]: r["kept_doc_id"] for r in line_dedup.removed_lines(docs(spark, texts)).collect()}
    assert got == {i: k for i, k in enumerate(want) if i != k}


def test_whole_words_count(spark):
    random.seed(8)
    word = lambda n: "".join(random.choice("0123456789abcdef") for _ in range(n))
    tail = word(90)
    texts = ["https://" + word(40), "https://" + word(40), "x" + tail, "y" + tail, "internationale " + word(40), "internationale " + word(40)]
    got = sorted((r["doc_id"], r["kept_doc_id"]) for r in line_dedup.removed_lines(docs(spark, texts)).collect())
    assert got == [(3, 2)]


def test_short_lines_go_as_exact_copies(spark):
    d = docs(spark, ["Les.\n\n \t\nYes", "les. \n\n \t", "Lea."])
    got = sorted((r["doc_id"], r["line_no"], r["kept_doc_id"], r["kept_line_no"]) for r in line_dedup.removed_lines(d, shortest=1).collect())
    assert got == [(1, 0, 0, 0)]
