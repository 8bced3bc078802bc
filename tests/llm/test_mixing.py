"""The mix: targets against a plain water filling, balance, and what no document may exceed."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpusops.llm import mixing as X

KIND = "doc_id bigint, text string, lang string, source string, size string, h int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, budget = {}, set(names), Fraction(3, 2) * sum(sizes.values())
    while free:
        level = budget / sum(w[s] for s in free)
        above = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not above:
            return target | {s: float(w[s] * level) for s in free}
        for s in above:
            target[s] = float(2 * sizes[s])
            budget -= 2 * sizes[s]
        free -= above
    return target


def check(spark, rows, slack):
    df = spark.createDataFrame([(i, t, "l", s, "clash", 1) for i, t, s in rows], KIND)
    got = X.mix(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    of = {i: (len(WORD.findall(t or "")), s) for i, t, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        size, source = of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size, sizes[source]) and r["target"] == pytest.approx(want[source], rel=1e-12, abs=1e-9)
        assert 0 <= r["taken"] <= 2 * size and (not size or r["taken"] % size == 0)
        taken[source] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack, (s, taken[s], want[s])
    again = X.mix(df.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    return got


def test_targets_balance_and_reruns(spark):
    roll = random.Random(4)
    text = lambda: " ".join("w" * roll.randint(1, 5) for _ in range(int(roll.paretovariate(0.8)) % 3000))
    rows = [(i, text(), roll.choice(["a", "b", "b", "b", "", "\U00010000", "é", None])) for i in range(4000)]
    rows += [(10_000 + i, text(), "small") for i in range(30)] + [(20_000, None, "void"), (20_001, " \t\x0b\n", "void"), (20_002, "a b c", "one")]
    check(spark, rows, 3)


def test_documents_balance_too_before_the_landing():
    roll = random.Random(1)
    size, p = [roll.randint(0, 500) for _ in range(3000)], [0.375] * 3000
    words, docs = sum(a * b for a, b in zip(p, size)), sum(p)
    open_ = X.fly(p, size, list(range(3000)), roll.random)
    assert len(open_) <= 2 and all(p[i] in (0, 1) for i in range(3000) if i not in open_)
    assert sum(a * b for a, b in zip(p, size)) == pytest.approx(words) and sum(p) == pytest.approx(docs)


def test_flight_keeps_probabilities():
    hits, roll = [0] * 6, random.Random(2)
    for _ in range(4000):
        p = [0.3] * 6
        for i in X.fly(p, [1, 5, 7, 2, 2, 9], list(range(6)), roll.random):
            p[i] = float(roll.random() < p[i])
        hits = [h + x for h, x in zip(hits, p)]
    assert all(abs(h / 4000 - 0.3) < 0.03 for h in hits)


def test_landing_finds_the_nearest_set():
    p, size = [0.5] * 12, [2**i for i in range(11)] + [1000]
    X.land(p, size, list(range(12)))
    assert set(p) <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(p, size)) - (2047 + 1000) / 2) <= 0.5
    many = [0.5] * 30
    X.land(many, [2**i for i in range(30)], list(range(30)))
    assert abs(sum(a * 2**i for i, a in enumerate(many)) - (2**30 - 1) / 2) <= 0.5


def test_large_blocks_of_equal_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c", "l", "x", "c", 1)], KIND).crossJoin(spark.range(6000)).drop("id").unionByName(spark.createDataFrame([(1, "a " * 9000, "l", "y", "c", 1), (1, "b", "l", "y", "c", 1)], KIND))
    got = X.mix(df)
    assert got.count() == 6002
    t = {r["source_size"]: (r["taken"], r["target"]) for r in got.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(a - b) <= 4501 for a, b in t.values()) and abs(t[18000][0] - t[18000][1]) <= 3


def test_empty_table(spark):
    got = X.mix(spark.createDataFrame([], KIND))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and got.count() == 0
