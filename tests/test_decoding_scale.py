"""Lines are grouped in Arrow batches, not by higher-order functions row by row, with the results of the plain rule."""

import random

import numpy as np
from corpusops.operators import decoding as D
from pyspark.sql import functions as F

KIND = "uid long, idx long, ch string, x1 double, y1 double, x2 double, y2 double"


def _greedy(boxes, low, high, threshold):
    """Groups of tokens, one after another."""
    groups, at = [], []
    for b in boxes:
        for k, g in enumerate(groups):
            union, shared = max(g[1], b[high]) - min(g[0], b[low]), max(min(g[1], b[high]) - max(g[0], b[low]), 0)
            if union > 0 and shared / union >= threshold:
                groups[k] = (min(g[0], b[low]), max(g[1], b[high]))
                at.append(k)
                break
        else:
            at.append(len(groups))
            groups.append((b[low], b[high]))
    return at


def _text(boxes):
    """boxes (cy, cx, idx, ch, x1, y1, x2, y2) by the plain rule, from the right."""
    boxes = sorted(boxes)
    both = {}
    for name, low, high in (("v", 4, 6), ("h", 5, 7)):
        at = _greedy(boxes, low, high, 0.35)
        n = max(at) + 1
        both[name] = (n, sum(at.count(k) == 1 for k in range(n)) / n - 0.01 * len(at) / n), at
    vertical = both["v"][0] <= both["h"][0]
    lines = {}
    for b, k in zip(boxes, both["v" if vertical else "h"][1]):
        lines.setdefault(k, []).append(b)

    def place(k):
        x, y = (-(min(b[i] for b in lines[k]) + max(b[i + 2] for b in lines[k])) / 2 for i in (4, 5))
        return (x, -y, k) if vertical else (-y, x, k)

    read = [sorted(lines[k], key=lambda b: (b[0] if vertical else -b[1], b[2], b[3])) for k in sorted(lines, key=place)]
    return len(read), " ".join("".join(b[3] for b in r) for r in read)


def _rows():
    rnd = random.Random(3)
    for uid in range(400):
        for i in range(150 if uid == 7 else rnd.randint(1, 9)):
            x, y = rnd.randint(0, 60) / 2, rnd.randint(0, 60) / 2
            yield uid, i, rnd.choice("abcdé"), x, y, x + rnd.randint(1, 20), y + rnd.randint(1, 20)


def test_decode_is_the_plain_rule_in_batches(spark):
    rows = list(_rows())
    df = spark.createDataFrame(rows, KIND)
    images = {}
    for uid, i, c, x1, y1, x2, y2 in rows:
        images.setdefault(uid, []).append(((y1 + y2) / 2, (x1 + x2) / 2, i, c, x1, y1, x2, y2))
    out = D.decode(df)
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["uid"]: (r["n_lines"], r["pred_text"]) for r in out.collect()} == {u: _text(b) for u, b in images.items()}


def test_reading_agrees_with_lines(spark):
    tokens = D.tokens_of(spark.createDataFrame(list(_rows()), KIND))
    lines = D.auto_lines(tokens)
    ordered = F.transform(F.flatten(D.order_lines(F.col("lines"), F.col("vertical"))), lambda t: t["idx"])
    plain = {tuple(r) for r in lines.select("uid", "vertical", F.size("lines"), F.array_join(ordered.cast("array<string>"), ",")).collect()}
    assert plain == {tuple(r) for r in D.reading(tokens).select("uid", "vertical", "n_lines", F.array_join(F.col("read").cast("array<string>"), ",")).collect()}


def test_missing_and_unordered_values(spark):
    """A null end is passed over; NaN is the largest value; null and empty letters leave their line's blank."""
    nan = float("nan")
    rows = [(1, 0, "a", 0.0, 0.0, 8.0, 8.0), (1, 1, "b", 10.0, None, 18.0, 8.0), (2, 0, "a", 0.0, 0.0, 8.0, nan), (2, 1, "?", 10.0, 50.0, 18.0, 58.0), (3, 0, None, 0.0, 0.0, 8.0, 8.0), (3, 1, "c", 30.0, 40.0, 38.0, 48.0)]
    got = {r["uid"]: (r["n_lines"], r["pred_text"]) for r in D.decode(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {1: (1, "ba"), 2: (1, "[?]a"), 3: (2, "c")}


def test_blocks_do_not_matter(monkeypatch):
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(0, 12, 200)
    starts, n = np.cumsum(sizes) - sizes, int(sizes.sum())
    low = rnd.integers(0, 40, n).astype(float)
    ends = (low, np.zeros(n, bool)), (low + rnd.integers(1, 20, n), np.zeros(n, bool))
    whole = D._joined(*ends, starts, sizes, 0.35)
    monkeypatch.setattr(D, "CELLS", 5)
    assert (D._joined(*ends, starts, sizes, 0.35) == whole).all()
    plain = [k for s, m in zip(starts, sizes) for k in _greedy([(ends[0][0][i], ends[1][0][i]) for i in range(s, s + m)], 0, 1, 0.35)]
    assert plain == whole.tolist()
