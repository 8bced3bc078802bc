"""Centroid clustering against brute force in whole numbers."""

import hashlib
import math
import random

import numpy as np

from corpusops.llm import centroids as C

KIND = "vec_id bigint, embedding array<float>, cluster string, x int"


def brute(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(float(np.float32(c)) * scale) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cents = [x for _, x in sorted((name(i), x) for i, x in kept)[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in kept]
        for n in range(len(cents)):
            mine = [x for (_, x), a in zip(kept, at) if a == n]
            if mine:
                cents[n] = [sum(d) // len(mine) for d in zip(*mine)]
    return sorted(((i is None, i or 0), *nearest(x)[::-1]) for i, x in kept), cents


def test_against_brute_force(spark):
    roll = random.Random(5)
    rows = [(i, [roll.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    rows += [(7, [0.5, 0.5, 0.5, 0.5])] * 40 + [(None, [0.1, -0.2, 0.3, 1000.0]), (None, [0.25, 0.25, -0.25, 0.0])]
    rows += [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [0.0, float("-inf"), 0.0, 0.0]), (905, [])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], KIND)
    for parts in (1, 5):
        got, cents = C.cluster(df.repartition(parts), 6, 3, 1, 4, 64)
        want, right = brute(rows, 6, 3, 4, 64)
        assert cents.tolist() == right
        assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"]) for r in got.collect()) == want


def test_blocks_of_codes_give_back_the_vectors():
    x = np.random.default_rng(1).integers(-50, 50, (1000, 3))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"vec_id": pa.array(range(1000)), "x": pa.array(x.tolist())})
    (block,) = C.code_blocks(3)([batch])
    ((ids, spread, occurring, codes),) = C._read(block, 3)
    best, distance, back = C.nearest(spread, occurring, codes, x[:2])
    assert (back == x).all() and ids == list(range(1000))
    assert (distance == ((x[:, None] - x[None, :2]) ** 2).sum(2).min(1)).all() and best[0] == 0 and best[1] == 1


def test_empty_and_few(spark):
    got, cents = C.cluster(spark.createDataFrame([], KIND), 3, 2, 1, 4, 64)
    assert got.count() == 0 and len(cents) == 0
    got, cents = C.cluster(spark.createDataFrame([(1, [0.0, 1.0], "a", 1), (1, [0.0, 1.0], "a", 1)], KIND), 16, 3, 1, 2, 64)
    assert len(cents) == 2 and {r["cluster"] for r in got.collect()} == {0} and got.count() == 2
