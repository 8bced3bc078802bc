"""Exact top-k search over several cells, classes and lengths of vectors."""

import numpy as np

from corpusops.llm import topk_search


def brute(rows, k):
    out = []
    for q, v in rows:
        if q % 20 == 0:
            scores = [(-int(np.dot(v, x)), i) for i, x in rows if i != q and len(x) == len(v)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_many_cells(spark, monkeypatch):
    """Small blocks, groups and buffers, so that cells end and classes are passed over."""
    for name, value in (("QUERY_BLOCK", 3), ("BLOCK", 16), ("GROUP", 2), ("BUFFER", 40 * 8 * 6), ("SAMPLE", 64)):
        monkeypatch.setattr(topk_search, name, value)
    draw = np.random.default_rng(5)
    middles = draw.integers(-400, 400, (9, 6))
    rows = [(i, (middles[i % 9] + draw.integers(-9, 9, 6)).tolist()) for i in range(900)]
    rows += [(i, [7] * 6) for i in range(900, 1000)]  # a hot vector
    rows += [(i, draw.integers(-5, 5, 3).tolist()) for i in range(1000, 1008)]  # fewer than k of this length
    d = spark.createDataFrame([(i, v, len(v)) for i, v in rows], "vec_id long, v array<long>, dim int").repartition(5)
    got = sorted(tuple(r) for r in topk_search.top_k(d.filter("vec_id % 20 = 0"), d, 10, tasks=4).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 10)


def test_far_classes_are_passed_over():
    """A block is not sent to a class of queries whose floor it cannot reach."""
    pivots = {2: np.array([[0.0, 0.0], [1000.0, 0.0]])}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"vec_id": [1, 2], "v": pa.array([[-1000, 0], [990, 0]], pa.list_(pa.int64())), "dim": pa.array([2, 2], pa.int32())})
    near = {"dim": 2, "class": 1, "groups": 1, "norm": 1e6, "floor": 5e5, "low": [1000.0, 0.0], "high": [1000.0, 0.0]}
    sent = [r for b in topk_search._pack_candidates(pivots, [near])([batch.slice(0, 1)]) for r in b.to_pylist()]
    assert not sent
    sent = [r for b in topk_search._pack_candidates(pivots, [near])([batch.slice(1, 1)]) for r in b.to_pylist()]
    assert [r["to"] for r in sent] == [[{"class": 1, "groups": 1}]]
