"""Whitening against exact sums and a plain eigenvalue solver; refinement on hard matrices."""

from fractions import Fraction

import numpy as np
import pytest

from corpusops.llm import whitening as W

KIND = "vec_id bigint, embedding array<float>, component string, n int"


def rows_of(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [None if c is None else float(c) for c in v], "clash", 3) for i, v in enumerate(vectors)], KIND)


def whitened(spark, df, monkeypatch):
    monkeypatch.setattr(W, "table", lambda *a: df)
    return W.op12_whitening(spark, "").collect()


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(400, 20)) * np.linspace(0.1, 2, 20)).astype(np.float32)
    v = np.concatenate([v, np.repeat(v[:1], 150, axis=0)])
    odd = [None, [1.0, None], [float("inf")] * 20, [float("nan")] * 20, []]
    got = whitened(spark, rows_of(spark, [*v, *odd]).repartition(5), monkeypatch)
    x = np.floor(v.astype(np.float64) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit - 1_000_000) - (s / n - 1_000_000)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    deviation = ((n * x - s) ** 2).sum(axis=1)
    want = ((x - 1_000_000) - (s / n - 1_000_000)) @ u[:, :16] / np.sqrt(e[:16])
    table = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(table) == len(v) * 16
    for k in range(16):
        mine = np.array([table[i, k + 1]["whitened"] for i in range(len(v))])
        sign = np.sign(mine @ want[:, k])
        np.testing.assert_allclose(mine, sign * want[:, k], atol=1e-9)
        assert table[0, k + 1]["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9)
    assert all(r["deviation"] == deviation[r["vec_id"]] and r["n"] == n for r in got)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10


def test_several_lengths_single_vectors_low_rank_and_empty(spark, monkeypatch):
    assert whitened(spark, spark.createDataFrame([], KIND), monkeypatch) == []
    assert whitened(spark, rows_of(spark, [[1.0, 2.0]] * 5), monkeypatch) == []
    line = [[i / 8, i / 4] for i in range(9)]
    got = whitened(spark, rows_of(spark, [*line, *[[float(i % 3), 0.0, float(i)] for i in range(6)]]), monkeypatch)
    assert {(r["component"], r["n"]) for r in got if r["vec_id"] < 9} == {(1, 9)}
    assert {(r["component"], r["n"]) for r in got if r["vec_id"] >= 9} == {(1, 6), (2, 6)}
    assert all(r["identity_error"] < 1e-10 for r in got)


def test_deviations_are_exact_for_any_count():
    sums = [10**15 + 7, -3]
    for n in (3, 10**9, 10**12):
        centre = W.Centre(n, [n * 1_000_000 + 5, n * 999_990 - 2])
        x = np.array([[1_000_003, 999_991], [1_000_000, 999_990]])
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, [n * 1_000_000 + 5, n * 999_990 - 2])) for row in x]
        assert centre.deviations(x) == [w if w < 2**63 else None for w in want]
    assert W.Centre(7, sums).whole[0] == round(Fraction(sums[0], 7))


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [1, 1, 1, 1, 1], [1 + 1e-9, 1, 1 - 1e-9, 0.5, 0.5 + 1e-12], [1e12, 1e12 + 1, 3, 3, 0], [1, 1e-3, 1e-6, 1e-9, 0], [2, 2 + 1e-7, 2 - 1e-7, 2 + 3e-7, 2 + 2e-7]])
def test_refined_vectors_of_close_and_equal_eigenvalues(values):
    q = np.linalg.qr(np.random.default_rng(9).normal(size=(5, 5)))[0].astype(W.WIDE)
    q = q @ (3 * np.eye(5) - q.T @ q) / 2  # orthogonal beyond double precision
    a = ((q * np.array(values, W.WIDE)) @ q.T).astype(np.float64)
    a = (a + a.T) / 2
    e, x = W.eigen(a)
    assert (np.diff(e) <= 1e-15 * abs(e[0])).all()
    np.testing.assert_allclose(x.T @ x, np.eye(5), atol=5e-16 * 5)
    wide = a.astype(W.WIDE)
    assert float(np.abs(wide @ x.astype(W.WIDE) - x.astype(W.WIDE) * e.astype(W.WIDE)).max()) <= 4e-16 * abs(e[0])
    np.testing.assert_allclose(e, sorted(values, reverse=True), atol=2e-15 * abs(e[0]))


def test_float32_alone_is_worse():
    m = np.random.default_rng(2).normal(size=(300, 64))
    a = m.T @ m
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    e, x = W.eigen(a)
    off = lambda v: np.abs(v.T @ a @ v - np.diag(np.diag(v.T @ a @ v))).max()
    assert off(x) < 1e-12 * e[0] < off(start)
