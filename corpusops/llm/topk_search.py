"""Exact top-k search by inner product with a pivot table.

Every vector's distances to many pivots are computed once. For a query q and a candidate x, max over pivots of
|d(q, p) - d(x, p)| bounds their distance from below, so (|q|^2 + |x|^2 - bound^2) / 2 bounds the inner product from
above. Candidates are evaluated in the order of that bound until it falls below the k-th best score found. Distances
are floating point, so bounds are raised by a relative 1e-9 plus 1e-3; scores are exact integers.

Pivots are chosen farthest-first, 32 for each length of vector, from a sample of at most 1,024 candidates (by hash of
vec_id). The k-th best score of a query within the same sample is a floor: what is bounded below it is never looked at.

Blocks hold vectors that are near each other: a task buffers BUFFER bytes of vectors, sorts them by nearest pivot and by
the distance to it, and cuts blocks. Blocks of queries whose first vector has the same nearest pivot are a class; the
classes' intervals of distances, at most 32 for each length, go to the tasks that pack the candidates, so that a block
that no query of a class can want is not sent to it. The rest meets in cells: a group of about GROUP query blocks of a class has a
cell for each column, and a candidate block goes to one column of each group. Rows of a cell come sorted, queries first,
so a task holds the queries of one cell and one candidate block at a time and hands on the k best when the cell ends.

Vectors null or with null or non-finite components take no part. Vectors of another length than a query's are not its
candidates. Ties go to the smaller vec_id; rows that repeat a vec_id are candidates each, save for queries of that id;
query rows that repeat a vec_id are queries each, with k results each. Queries with fewer candidates get all. Empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, stored, table

PIVOTS, SAMPLE, QUERY_BLOCK, BLOCK, STRIDE, GROUP, BUFFER = 32, 1024, 512, 1024, 256, 8, 32 << 20


def usable(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>, dim): components floor(scale * x) of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)))
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"), F.size(x).alias("dim"))


def sampled(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a bounded sample, by length of vector."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    of = lambda dim: [r for r in rows if r["dim"] == dim]
    return {dim: (np.array([r["vec_id"] for r in of(dim)], np.int64), np.array([r["v"] for r in of(dim)], np.int64)) for dim in {r["dim"] for r in rows}}


def farthest_first(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    chosen, far = [0], np.linalg.norm(m - m[0], axis=1)
    while len(chosen) < min(PIVOTS, len(m)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(m - m[chosen[-1]], axis=1))
    return m[chosen]


def _to_pivots(m: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    f = m.astype(np.float64)
    return np.zeros((len(f), 0)) if pivots is None else np.stack([np.linalg.norm(f - p, axis=1) for p in pivots], axis=1)


BLOCKS = "dim int, class int, ids binary, vectors binary, pivots binary, norm double, low array<double>, high array<double>"


def _blocks(batches, size: int, pivots: dict[int, np.ndarray]):
    """(dim, class, ids, vectors, distances to pivots): blocks of neighbours, from a bounded buffer for each length."""
    waiting: dict[int, list] = {}

    def cut(dim):
        ids, x = (np.concatenate(c) for c in zip(*waiting.pop(dim)))
        far = _to_pivots(x, pivots.get(dim))
        near = far.argmin(axis=1) if far.shape[1] else np.zeros(len(far), np.int64)
        order = np.lexsort((ids, far[np.arange(len(far)), near] if far.shape[1] else ids, near))
        for i in range(0, len(order), size):
            at = order[i : i + size]
            yield dim, int(near[at[0]]), ids[at], x[at], far[at]

    for batch in batches:
        dims, all_ids, v = (batch.column(batch.schema.get_field_index(c)) for c in ("dim", "vec_id", "v"))
        dims, all_ids = dims.to_numpy(), all_ids.to_numpy().astype(np.int64)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            step = max(1, BUFFER // (8 * dim))
            for i in range(0, len(at), step):
                own = at[i : i + step]
                waiting.setdefault(dim, []).append((all_ids[own], v.take(pa.array(own)).flatten().to_numpy().reshape(len(own), dim).astype(np.int64)))
                if sum(x.nbytes for _, x in waiting[dim]) >= BUFFER:
                    yield from cut(dim)
    for dim in list(waiting):
        yield from cut(dim)


def _row(dim: int, kind: int, ids: np.ndarray, x: np.ndarray, far: np.ndarray) -> dict:
    return {"dim": dim, "class": kind, "ids": ids.tobytes(), "vectors": np.ascontiguousarray(x).tobytes(), "pivots": np.ascontiguousarray(far).tobytes(), "norm": float(_norms(x).max()), "low": far.min(axis=0).tolist(), "high": far.max(axis=0).tolist()}


_SCHEMA = [("dim", pa.int32()), ("class", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("pivots", pa.binary()), ("norm", pa.float64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]


def _pack_queries(pivots, sample, k: int):
    schema = pa.schema([*_SCHEMA, ("floors", pa.binary()), ("floor", pa.float64())])

    def pack(batches):
        for dim, kind, ids, x, far in _blocks(batches, QUERY_BLOCK, pivots):
            floors = np.full(len(ids), -np.inf)
            if dim in sample and len(sample[dim][0]) > k:
                scores = _dot(x, sample[dim][1]).astype(np.float64)
                scores[ids[:, None] == sample[dim][0]] = -np.inf
                floors = np.partition(scores, -k, axis=1)[:, -k]
            # scores beyond 2^53 are rounded as floats
            floors -= np.where(np.isfinite(floors), np.abs(floors) * 1e-9, 0)
            yield pa.RecordBatch.from_pylist([_row(dim, kind, ids, x, far) | {"floors": floors.tobytes(), "floor": float(floors.min())}], schema=schema)

    return pack


def _pack_candidates(pivots, classes: list[dict]):
    """Candidate blocks, each with the classes of queries that may want one of its vectors and their groups."""
    schema = pa.schema([*_SCHEMA, ("to", pa.list_(pa.struct([("class", pa.int32()), ("groups", pa.int32())])))])

    def pack(batches):
        for dim, kind, ids, x, far in _blocks(batches, BLOCK, pivots):
            row = _row(dim, kind, ids, x, far)
            low, high = far.min(axis=0), far.max(axis=0)
            to = []
            for c in classes:
                if c["dim"] == dim:
                    n = far.shape[1]
                    apart = np.maximum(np.maximum(np.array(c["low"][:n]) - high, low - np.array(c["high"][:n])), 0.0).max(initial=0.0)
                    if _raised(c["norm"], row["norm"], apart) >= c["floor"]:
                        to.append({"class": c["class"], "groups": c["groups"]})
            if to:
                yield pa.RecordBatch.from_pylist([row | {"to": to}], schema=schema)

    return pack


def _norms(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(axis=1)


def _raised(q_norm, norm, apart):
    """Upper bound of products of vectors of these squared lengths (or at most these) at least this far apart."""
    bound = np.minimum((q_norm + norm - apart**2) / 2, np.sqrt(q_norm * norm))
    return bound + np.abs(bound) * 1e-9 + (q_norm + norm) * 1e-9 + 1e-3


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; floats are exact while every partial sum stays below 2^53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if most < 2**53 else q @ x.T


class _Queries:
    """One block of queries with the best found so far."""

    def __init__(self, r: dict, k: int):
        self.block, self.k, self.ids = r["qb"], k, np.frombuffer(r["ids"], np.int64)
        self.x = np.frombuffer(r["vectors"], np.int64).reshape(len(self.ids), r["dim"])
        self.far = np.frombuffer(r["pivots"], np.float64).reshape(len(self.ids), -1)
        self.norm, self.floors = _norms(self.x), np.frombuffer(r["floors"], np.float64)
        self.top = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(self.ids)

    def meet(self, ids: np.ndarray, x: np.ndarray, far: np.ndarray, norm: np.ndarray) -> None:
        low, high = far.min(axis=0), far.max(axis=0)
        apart = np.maximum(np.maximum(self.far - high, low - self.far), 0.0).max(axis=1, initial=0.0)
        whole = _raised(self.norm, norm.max(), apart)
        for i in np.flatnonzero(whole >= self.floors).tolist():
            scores, got = self.top[i]
            if len(scores) >= self.k and whole[i] < scores[-1]:
                continue
            bound = _raised(self.norm[i], norm, np.abs(far - self.far[i]).max(axis=1, initial=0.0))
            order = np.argsort(-bound, kind="stable")
            for j in range(0, len(order), STRIDE):
                part = order[j : j + STRIDE]
                if bound[part[0]] < self.floors[i] or (len(scores) >= self.k and bound[part[0]] < scores[-1]):
                    break
                part = part[ids[part] != self.ids[i]]
                scores = np.concatenate([scores, _dot(self.x[i : i + 1], x[part])[0]])
                got = np.concatenate([got, ids[part]])
                first = np.lexsort((got, -scores))[: self.k]
                scores, got = scores[first], got[first]
            self.top[i] = (scores, got)

    def found(self):
        n = [len(got) for _, got in self.top]
        if sum(n):
            at = np.repeat(np.arange(len(n), dtype=np.int32), n)
            yield pa.RecordBatch.from_pydict({"qb": np.full(len(at), self.block, np.int64), "at": at, "query_id": self.ids[at], "vec_id": np.concatenate([got for _, got in self.top]), "score": np.concatenate([scores for scores, _ in self.top])})


def _searcher(k: int):
    def search(batches):
        cell, held = None, []
        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                if (here := (r["dim"], r["class"], r["g"], r["c"])) != cell:
                    for q in held:
                        yield from q.found()
                    cell, held = here, []
                if r["qb"] is not None:
                    held.append(_Queries(r, k))
                    continue
                ids = np.frombuffer(r["ids"], np.int64)
                x = np.frombuffer(r["vectors"], np.int64).reshape(len(ids), r["dim"])
                far, norm = np.frombuffer(r["pivots"], np.float64).reshape(len(ids), -1), _norms(x)
                for q in held:
                    q.meet(ids, x, far, norm)
        for q in held:
            yield from q.found()

    return search


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, tasks: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k candidates with the largest inner product, for rows of `usable`."""
    tasks = tasks or parts(queries)
    sample = sampled(candidates)
    pivots = {dim: farthest_first(m) for dim, (_, m) in sample.items()}
    q = queries.repartition(max(1, tasks // 8)).mapInArrow(_pack_queries(pivots, sample, k), f"{BLOCKS}, floors binary, floor double")
    q = stored(q.withColumn("qb", F.monotonically_increasing_id()), "queries")
    ends = lambda name, of: F.array(*[of(F.get(name, F.lit(i))) for i in range(PIVOTS)]).alias(name)
    classes = q.groupBy("dim", "class").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.min("floor").alias("floor"), ends("low", F.min), ends("high", F.max))
    classes = [r.asDict() | {"groups": -(-r["n"] // GROUP)} for r in classes.collect()]
    x = candidates.mapInArrow(_pack_candidates(pivots, classes), f"{BLOCKS}, to array<struct<class: int, groups: int>>")
    columns, payload = max(2, tasks), ["ids", "vectors", "pivots", "floors"]
    groups = q.sparkSession.createDataFrame([(c["dim"], c["class"], c["groups"]) for c in classes], "dim int, class int, groups int")
    q = q.join(F.broadcast(groups), ["dim", "class"]).withColumn("g", F.pmod(F.xxhash64("qb"), F.col("groups")).cast("int"))
    q = q.select("dim", "class", "g", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"), "qb", *payload)
    x = x.select("dim", *payload[:-1], F.pmod(F.xxhash64("ids"), F.lit(columns)).cast("int").alias("c"), F.explode("to").alias("to"))
    x = x.select("dim", F.col("to.class").alias("class"), F.explode(F.sequence(F.lit(0), F.col("to.groups") - 1)).alias("g"), "c", F.lit(None).cast("long").alias("qb"), *payload[:-1], F.lit(None).cast("binary").alias("floors"))
    cell = ["dim", "class", "g", "c"]
    rows = q.unionByName(x).repartition(tasks, *cell).sortWithinPartitions(*cell, F.col("qb").asc_nulls_last())
    found = rows.mapInArrow(_searcher(k), "qb long, at int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("qb", "at").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows of every vector whose vec_id is divisible by 100."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.filter("vec_id % 100 = 0"), vectors, 10)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
  FROM v q, v x WHERE q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
