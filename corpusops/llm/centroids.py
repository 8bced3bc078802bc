"""Centroid clustering of integer vectors: squared distances by scalar lookup tables.

Vectors are coded once: blocks of up to 4,096 of them hold, for each dimension, the integer values that occur and a code
for each vector. A round tabulates the squared difference of every occurring value to every centroid, one table for each
dimension; the distances of a block are gathers from the tables, summed over dimensions. Only sums by cluster and
dimension come to the driver, k times the dimension of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, stored, table, written

BLOCK = 4096
#: Integers from here on could bring a squared distance over 64 dimensions beyond a long.
LIMIT = 2**27
BLOCKS = "ids array<bigint>, spread binary, occurring binary, codes binary"


def integer_vectors(df: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * component) of the vectors with exactly `dim` finite components.

    Null vectors, other lengths, and vectors with a null, NaN or infinite component are left out, and so are those with a
    component of LIMIT or more in integer units, whose distances a long could not hold.
    """
    unit = lambda c: c.cast("double") * scale
    fine = F.forall("embedding", lambda c: F.coalesce(F.abs(unit(c)) < LIMIT, F.lit(False)))
    kept = df.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & fine)
    return kept.select("vec_id", F.transform("embedding", lambda c: F.floor(unit(c))).alias("x"))


def code_blocks(dim: int):
    """For mapInArrow: (vec_id, x) to blocks of codes."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                found = [np.unique(part[:, d], return_inverse=True) for d in range(dim)]
                spread = np.array([len(v) for v, _ in found], np.int32)
                codes = np.stack([c.astype(np.uint16) for _, c in found])
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([ids.slice(at, len(part)).to_pylist()], pa.list_(pa.int64())),
                    "spread": pa.array([spread.tobytes()], pa.binary()),
                    "occurring": pa.array([np.concatenate([v for v, _ in found]).astype(np.int64).tobytes()], pa.binary()),
                    "codes": pa.array([codes.tobytes()], pa.binary()),
                })

    return run


def nearest(spread: np.ndarray, occurring: np.ndarray, codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: each vector's nearest centroid (ties: the smaller number), its squared distance, and the vectors."""
    total = np.zeros((codes.shape[1], len(centroids)), np.int64)
    x = np.empty((codes.shape[1], len(spread)), np.int64)
    ends = np.cumsum(spread)
    for d, end in enumerate(ends):
        values = occurring[end - spread[d] : end]
        squares = (values[:, None] - centroids[None, :, d]) ** 2
        total += squares[codes[d]]
        x[:, d] = values[codes[d]]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best], x


def _read(batch: pa.RecordBatch, dim: int):
    for ids, spread, occurring, codes in zip(*(batch.column(n) for n in ("ids", "spread", "occurring", "codes"))):
        yield ids.as_py(), np.frombuffer(spread.as_py(), np.int32), np.frombuffer(occurring.as_py(), np.int64), np.frombuffer(codes.as_py(), np.uint16).reshape(dim, -1)


def cluster_sums(centroids: np.ndarray):
    """For mapInArrow: blocks to (cluster, dim, total, n), once a task."""

    def run(batches):
        k, dim = centroids.shape
        totals, sizes = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, spread, occurring, codes in _read(batch, dim):
                best, _, x = nearest(spread, occurring, codes, centroids)
                sizes += np.bincount(best, minlength=k)
                for c in np.unique(best):
                    totals[c] += x[best == c].sum(axis=0)
        c, d = np.nonzero(np.broadcast_to(sizes[:, None] > 0, (k, dim)))
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(c, pa.int32()), "dim": pa.array(d, pa.int32()), "total": pa.array(totals[c, d]), "n": pa.array(sizes[c])})

    return run


def assignments(centroids: np.ndarray):
    """For mapInArrow: blocks to (vec_id, cluster, distance)."""

    def run(batches):
        for batch in batches:
            for ids, spread, occurring, codes in _read(batch, centroids.shape[1]):
                best, distance, _ = nearest(spread, occurring, codes, centroids)
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "cluster": pa.array(best, pa.int32()), "distance": pa.array(distance)})

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order; rows that repeat an id go by components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["x"] for r in vectors.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()], np.int64)


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dim: int = 64, scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each kept vector, and the k centroids as integers.

    Every round moves each centroid that has vectors to the floor of their mean, exactly. Fewer than k vectors give as
    many centroids; none give an empty table. Rows are independent: null and repeated vec_ids are rows like others, and
    further columns of df are not looked at.
    """
    vectors = integer_vectors(df, dim, scale)
    blocks, path = written(vectors.mapInArrow(code_blocks(dim), BLOCKS), "coded-vectors")
    centroids = first_centroids(vectors, k, seed).reshape(-1, dim)
    for _ in range(rounds if len(centroids) else 0):
        sums = blocks.mapInArrow(cluster_sums(centroids), "cluster int, dim int, total bigint, n bigint")
        moved = centroids.copy()
        for r in sums.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            moved[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
        centroids = moved
    kind = "vec_id bigint, cluster int, distance bigint"
    assigned = stored(blocks.mapInArrow(assignments(centroids), kind), "assigned") if len(centroids) else df.sparkSession.createDataFrame([], kind)
    remove(df.sparkSession, path)
    return assigned, centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the embeddings, with inertia by cluster and in all, and a digest of each centroid."""
    assigned, centroids = cluster(table(spark, sf_dir, "embeddings"))
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    by = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, by.get(c, 0), sum(by.values()), digest(x)) for c, x in enumerate(centroids)]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _op11_sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    assign = "SELECT vec_id, rid, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.*, c.c, list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, {cents} c) GROUP BY vec_id, rid, x"
    parts = [
        f"WITH e AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda z: CAST(z AS DOUBLE) * {scale}) AS y FROM embeddings WHERE len(embedding) = {dim})",
        f"v AS (SELECT vec_id, rid, list_transform(y, lambda z: CAST(floor(z) AS BIGINT)) AS x FROM e WHERE len(list_filter(y, lambda z: z IS NULL OR NOT isfinite(z) OR abs(z) >= {LIMIT})) = 0)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x AS m FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS ({assign.format(cents=f'c{r}')})")
        if r < rounds:
            floor = "(s - ((s % n) + n) % n) // n"
            parts.append(f"u{r} AS (SELECT c, i, sum(z) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS z, unnest(range({dim})) AS i FROM a{r}) GROUP BY c, i)")
            parts.append(f"c{r + 1} AS (SELECT c0.c, coalesce(g.m, p.m) AS m FROM c0 JOIN c{r} p ON p.c = c0.c LEFT JOIN (SELECT c, list(CAST({floor} AS BIGINT) ORDER BY i) AS m FROM u{r} GROUP BY c) g ON g.c = c0.c)")
    last = f"SELECT a.vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.m, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"
    return ", ".join(parts) + " " + last


OP11_SQL = _op11_sql()
