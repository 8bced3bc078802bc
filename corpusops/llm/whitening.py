"""Embedding whitening: eigenvectors of a distributed covariance, in float32 first and then refined in higher precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries from here on, in 64ths, are no whole numbers that sums of a batch could hold.
LIMIT = 2**40
#: Eigenvalues below this share of the trace count as zero: they have no direction of their own.
NOTHING = 1e-13
WIDE = np.longdouble


def integer_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the vectors without null or non-finite entries: floor(64 c) + 1,000,000 of each entry c.

    Empty vectors have no component and go; vectors with an entry of LIMIT or more in 64ths go, too, as x is a long.
    """
    unit = lambda c: c.cast("double") * SCALE
    fine = F.forall("embedding", lambda c: F.coalesce(F.abs(unit(c)) < LIMIT, F.lit(False)))
    kept = df.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    return kept.select("vec_id", F.transform("embedding", lambda c: F.floor(unit(c)) + OFFSET).alias("x"))


class Centre:
    """Takes the mean off whole vectors without losing digits: the nearest whole mean exactly, then the rest of it."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole = n, np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
        self.rest = [s - n * int(m) for s, m in zip(sums, self.whole)]

    def near(self, x: np.ndarray) -> np.ndarray:
        return x - self.whole

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.near(x).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 as whole numbers; None beyond a long."""
        z, n, rest = self.near(x), self.n, self.rest
        if (2 * n * (int(np.abs(z).max(initial=0)) + 1)) ** 2 * len(rest) < 2**63:
            return ((n * z - np.array(rest)) ** 2).sum(axis=1).tolist()
        z = z.astype(object)
        exact = (n * n * (z * z).sum(axis=1) - 2 * n * (z * np.array(rest, object)).sum(axis=1) + sum(r * r for r in rest)).tolist()
        return [d if d < 2**63 else None for d in exact]


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def second_moments(fit: DataFrame, made, dim: int, width: int) -> np.ndarray:
    """Sum over the fit list of made(x) made(x)^T, width by width: a matrix for each task, added up by Spark."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            c = made(_vectors(batch, dim))
            total += c.T @ c
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(total[i, j])})

    out = np.zeros((width, width))
    for r in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of eigenvalues that hang together by steps of at most gap, two or more of them."""
    order = np.argsort(values)
    cuts = np.nonzero(np.diff(values[order]) > gap)[0] + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def _refine(a: np.ndarray, x: np.ndarray, norm: float) -> tuple[np.ndarray, float]:
    """One Ogita-Aishima correction of approximate eigenvectors x of a, and how far off they were.

    Residuals of orthogonality and of diagonality give the first-order error of all eigenvectors by matrix products alone;
    its symmetric part is half the former and its antisymmetric part a quotient by the gap, kept apart so that a small gap
    does not cost orthogonality. Pairs that the residuals cannot tell apart are only made orthogonal; each cluster of such
    is then solved in its own small space, shifted by its mean, so that even small gaps inside it count in full.
    """
    even = lambda m: (m + m.T) / 2  # noqa: E731  rounding leaves the halves of a product a little apart
    residual, s = np.eye(len(a), dtype=a.dtype) - even(x.T @ x), even(x.T @ (a @ x))
    values = np.diag(s) / (1 - np.diag(residual))
    two = lambda m: float(np.linalg.norm(m.astype(np.float64), 2))
    gap = 2 * (two(s - np.diag(values)) + norm * two(residual))
    coupling = s + residual * (values[None, :] + values[:, None]) / 2
    np.fill_diagonal(coupling, 0)
    apart = values[None, :] - values[:, None]
    known = np.abs(apart) > gap
    off = max(float(np.abs(residual).max()), float(np.abs(coupling).max()) / norm)
    x = x + x @ (residual / 2 + np.where(known, coupling / np.where(known, apart, 1), 0))
    for g in _clusters(values, gap):
        q = x[:, g]
        mean = values[g].mean()
        inner = even(q.T @ (a @ q - mean * q))
        scale = np.abs(inner).max()
        if scale > 0:
            x[:, g] = q @ np.linalg.eigh((inner / scale).astype(np.float64))[1].astype(a.dtype)
    return x, off


def eigen(a: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, in double precision.

    The start are float32 eigenvectors; corrections run in extended precision until they no longer change a double. The
    entry of largest size in each column is positive.
    """
    scale = float(np.abs(a).max()) or 1.0
    wide = a.astype(WIDE) / WIDE(scale)
    x = np.linalg.eigh(wide.astype(np.float32))[1].astype(WIDE)
    norm = float(np.linalg.norm(wide.astype(np.float64), 2)) or 1.0
    for _ in range(rounds):
        x, off = _refine(wide, x, norm)
        if off < np.finfo(np.float64).eps / 8:
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (wide @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order].astype(np.float64), (values[order] * WIDE(scale)).astype(np.float64)
    return values, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1.0, 1.0)


def whiten(rows: DataFrame, dim: int, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of the vectors x of one length.

    The fit list is each distinct vector once, so that copies do not weigh and a common vector is folded before the
    shuffle. Covariances centre first; only d times d sums come to the driver. Components without variance (rank below
    16, one vector only) are not returned.
    """
    spark = rows.sparkSession
    fit = stored(rows.select("x").distinct(), "fit-list")
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    sums = sorted(sums, key=lambda r: r["i"])
    n, centre = sums[0]["n"], Centre(sums[0]["n"], [int(r["s"]) for r in sums])
    values, vectors = eigen(second_moments(fit, centre, dim, dim) / n)
    trace = float(values.sum())
    keep = [i for i in range(min(components, dim)) if trace > 0 and values[i] > NOTHING * trace]
    kind = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not keep:
        return spark.createDataFrame([], kind)
    turn = vectors[:, keep] / np.sqrt(values[keep])
    project = lambda x: centre(x) @ turn
    error = float(np.abs(second_moments(fit, project, dim, len(keep)) / n - np.eye(len(keep))).max())

    def run(batches):
        for batch in batches:
            x = _vectors(batch, dim)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "deviation": pa.array(centre.deviations(x), pa.int64()), "w": pa.array(list(project(x)), pa.list_(pa.float64()))})

    explained = F.array(*[F.lit(float(values[i] / trace)) for i in keep])
    made = rows.mapInArrow(run, "vec_id bigint, deviation bigint, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return made.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of the embeddings. Vectors of several lengths are fitted and whitened length by length; rows are
    independent, so null and repeated vec_ids are rows like others, and an empty table gives an empty one."""
    rows = integer_vectors(table(spark, sf_dir, "embeddings"))
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())
    parts = [whiten(rows.filter(F.size("x") == d), d) for d in lengths]
    if not parts:
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
