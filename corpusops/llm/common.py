"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Only a session in one process may do without: it gets a
    folder of its own machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.sparkContext._jvm.java.nio.file.Files.createTempDirectory("corpusops").toString()
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def parts(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and the path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, so that lineage ends and lost executors cost nothing."""
    return written(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], tuple[DataFrame, str]]]:
    """Tables that operators store inside are deleted at its end, also after an error.

    Results read such tables, so what is to outlive the block must be written inside it: the block is given keep(df,
    name), which does what `written` does and leaves that table alone.
    """
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        token = _SCRATCH.set(None)
        try:
            return written(df, name)
        finally:
            _SCRATCH.reset(token)

    before = _SCRATCH.set(paths)
    try:
        yield keep
    finally:
        _SCRATCH.reset(before)
        for path in paths:
            remove(spark, path)


def _stars(edges: DataFrame, keep_larger: bool, n: int) -> DataFrame:
    """One round of star contraction. The minimum is dealt out anew, so that both sides of the join can be split."""
    if keep_larger:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).repartition(n)
    joined = near.join(least.hint("merge"), "a")
    if keep_larger:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, rows_a_task: int = 50_000) -> DataFrame:
    """Connected components of edges (a, b): node, component (its smallest node), for each node of an edge.

    Alternates large-star and small-star contraction; each round is written to the shared folder and replaces the one
    before. Hubs are joined on two shuffled sides, which adaptive execution splits. Nothing but two sums per round comes
    to the driver; the count among them sets the number of tasks of the next round.
    """
    edges, path = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now, before = state(edges), None
    while now != before and now[0]:
        n = min(parts(edges), 1 + now[0] // rows_a_task)
        edges, new = written(_stars(_stars(edges, True, n), False, n), "edges")
        remove(edges.sparkSession, path)
        path, before, now = new, now, state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
