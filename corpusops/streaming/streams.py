"""Structured Streaming: ingest without repeats, and the running best of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import exists


def _table(spark: SparkSession, target: str, schema, before: int | None = None) -> DataFrame:
    """The batches in target, of a number below `before` if given; an empty table if there are none."""
    if not exists(spark, target):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    rows = spark.read.schema(schema).option("basePath", target).parquet(target).withColumn("batch", F.col("batch").cast("long"))
    return rows if before is None else rows.filter(F.col("batch") < before)


def _put(rows: DataFrame, target: str, number: int) -> None:
    """A batch is a folder of its own: run again, it replaces itself."""
    rows.write.mode("overwrite").parquet(f"{target}/batch={number}")


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "uid", event_time: str | None = None, delay: str = "1 hour", files: int | None = None) -> DataFrame:
    """Appends new rows of a folder of JSON files to a table of Parquet files, first row of each key only.

    With an event time the state is bounded: a key stays in it until the watermark, the highest time seen less `delay`, has
    passed it by the delay. Keys that left the state are looked up in the table itself, so each is still taken once. A row
    older than the watermark is late and is not taken. Without an event time the state holds all keys. files: at most so
    many files a batch.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files or 1_000_000).json(source)
    fresh = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key]) if event_time else rows.dropDuplicates([key])

    def put(batch: DataFrame, number: int) -> None:
        known = _table(batch.sparkSession, target, batch.schema, number)
        _put(batch.join(known.select(key), key, "left_anti").select(batch.columns) if event_time else batch, target, number)

    fresh.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return _table(spark, target, fresh.schema).drop("batch")


def running_best(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, run: str = "run_id", metric: str = "metric", files: int | None = None) -> DataFrame:
    """Best epoch of each run from appended epochs.

    A micro-batch writes only the runs whose best has changed, keyed by its number; the latest batch of a run holds. A
    batch that runs again sees the batches before it only and replaces its own rows, so it changes nothing.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files or 1_000_000).json(source)
    best = rows.groupBy(run).agg(F.max_by(F.struct("epoch", metric), F.struct(F.col(metric), -F.col("epoch"))).alias("b")).select(run, "b.*")

    def put(batch: DataFrame, number: int) -> None:
        _put(changed(batch, _table(batch.sparkSession, target, batch.schema, number), run), target, number)

    best.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return latest(_table(spark, target, best.schema), run)


def latest(log: DataFrame, run: str) -> DataFrame:
    """The row of the highest batch of each run."""
    rest = [c for c in log.columns if c not in (run, "batch")]
    return log.groupBy(run).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(run, "r.*")


def changed(batch: DataFrame, log: DataFrame, run: str) -> DataFrame:
    """Rows of the batch that the log does not hold as they are."""
    new, old = batch.alias("n"), latest(log, run).alias("o")
    same = F.lit(True)
    for c in batch.columns:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return new.join(old, (F.col(f"n.{run}") == F.col(f"o.{run}")) & same, "left_anti").select(batch.columns)
