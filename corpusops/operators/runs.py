"""Aggregation and comparison of training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def best_epoch(epochs: DataFrame, run: str = "run_id", metric: str = "metric") -> DataFrame:
    """The epoch of the largest metric of each run; the earliest among equals."""
    return epochs.groupBy(run).agg(F.max_by(F.struct("epoch", metric), F.struct(F.col(metric), -F.col("epoch"))).alias("b")).select(run, "b.*")


def last_epoch(epochs: DataFrame, run: str = "run_id") -> DataFrame:
    rest = [c for c in epochs.columns if c != run]
    return epochs.groupBy(run).agg(F.max_by(F.struct(*rest), "epoch").alias("l")).select(run, "l.*")


def best_per_model_regime(rows: DataFrame, model: str, regime: str, metric: str, source: str) -> DataFrame:
    """The best metric of each model and regime and the first source by name that has it."""
    return rows.groupBy(model, regime).agg(F.round(F.max(metric), 6).alias("best"), F.min(F.struct((-F.col(metric)).alias("m"), F.col(source).alias("s"))).alias("b")).select(model, regime, "best", F.col("b.s").alias("source"))


def pivot_regimes(best: DataFrame, model: str, regime: str, regimes: list[str], delta: tuple[str, str]) -> DataFrame:
    """A column for each regime (3 decimals, null where there is none) and the difference of two of them."""
    out = best.groupBy(model).pivot(regime, regimes).agg(F.bround(F.max("best"), 3))
    return out.withColumn("delta", F.bround(F.col(delta[0]) - F.col(delta[1]), 3))


def last_phase(rows: DataFrame, run: str, phase: str, metric: str) -> DataFrame:
    """The metric of the latest phase of each run that has one."""
    return rows.groupBy(run).agg(F.max_by(F.struct(phase, metric), F.when(F.col(metric).isNotNull(), F.col(phase))).alias("p")).select(run, "p.*")


def last_metrics(rows: DataFrame, flat: DataFrame, run: str, phase: str, metric: str) -> DataFrame:
    """The metric of the latest phase of each run that has one, else that of its flat file (run, metric), phase null."""
    phased = last_phase(rows.filter(F.col(metric).isNotNull()), run, phase, metric)
    other = flat.select(F.col(run), F.col(metric).alias("_flat"))
    both = phased.join(other, run, "full")
    return both.select(run, phase, F.coalesce(metric, "_flat").alias(metric)).filter(F.col(metric).isNotNull())


def runs_summary(rows: DataFrame, run: str, metrics: str) -> DataFrame:
    """A row for each run and a column for each key that any run's map has, in order of name.

    Keys are names of metrics, so they come to the driver; rows do not.
    """
    keys = [r[0] for r in rows.select(F.explode(F.map_keys(metrics)).alias("k")).distinct().orderBy("k").collect()]
    return rows.select(run, *[F.element_at(metrics, k).alias(k) for k in keys])


def reproduce_tables(runs: DataFrame, frozen: DataFrame, rules: list[tuple[str, str]], prefixes: list[str], suffixes: list[str], regimes: list[str], delta: tuple[str, str], names: dict[str, str] | None = None, tol: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """The table of models by regimes made from runs (name, metric), and its differences from the frozen one.

    names maps the frozen table's display names to the models derived from run names.
    """
    tagged = runs.select("name", "metric", T.regime_of(F.col("name"), rules, "unknown").alias("regime"), T.model_of(F.col("name"), prefixes, suffixes).alias("model"))
    made = pivot_regimes(best_per_model_regime(tagged, "model", "regime", "metric", "name"), "model", "regime", regimes, delta)
    if names:
        known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        frozen = frozen.withColumn("model", F.coalesce(F.element_at(known, F.col("model")), F.col("model")))
    return made, compare_tables(frozen, made, "model", regimes, tol)


def val_sanity(rows: DataFrame, run: str, val_key: str) -> DataFrame:
    """One row: evaluation sets, runs, and whether all runs share one evaluation set."""
    out = rows.agg(F.countDistinct(val_key).alias("sets"), F.countDistinct(run).alias("runs"))
    return out.withColumn("ok", F.col("sets") == 1)


def compare_runs(rows: DataFrame, column: str, top: int, ascending: bool = False, tie: str = "run_id") -> DataFrame:
    """The first rows by a numeric column; unknown columns raise; rows without a number come last."""
    if column not in rows.columns:
        raise ValueError(f"unknown column {column}")
    c = F.col(column)
    return rows.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), tie).limit(top)


def compare_tables(frozen: DataFrame, made: DataFrame, key: str, columns: list[str], tol: float) -> DataFrame:
    """(key, column, problem) of cells that are missing or differ by more than tol; cells that are no numbers pass."""
    melt = lambda df, name: df.unpivot(key, columns, "column", name)
    f = melt(frozen.select(key, *[F.col(c).cast("string").try_cast("double").alias(c) for c in columns]), "want")
    m = melt(made.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).withColumn("_k", F.lit(1)).drop("_k"), "have")
    rows = f.join(m, [key, "column"], "left").join(made.select(F.col(key), F.lit(True).alias("_there")).distinct(), key, "left")
    problem = F.when(F.col("_there").isNull(), "missing row").when(F.col("have").isNull(), "missing cell").when(F.abs(F.col("want") - F.col("have")) > tol, "differs")
    return rows.filter(F.col("want").isNotNull()).select(key, "column", problem.alias("problem")).filter("problem IS NOT NULL")
