"""Caller-supplied models and approaches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

APPROACHES: dict[str, Callable[[DataFrame], DataFrame]] = {}
NEEDED = {"uid", "gt_text", "pred_text"}


def register(name: str):
    def add(f):
        APPROACHES[name] = f
        return f

    return add


def run_approach(name: str, df: DataFrame) -> DataFrame:
    """Runs a registered approach; its output must have uid, gt_text and pred_text."""
    if name not in APPROACHES:
        raise ValueError(f"unknown approach {name}")
    out = APPROACHES[name](df)
    if NEEDED - set(out.columns):
        raise ValueError(f"{name} lacks {sorted(NEEDED - set(out.columns))}")
    return out.select(*sorted(NEEDED))


def contract(kind: str, key: str = "uid string", probs: bool = False, logits: bool = False, classes: bool = False) -> str:
    """Output schema of a detector (boxes with scores and classes) or a classifier (label, conf, top-k and, if asked for,
    probabilities, logits and class names)."""
    if kind == "detector":
        return f"{key}, boxes array<struct<x1:double,y1:double,x2:double,y2:double,score:double,cls:int>>"
    if kind != "classifier":
        raise ValueError(f"unknown kind of model {kind}")
    more = [(probs, "probs array<double>"), (logits, "logits array<double>"), (classes, "classes array<string>")]
    return ", ".join([key, "label string", "conf double", "topk array<struct<label:string,conf:double>>", *[c for on, c in more if on]])


def from_logits(pdf, key: str, logits: str, names: list[str], k: int):
    """A classifier's rows with their probabilities from a frame of logits; equal scores go by class number."""
    x = np.array(pdf[logits].tolist(), dtype=np.float64).reshape(len(pdf), -1)
    e = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    p = e / e.sum(axis=1, keepdims=True) if len(x) else e
    best = np.argsort(-p, axis=1, kind="stable")[:, :k]
    top = [[{"label": names[j], "conf": float(row[j])} for j in order] for row, order in zip(p, best)]
    return pd.DataFrame({key: pdf[key], "label": [t[0]["label"] for t in top], "conf": [t[0]["conf"] for t in top], "topk": top, "probs": p.tolist()})


def batch_predict(df: DataFrame, factory: Callable, schema: str, cache: DataFrame | None = None, key: str = "uid", store: str | None = None) -> DataFrame:
    """Rows through a model made once per task: factory() gives a function from a pandas frame to one of `schema`.

    Rows whose key is in the cache are taken from there. With a `store`, a folder of results, those of earlier calls are
    taken from it and new ones are added, each call as a part of its own; of a key that is in several parts the last one
    holds. A second call over the same rows computes nothing. `contract` gives the schemas of detectors and classifiers.
    """

    def run(batches):
        model = factory()
        for pdf in batches:
            yield model(pdf)

    from .manifest import anti_done, cached_or_new

    predict = lambda rows: rows.mapInPandas(run, schema)
    if store:
        known = stored_results(df.sparkSession, store, schema, key)
        todo = anti_done(df, known.unionByName(cache) if cache is not None else known, key)
        if todo.limit(1).count():
            part = 1 + max(known_parts(df.sparkSession, store, whole=False), default=-1)
            predict(todo).write.parquet(f"{store}/part={part}")
        known = stored_results(df.sparkSession, store, schema, key)
        wanted = known.join(df.select(key).distinct(), key, "left_semi")
        return wanted if cache is None else wanted.unionByName(anti_done(cache.join(df.select(key).distinct(), key, "left_semi"), known, key))
    return predict(df) if cache is None else cached_or_new(df, cache, predict, key)


def known_parts(spark: SparkSession, store: str, whole: bool = True) -> list[int]:
    """Numbers of the calls whose results the store holds, those of calls that ended only or all."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/part=*{'/_SUCCESS' if whole else ''}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = [(f.getPath().getParent() if whole else f.getPath()).getName() for f in found or []]
    return sorted(int(n.removeprefix("part=")) for n in names)


def stored_results(spark: SparkSession, store: str, schema: str, key: str = "uid") -> DataFrame:
    """The last result of each key in the store."""
    from .splits import merge_last_wins

    parts = known_parts(spark, store)
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", store).parquet(*[f"{store}/part={k}" for k in parts])
    return merge_last_wins(rows, key, ["part"]).drop("part")
