"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source has the same rate, its source's target over the source's size: whole copies, and a fraction
that is the probability of one copy more. The flight moves three probabilities at a time along the null space of the two
constraints, words and documents of the source, until one of them is 0 or 1. It runs in blocks of about a thousand
documents of a source; what a block leaves open (two documents, and a ladder of three documents for each doubling of
size) meets in the blocks of the next level, until a source has a single block. There the landing decides these few
documents. Copies are of whole documents.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = (3, 2), 2  # of all sizes; times a source's size
BLOCK, CHUNK = 1024, 8192
HELD = 3  # of each doubling of size
STATES = 65_536
NEAR = 1e-9
FLOWN = "doc_id bigint, size bigint, source_size bigint, target double, copies bigint, h bigint, source_no bigint, p double, state int"


def words(text: Column) -> Column:
    """Number of words, without an array of them: each becomes one letter, and what lies between goes."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), " \t\n\x0b\x0c\r", "")).cast("bigint")


def numbered_sources(sized: DataFrame) -> DataFrame:
    """(source, source_size, n, source_no): sources by code point from 0, null last.

    Numbers come from a range sort: places inside a partition, and the sums of the partitions before it.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rows = stored(sums.orderBy(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = rows.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "part").select("source", "source_size", "n", (F.col("start") + F.col("at")).alias("source_no"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds target and full (whether it is the most allowed): the budget by weight, the excess over twice a source's size
    shared again by weight until none is above. Each round is three sums over the sources, exact in whole numbers."""
    weight = F.lit(weights[0])
    for k, w in enumerate(weights[1:], 1):
        weight = F.when(F.col("source_no") % len(weights) == k, w).otherwise(weight)
    rows = stored(sources.withColumn("w", weight), "mix-weights")
    exact = lambda c: c.cast("decimal(38,0)")
    total, over, left = (int(x or 0) for x in rows.agg(F.sum(exact(F.col("source_size"))), F.lit(0), F.sum("w")).first())
    while True:
        # the level of the others: share of the budget for a weight of one
        num, den = SHARE[0] * total - SHARE[1] * MOST * over, SHARE[1] * left
        full = exact(F.col("w")) * num >= exact(F.col("source_size")) * (MOST * den) if left else F.lit(True)
        now, rest = (int(x or 0) for x in rows.agg(F.sum(F.when(full, exact(F.col("source_size")))), F.sum(F.when(full, 0).otherwise(F.col("w")))).first())
        if (now, rest) == (over, left) or not left:
            break
        over, left = now, rest
    share = F.col("w") * F.lit(float(num)) / F.lit(float(den)) if left else F.lit(0.0)
    return rows.withColumn("full", full).withColumn("target", F.when(F.col("full"), (F.col("source_size") * MOST).cast("double")).otherwise(share))


def _move(p: list, size: list, active: list, roll) -> list:
    """Moves the probabilities of two or three active documents, so that words and documents stay equal in sum, until one
    of them is settled; gives those that are still open."""
    a, b, c = (size[i] for i in active) if len(active) == 3 else (size[active[0]], size[active[1]], None)
    if c is None or a == b == c:
        way = (1.0, -1.0, 0.0)
    else:
        way = (float(b - c), float(c - a), float(a - b))
    moves = [(i, u) for i, u in zip(active, way) if u]
    up = min((1 - p[i]) / u if u > 0 else p[i] / -u for i, u in moves)
    down = min(p[i] / u if u > 0 else (1 - p[i]) / -u for i, u in moves)
    by = up if roll() * (up + down) < down else -down
    for i, u in moves:
        p[i] += by * u
        if p[i] < NEAR or p[i] > 1 - NEAR:
            p[i] = float(p[i] > 0.5)
    return [i for i in active if 0 < p[i] < 1]


def fly(p: list, size: list, order: list, roll) -> list:
    """The flight over documents in order; gives the at most two that stay open."""
    active = []
    for i in order:
        if 0 < p[i] < 1:
            active.append(i)
        while len(active) == 3:
            active = _move(p, size, active, roll)
    return _move(p, size, active, roll) if len(active) == 2 and size[active[0]] == size[active[1]] else active


def land(p: list, size: list, open_: list) -> None:
    """Settles the open documents, largest first: among sets of them, the one whose words and number come nearest to what
    the probabilities add up to. A document too many or too few counts like a word. Of more than STATES sets, those stay
    that what is smaller can bring nearest."""
    todo = sorted(open_, key=lambda i: (-size[i], i))
    want, count = sum(p[i] * size[i] for i in todo), sum(p[i] for i in todo)
    rest = sum(size[i] for i in todo)
    got, number = np.zeros(1), np.zeros(1)
    chosen = np.zeros((1, len(todo)), bool)
    for k, i in enumerate(todo):
        rest -= size[i]
        more = chosen.copy()
        more[:, k] = True
        got, number, chosen = np.concatenate([got, got + size[i]]), np.concatenate([number, number + 1]), np.concatenate([chosen, more])
        if len(got) > STATES:
            best = np.argsort(np.abs(want - got - rest / 2), kind="stable")[:STATES]
            got, number, chosen = got[best], number[best], chosen[best]
    best = chosen[np.argmin(np.abs(got - want) + np.abs(number - count))]
    for k, i in enumerate(todo):
        p[i] = float(best[k])


def settle(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    """A block after its flight; of the last block of a source also after the landing."""
    p, size = pdf["p"].tolist(), pdf["size"].tolist()
    roll = random.Random(int(pdf["h"].iloc[0])).random
    held: dict[int, list] = {}
    for i, s in enumerate(size):
        if s and 0 < p[i] < 1 and len(steps := held.setdefault(s.bit_length(), [])) < HELD:
            steps.append(i)
    ladder = {i for steps in held.values() for i in steps}
    open_ = fly(p, size, [i for i in range(len(p)) if i not in ladder], roll)
    if last:
        land(p, size, [*open_, *sorted(ladder)])
    return pdf.assign(p=p, state=np.array([-1 if 0 < x < 1 else int(x) for x in p], np.int32))


def flights(batches):
    """For mapInPandas: rows in order of (source_no, block); a block that is too large flies in chunks."""
    columns = [c.split()[0] for c in FLOWN.split(", ")]
    rest = None

    def out(chunk):
        return settle(chunk, bool(chunk["blocks"].iloc[0] == 1))[columns]

    for pdf in batches:
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if rest.empty:
            continue
        keys = rest[["source_no", "block"]].to_numpy()
        cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1)]
        for at, to in zip(cuts, cuts[1:]):
            for k in range(at, to, CHUNK):
                yield out(rest.iloc[k : min(k + CHUNK, to)])
        rest = rest.iloc[cuts[-1] :].reset_index(drop=True)
        while len(rest) > CHUNK:
            yield out(rest.iloc[:CHUNK])
            rest = rest.iloc[CHUNK:].reset_index(drop=True)
    if rest is not None:
        for k in range(0, len(rest), CHUNK):
            yield out(rest.iloc[k : k + CHUNK])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 13) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row: words, those of its source, the source's target, and the
    words taken, repeats counted.

    Choices hang on hashes of (seed, doc_id, text), so reruns agree. Null texts have no words; a null source is one source
    and comes last; null and repeated doc_ids are rows like others; an empty table gives an empty one. Large sources fly
    in many blocks.
    """
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), h.alias("h")), "mix-sizes")
    known = targets(numbered_sources(sized), weights)
    rate = F.when(F.col("full"), F.lit(float(MOST))).otherwise(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    known = known.select(F.col("source").alias("of"), "source_no", "source_size", "target", rate.alias("rate"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("copies", F.floor("rate")).withColumn("p", F.col("rate") - F.col("copies")).withColumn("p", F.when(F.col("p") < NEAR, 0.0).when(F.col("p") > 1 - NEAR, 1.0).otherwise(F.col("p")))
    names = [c.split()[0] for c in FLOWN.split(", ")][:-1]
    out, level = [], 0
    while True:
        block = F.pmod(F.xxhash64(F.lit(level), F.col("h")), F.col("blocks"))
        dealt = rows.select(*names, "blocks", block.alias("block")).repartition(parts(rows), "source_no", "block").sortWithinPartitions("source_no", "block", "h", "doc_id", "size")
        flown = stored(dealt.mapInPandas(flights, FLOWN), f"mix-level-{level}")
        out.append(flown.filter("state >= 0").select("doc_id", "size", "source_size", "target", ((F.col("copies") + F.col("state")) * F.col("size")).cast("bigint").alias("taken")))
        left = flown.filter("state < 0").drop("state")
        if not left.limit(1).count():
            break
        counts = left.groupBy("source_no").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        rows, level = left.join(counts, "source_no"), level + 1
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all documents, 150 % of their words by weights 5, 2, 1."""
    return mix(table(spark, sf_dir, "documents"))
