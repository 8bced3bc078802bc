"""SimHash near-dedup by multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's word 3-shingles. Fingerprints that
differ in at most 3 of 64 bits agree in one 32-bit half up to one bit, so each half has a table keyed by its value, and
a fingerprint probes it with the Hamming ball of radius 1 around its own half. Of two halves one bit apart only the one
whose bit is 0 probes, so each match comes once per half. Complete distances are then verified.

Work is on distinct fingerprints: copies only share their smallest doc_id. Links go through distributed connected
components in the shared folder. Null and empty texts have fingerprint 0, linked like any other. Rows that repeat a
doc_id appear once each. An empty table gives an empty result; extra columns are ignored.

`near_copies` is the same search for a similarity of word shingles in place of a distance: texts have PRINTS
fingerprints, each cut in three segments; two texts whose halves of a segment differ in at most 2 bits meet, as each
enters the Hamming ball of radius 1 around its segment in the table and probes with the same ball. Pairs at most FAR
bits apart as a whole are then held against the exact Jaccard similarity of their whole texts' shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, parts, stored, table

WIDTH, SEED, DISTANCE = 3, 42, 3
NEAR_WIDTH, SIMILAR, PRINTS, FAR = 5, 0.8, 2, 14
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
LAST = (1 << 63) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def fingerprints_of(text: str | None, width: int = WIDTH, prints: int = 1) -> list[int]:
    """Lower-cases A-Z; words are runs of other than ASCII blanks. The second and later fingerprints are of mixed hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * prints
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((prints, 64), np.int64)
    for i in range(0, n, 8192):
        m = min(8192, n - i)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[i : i + m].tolist(), last[i : i + m].tolist())), np.uint64, m)
        for k in range(prints):
            hashes = _mixed(hashes) if k else hashes
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(m, 8), axis=1)
            for j in range(0, m, 255):  # sums of at most 255 bits stay in one byte each
                ones[k] += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return [int.from_bytes(np.packbits((x * 2 > n).astype(np.uint8)).tobytes(), "big", signed=True) for x in ones]


def fingerprint(text: str | None) -> int:
    return fingerprints_of(text)[0]


def fingerprints(docs: DataFrame, width: int = WIDTH, prints: int = 1, digest: bool = False) -> DataFrame:
    """(doc_id, fp, fp1...): signed 64-bit fingerprints of whole texts; digest: also the SHA-256 of each (null: empty)."""
    names = ["fp", *[f"fp{k}" for k in range(1, prints)]]
    extra = ["digest"] if digest else []

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            columns = list(zip(*[fingerprints_of(x, width, prints) for x in texts])) or [()] * prints
            last = [pa.array([text_digest(x) for x in texts], pa.string()) for _ in extra]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], *last], names=["doc_id", *names, *extra])

    kind = ", ".join([*[f"{c} long" for c in ["doc_id", *names]], *[f"{c} string" for c in extra]])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def text_digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of distinct values of fp (one row each) at most DISTANCE bits apart."""
    halves = prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), F.shiftrightunsigned("fp", 32).alias("key")), F.struct(F.lit(1).alias("half"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("key")))).alias("h")).select("fp", "h.half", "h.key")
    unset = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.expr("shiftright(key, 0)").bitwiseAND(F.element_at(F.lit(POWERS), i + 1)) == 0)
    ball = F.concat(F.array(F.col("key")), F.transform(unset, lambda i: F.col("key") + F.element_at(F.lit(POWERS), i + 1)))
    probes = halves.select(F.col("fp").alias("a"), "half", F.explode(F.transform(ball, lambda k, i: F.struct(k.alias("key"), (i == 0).alias("same")))).alias("p")).select("a", "half", "p.key", "p.same")
    near = probes.join(halves.withColumnRenamed("fp", "b"), ["half", "key"])
    near = near.filter((~F.col("same") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


POWERS = [1 << i for i in range(32)]


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links reach from each document."""
    prints = stored(fingerprints(docs), "fingerprints")
    first = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    pairs = links(first.select("fp"))
    by_fp = components(pairs)
    named = first.join(by_fp, first["fp"] == by_fp["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    of_fp = named.join(least, "group").select("fp", "component_id")
    # copies may be many: the side with one row per fingerprint is dealt anew, so that both sides can be split
    return prints.join(of_fp.repartition(parts(docs)).hint("merge"), "fp").select("doc_id", "fp", "component_id")


def near_pairs(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of rows of distinct (node, fp, fp1...) that meet in a table and are at most FAR bits apart."""
    names = [c for c in prints.columns if c != "node"]
    segments = F.array(*[F.struct(F.lit(3 * k + i).cast("long").alias("t"), F.lit(size).alias("size"), F.shiftrightunsigned(c, low).bitwiseAND((1 << size) - 1).alias("v"), F.col(c).alias("whole")) for k, c in enumerate(names) for i, (low, size) in enumerate(SEGMENTS)])
    rows = prints.select("node", F.explode(segments).alias("s")).select("node", "s.*")
    rows = rows.select("node", "whole", "t", "v", F.explode(F.sequence(F.lit(-1), F.col("size") - 1)).alias("bit"))
    flipped = F.when(F.col("bit") < 0, F.col("v")).otherwise(F.col("v").bitwiseXOR(F.element_at(F.lit(POWERS), F.greatest(F.col("bit"), F.lit(0)) + 1)))
    rows = rows.select("node", "whole", "bit", (F.col("t") * (1 << 22) + flipped).alias("key"))
    l, r = rows.alias("l"), rows.alias("r")
    # each pair comes once a table: bits that differ are flipped in order, or the only one on the right
    once = (F.col("l.node") < F.col("r.node")) & ((F.col("l.bit") < 0) | (F.col("l.bit") < F.col("r.bit")))
    near = l.join(r.hint("merge"), (F.col("l.key") == F.col("r.key")) & once & (F.bit_count(F.col("l.whole").bitwiseXOR(F.col("r.whole"))) <= FAR))
    return near.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def jaccard(one: str | None, two: str | None, width: int = NEAR_WIDTH) -> float:
    """Similarity of two texts' sets of word shingles; two texts without words are copies."""
    sets = []
    for text in (one, two):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    both = len(sets[0] | sets[1])
    return len(sets[0] & sets[1]) / both if both else 1.0


def near_copies(docs: DataFrame, width: int = NEAR_WIDTH, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, component_id) of documents in groups of near copies that are not the group's smallest doc_id.

    Equal texts are one. Of the texts with equal fingerprints the one with the smallest doc_id speaks for those that are
    verified as similar to it; the others speak for themselves. Pairs of such speakers that meet in a table are verified,
    and links go through components. Nothing goes without a verified similarity. Rows without doc_id take no part. Rows
    that repeat a doc_id count as one document with several texts.
    """

    def check(batches):
        for batch in batches:
            ok = [jaccard(x, y, width) >= similar for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    prints = stored(fingerprints(docs.filter("doc_id IS NOT NULL"), width, PRINTS, digest=True), "near-prints")
    names = prints.columns[1:-1]
    distinct = stored(prints.groupBy("digest", *names).agg(F.min("doc_id").alias("first")).withColumn("own", F.monotonically_increasing_id()), "near-distinct")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("own")).distinct().join(distinct.select("own", F.col("first").alias("doc_id"), "digest"), "own")
        # of rows that repeat a doc_id, the one with the text that is meant
        whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, "doc_id")
        texts = stored(whole.filter(F.sha2(F.col("text").cast("binary"), 256) == F.col("digest")).select("own", "text").dropDuplicates(["own"]), f"{name}-texts")
        both = pairs.join(texts.select(F.col("own").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("own").alias("b"), F.col("text").alias("tb")), "b")
        return stored(both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"), name)

    heads = distinct.groupBy(*names).agg(F.min(F.struct("first", "own")).alias("head"), F.count("*").alias("n")).filter("n > 1")
    same = stored(distinct.join(heads, names).select(F.col("head.own").alias("a"), F.col("own").alias("b")).filter("a <> b"), "near-same")
    spoken = verified(same, "near-spoken").select(F.col("b").alias("own"), F.col("a").alias("node"))
    nodes = stored(distinct.join(spoken, "own", "left").withColumn("node", F.coalesce("node", "own")), "near-nodes")
    pairs = stored(near_pairs(nodes.filter("own = node").select("node", *names)), "near-pairs")
    found = components(verified(pairs, "near-links"))
    named = nodes.join(found, "node", "left").select("digest", "first", F.coalesce("component", "node").alias("group"))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    of = named.join(least, "group").select("digest", "component_id")
    return prints.join(of.repartition(parts(docs)).hint("merge"), "digest").filter("doc_id > component_id").select("doc_id", "component_id").distinct()


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
