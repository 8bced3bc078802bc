"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (1 to 3 code points of the lower-cased text) of all labelled documents of the learning
folds, each text by itself, hashed into 2^15 buckets; counts are summed by Spark, so layout and order do not matter. The log-probability matrix (2^15 x languages) is broadcast
in blocks of at most BLOCK languages, so no block is above 33 MB and the driver holds one at a time; batches of whole
texts are scored in numpy, by each block in turn.

Null texts and texts without a letter are `und` with score 0. Null or repeated doc_ids are rows like any other; a null
doc_id is in no held-out fold. Ties go to the language first by name. With no labelled text every document is `und`
with score 0. An empty table gives an empty result. Extra columns, whatever their names, ride along in `predict`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stored, table

BITS, BLOCK, CHUNK, TOGETHER = 15, 250, 1 << 20, 1 << 16
UND = "und"


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of one, two and three code points, each by the place where it starts."""
    a, b, c = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    one = x * a
    two = (one[:-1] ^ (x[1:] * b)) * c
    three = (two[:-1] ^ (x[2:] * a)) * b
    return tuple(g >> np.uint32(32 - BITS) for g in (one, two, three))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(text: str) -> np.ndarray:
    """Hashed n-grams of a text, those of one, two and three code points, in order of n."""
    return np.concatenate(_grams(_points(text.lower())))


def _pieces(text: str):
    """Hashed n-grams of a very long text, piece by piece: a piece has those that start in it."""
    text = text.lower()
    for i in range(0, len(text), CHUNK):
        yield np.concatenate([g[:CHUNK] for g in _grams(_points(text[i : i + CHUNK + 2]))])


def _each(texts: list[str]) -> np.ndarray:
    """Hashed n-grams of many texts at once, none across two texts."""
    texts = [t.lower() for t in texts]
    own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    one, two, three = _grams(_points("".join(texts)))
    return np.concatenate([one, two[own[:-1] == own[1:]], three[own[:-2] == own[2:]]])


def _count(batches):
    """For mapInArrow: (text, lang) to n-gram counts by language, once a task."""
    totals: dict[str, np.ndarray] = {}
    held: dict[str, list[str]] = {}

    def add(lang: str, grams: np.ndarray) -> None:
        totals.setdefault(lang, np.zeros(1 << BITS, np.int64))[:] += np.bincount(grams, minlength=1 << BITS)

    for batch in batches:
        sizes: dict[str, int] = {}
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            text = text.as_py()
            if len(text) > TOGETHER:
                for piece in _pieces(text):
                    add(lang, piece)
                continue
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] > TOGETHER:
                add(lang, _each(held.pop(lang)))
                sizes[lang] = 0
        for lang in [*held]:
            add(lang, _each(held.pop(lang)))
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})


def train(labelled: DataFrame, block: int = BLOCK) -> list[tuple[list[str], Broadcast]]:
    """Blocks of languages in order of name, each with the broadcast matrix of log P(bucket | language), whose last row
    has the log priors, from rows (text, lang)."""
    spark = labelled.sparkSession
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = stored(counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c")).select("lang", "c.bucket", "c.n"), "languages")
    priors = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    langs, total = sorted(priors), sum(priors.values())
    out = []
    for i in range(0, len(langs), block):
        names = langs[i : i + block]
        matrix = np.full(((1 << BITS) + 1, len(names)), 0.5)
        for r in packed.filter(F.col("lang").isin(names)).toLocalIterator():
            matrix[r["bucket"], names.index(r["lang"])] += r["n"]
        matrix[:-1] /= matrix[:-1].sum(axis=0)
        matrix[-1] = np.array([priors[x] for x in names]) / total
        out.append((names, spark.sparkContext.broadcast(np.log(matrix).astype(np.float32))))
    return out


def _totals(text: str, logs: np.ndarray) -> np.ndarray:
    """Log-probability of a text and each language of a block."""
    total = logs[-1].astype(np.float64)
    for piece in _pieces(text):
        if len(piece) > 15000:
            n = np.bincount(piece, minlength=1 << BITS)
            at = np.flatnonzero(n)
            total = total + n[at] @ logs[at].astype(np.float64)
        else:
            total = total + logs[piece].sum(axis=0, dtype=np.float64)
    return total


def _scorer(names: list[str], shared: Broadcast):
    @F.arrow_udf("lang string, top double, sum double")
    def best(texts: pa.Array) -> pa.Array:
        """The best language of a block, its log-probability, and the sum of all relative to it; null without a letter."""
        logs, out = shared.value, []
        for text in texts:
            text = text.as_py()
            if text is None or not any(map(str.isalpha, text)):
                out.append((None, None, None))
                continue
            total = _totals(text, logs)
            k = int(np.argmax(total))
            out.append((names[k], float(total[k]), float(np.exp(total - total[k]).sum())))
        columns = list(zip(*out)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.float64()))], names=["lang", "top", "sum"])

    return best


def predict(docs: DataFrame, model: list[tuple[list[str], Broadcast]]) -> DataFrame:
    """All columns of docs (text among them) are kept; lang_pred and score are added, in place of columns of that name."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    if not model:
        return docs.select(*kept, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    made = [free_name(docs, f"block{i}_") for i in range(len(model))]
    out = docs
    for name, (names, shared) in zip(made, model):
        out = out.withColumn(name, _scorer(names, shared)("text"))
    top = F.greatest(*[F.col(f"{m}.top") for m in made]) if len(made) > 1 else F.col(f"{made[0]}.top")
    lang = F.coalesce(*[F.when(F.col(f"{m}.top") == top, F.col(f"{m}.lang")) for m in made], F.lit(UND))
    parts = [F.col(f"{m}.sum") * F.exp(F.col(f"{m}.top") - top) for m in made]
    score = F.coalesce(1.0 / sum(parts[1:], parts[0]), F.lit(0.0))
    return out.select(*kept, lang.alias("lang_pred"), score.alias("score"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three of the four crc32 folds."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), train(docs.filter(~held_out())))
    return out.select("doc_id", "held_out", "lang_pred", "score")
