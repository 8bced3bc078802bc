"""A corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents. Extra columns of any name ride along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.llm import byte_bpe, decontaminate, language_id, line_dedup, simhash
from corpusops.llm.common import remove, scratch, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) or with a posterior under one half go.

    Rows are independent: repeated rows and null doc_ids pass like others. An empty table stays empty.
    """
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    numbered = docs.select(*own, F.col("text").alias("text"))
    kept = language_id.predict(numbered, language_id.train(docs.filter(~language_id.held_out())))
    kept = kept.filter((F.col("lang_pred") != language_id.UND) & (F.col("score") >= 0.5))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of similar lines stays; a document that keeps no text goes, null texts included.

    Rows without doc_id count as one document that comes last; rows that repeat a doc_id as one document.
    """
    kept = line_dedup.dedup_lines(docs, shortest=1).filter(F.length(F.trim("text")) > 0)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies (five-word shingles, similarity 0.8) stays.

    Rows without doc_id always stay; rows that repeat a doc_id stay or go together. Null and empty texts are copies of
    each other.
    """
    return docs.join(simhash.near_copies(docs).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Rows without doc_id are judged as one document, and so are rows that repeat a doc_id. Null and empty texts hold
    nothing.
    """
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    found = decontaminate.contaminated(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), items)
    gone = found.select(F.col("id").alias("gone")).distinct()
    d, g = docs.alias("d"), gone.alias("g")
    return d.join(g, F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.gone")), "left_anti").select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and what they decode to, as digests; null texts count as empty, rows are independent."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(byte_bpe.RANKS))


STAGES = [
    ("language ID", identify),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE", tokenize),
]
#: Naive Bayes, MinHash and SimHash are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage stores on its way goes when its output is written, and its input,
    where that is another stage's output, goes too."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark) as keep:
            docs, path = keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if before:
            remove(spark, before)
        before = path
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
