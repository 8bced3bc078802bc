"""Pre-tokens of whole texts, split in the JVM and numbered batch by batch in Arrow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of one row, and words that are numbered at once. An Arrow batch has at most 10,000 rows by Spark's default, so
#: it holds at most 10,000 * ROW_WORDS words, however long the texts are.
ROW_WORDS, BATCH_WORDS = 256, 400_000


def java_pattern(pattern: str) -> str:
    """Blanks as Unicode has them; $ only at the end of the text."""
    return "(?U)" + pattern.replace("$", r"\z")


def split_words(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words array<string>, more): every match of the pattern, in order, in rows of ROW_WORDS; more: the next
    row goes on with the same text. Null texts have one row without words."""
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    last = F.floor((F.greatest(F.size("words"), F.lit(1)) - 1) / ROW_WORDS).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.slice("words", i * ROW_WORDS + 1, F.lit(ROW_WORDS)).alias("words"), (i < last).alias("more")))
    return rows.select("doc_id", F.explode(cut).alias("w")).select("doc_id", "w.words", "w.more")


def numbered(batches):
    """For each run of rows: doc ids, whether the next row goes on with the text, first word of each row (one more at
    the end), codes of all words, and the distinct words as (bytes, offsets)."""
    for batch in batches:
        lists = batch.column("words")
        ends = lists.offsets.to_numpy()
        more = batch.column("more").to_pylist()
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + BATCH_WORDS, side="right")) - 1)
            flat = lists.values.slice(ends[i], ends[j] - ends[i]).dictionary_encode()
            words = flat.dictionary
            offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64) if len(words) else np.zeros(1, np.int64)
            data = np.frombuffer(words.buffers()[2] or b"", np.uint8) if len(words) else np.zeros(0, np.uint8)
            yield batch.column("doc_id").slice(i, j - i).to_pylist(), more[i:j], (ends[i : j + 1] - ends[i]).astype(np.int64), flat.indices.to_numpy(), data[offsets[0] : offsets[-1]], offsets - offsets[0]
            i = j


def sums_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)
