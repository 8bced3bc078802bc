"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words inside a sentence) and units turn into typed placeholders,
other words are lower-cased and stripped of punctuation. Windows of 8 template words are hashed to 128 bits; a window
counts only with at least 4 plain words. Windows of documents are hash-joined with those of benchmark items, and the slots of
matching windows are compared: within an occurrence of an item, each slot value of the item must always stand for the
same value, so re-parameterised questions are caught and chance alignments are not.

A document is contaminated by an item if an occurrence holds at least half of the item's distinct windows, or at least
13 of them, and at least half of the item's slot values are filled consistently (or there are none). Occurrences are
the windows of one alignment (place in the document less place in the item), those whose alignments lie in one cell of
the item's length (two grids, half a cell apart), and all windows of document and item; one that passes is enough.
Items of at least 5 words without a window that counts are found where they stand word by word.

Document windows are first reduced in the tasks to those whose hash is in the benchmark, if the benchmark has at most
LIMIT windows (a checked bound of 16 MB as hashes); beyond it all windows go through the shuffled join, with the same
result. Items of 5 to 7 words are one window each; shorter ones cannot be told from chance and match nothing.

Null and empty texts hold nothing. Repeated items or documents count once per id. An empty table on either side gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

WINDOW, SHORTEST, PLAIN, ENOUGH, SHARE, LIMIT = 8, 5, 4, 13, 0.5, 2_000_000
#: Units whose words become a placeholder.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds dollar dollars euro euros cent cents percent degree degrees".split())
NUMBER = re.compile(r"[+-]?[\d.,:/%$€£-]*\d[\d.,:/%$€£-]*")
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
KEYS = ("benchmark-words1", "benchmark-words2")
P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Words whose forms a worker remembers from batch to batch.
MEMO, REMEMBERED = {}, 300_000


def _hashes(words: list[str], key: str) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), hash_key=key, categorize=False)


def _word(raw: str) -> tuple[str, int, bool]:
    """Plain form, kind (0 nothing, 1 plain, 2 number, 3 unit, 4 a name unless it begins a sentence), ends a sentence."""
    # letters are no punctuation and no numbers
    end = not raw.isalpha() and raw.rstrip("\"')]}").endswith((".", "!", "?"))
    core = raw if raw.isalpha() else raw.strip("\"'()[]{}<>.,;:!?*#&|_~`")
    if not core.isalpha():
        if not NUMBER.fullmatch(core):
            core = "".join(c for c in core if not unicodedata.category(c).startswith("P"))
        if not any(map(str.isalnum, core)):
            return "", 0, end
        if NUMBER.fullmatch(core):
            return core, 2, end
    plain = core.lower()
    if plain in UNITS:
        return plain, 3, end
    return plain, 4 if core[:1].isupper() and core[1:].islower() else 1, end


def _known(words: list[str]) -> list[tuple[str, int, bool]]:
    """_word of each word."""
    out = []
    for raw in words:
        found = MEMO.get(raw)
        if found is None:
            found = _word(raw)
            if len(raw) <= 64:
                if len(MEMO) >= REMEMBERED:
                    MEMO.clear()
                MEMO[raw] = found
        out.append(found)
    return out


def _sieve(keep: np.ndarray) -> np.ndarray:
    """By the lowest bits of a hash, whether keep may have it."""
    bits = np.zeros(1 << max(16, (8 * len(keep)).bit_length()), bool)
    bits[keep & (len(bits) - 1)] = True
    return bits


def windows_of(texts: pa.Array, sizes: tuple[int, ...] = (WINDOW,), keep: np.ndarray | None = None, sieve: np.ndarray | None = None):
    """For each size, of its windows that count and whose first hash is in keep, if that is given: place, row of the text,
    place in the text, two hashes; and the function that gives the slots of a place.

    Negative sizes: windows of the words themselves, without placeholders, all of which count.
    """
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    flat = split.flatten().dictionary_encode()
    known = _known(flat.dictionary.to_pylist())
    codes = flat.indices.to_numpy()
    row = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    kinds = np.fromiter((k[1] for k in known), np.int8, len(known))
    kind, ends = kinds[codes], np.fromiter((k[2] for k in known), bool, len(known))[codes]
    begins = np.ones(len(codes), bool)
    begins[1:] = ends[:-1] | (row[1:] != row[:-1])
    on = kind > 0
    codes, row, kind, begins = codes[on], row[on], kind[on], begins[on]
    kind = np.where((kind == 4) & begins, 1, kind)
    places = {2: NUM, 3: UNIT, 4: NAME}
    forms = [k[0] for k in known]
    tables = [_hashes([*forms, *places.values()], key) for key in KEYS]
    held = np.select([kind == k for k in places], [len(forms) + i for i in range(len(places))], codes)
    plain = np.concatenate([[0], np.cumsum(kind == 1)])
    for sign in (1, -1):
        of = held if sign > 0 else codes
        wanted = {abs(s) for s in sizes if s * sign > 0}
        hashes = tables[0][of] if wanted else None
        out = np.zeros(len(of), np.uint64)
        for size in range(1, min(max(wanted, default=0), len(of)) + 1):
            # the hash of a window is that of the one shorter by a word, carried on
            n = len(of) - size + 1
            out = out[:n]
            np.multiply(out, P, out=out)
            out += hashes[size - 1 :]
            if size not in wanted:
                continue
            h = out.view(np.int64)
            at = np.arange(n) if keep is None else np.flatnonzero(sieve[h & (len(sieve) - 1)])
            if keep is not None and len(at):
                at = at[keep[np.minimum(np.searchsorted(keep, h[at]), len(keep) - 1)] == h[at]]
            at = at[row[at] == row[at + size - 1]]
            if sign > 0:
                at = at[plain[at + size] - plain[at] >= min(PLAIN, size)]
            second = np.zeros(len(at), np.uint64)
            for i in range(size):
                second = second * Q + tables[1][of[at + i]]

            def slots(i: int, words: int = size if sign > 0 else 0) -> list[str]:
                return [forms[codes[j]] for j in range(i, i + words) if kind[j] > 1]

            yield sign * size, at, row[at], at - np.searchsorted(row, row[at]), h[at], second.view(np.int64), slots


def _windows(sizes: tuple[int, ...], keep):
    def run(batches):
        hashes = keep.value if keep is not None else None
        if hashes is not None and not len(hashes):
            return
        sieve = _sieve(hashes) if hashes is not None else None
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                for size, found, row, at, h, h2, slots in windows_of(part.column("text"), sizes, hashes, sieve):
                    if len(found):
                        yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(np.full(len(found), size, np.int32)), pa.array(h), pa.array(h2), pa.array([slots(i) for i in found.tolist()], pa.list_(pa.string())), pa.array(at, pa.int64())], names=["id", "size", "h", "h2", "slots", "at"])

    return run


KIND = "id long, size int, h long, h2 long, slots array<string>, at long"


def _lengths(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: sum(_word(w)[1] > 0 for w in (x or "").split()))


def item_windows(items: DataFrame) -> DataFrame:
    """(id, size, h, h2, slots, at) of benchmark items (id, text); short items have one window of their own size."""
    n = F.pandas_udf(_lengths, "int")("text")
    # stored, as a task that sizes and cuts at once would take two Python workers, which then stay
    sized = stored(items.select("id", "text", n.alias("n")), "benchmark-sized")
    parts = [sized.filter(F.col("n") >= WINDOW).select("id", "text").mapInArrow(_windows((WINDOW,), None), KIND)]
    parts += [sized.filter(F.col("n") == k).select("id", "text").mapInArrow(_windows((k,), None), KIND) for k in range(SHORTEST, WINDOW)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = stored(out, "benchmark-counted")
    bare = sized.join(out.select("id").distinct(), "id", "left_anti")
    out = out.unionByName(bare.filter(F.col("n") >= WINDOW).select("id", "text").mapInArrow(_windows((-WINDOW,), None), KIND))
    for k in range(SHORTEST, WINDOW):
        out = out.unionByName(bare.filter(F.col("n") == k).select("id", "text").mapInArrow(_windows((-k,), None), KIND))
    return out


def _exact(texts: pd.Series) -> pd.Series:
    """The plain words of a text of under SHORTEST words, as one string; null for others."""

    def form(text: str | None) -> str | None:
        words = [plain for plain, kind, _ in map(_word, (text or "").split()) if kind]
        return " ".join(words) if 0 < len(words) < SHORTEST else None

    return texts.map(form)


def short_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, item_id, ...) of items of under SHORTEST words and the documents that are nothing but the item: too little for
    a window, so all words must be the same. Texts of 64 pieces or more between blanks are no such documents."""
    # else the filter goes below and forms are made twice, by two Python workers a task, which then stay
    form = F.pandas_udf(_exact, "string").asNondeterministic()
    of = lambda df: df.filter(F.size(F.split(F.trim("text"), r"\s+", 64)) < 64).withColumn("form", form("text")).filter("form IS NOT NULL")
    pairs = of(docs).select("id", "form").join(of(items).select(F.col("id").alias("item_id"), "form"), "form").select("id", "item_id").distinct()
    return pairs.select("id", "item_id", F.lit(1).cast("long").alias("n_windows"), F.lit(1).cast("long").alias("item_windows"), F.lit(1.0).alias("coverage"), F.lit(True).alias("slots_consistent"))


def contaminated(docs: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, item_id, n_windows, item_windows, coverage, slots_consistent) for docs (id, text) and items (id, text)."""
    spark = docs.sparkSession
    known = stored(item_windows(items), "benchmark").withColumnRenamed("id", "item_id").withColumnRenamed("slots", "item_slots").withColumnRenamed("at", "item_at")
    distinct = known.select("size", "h").distinct()
    sizes = tuple(sorted(r["size"] for r in distinct.select("size").distinct().collect())) or (WINDOW,)
    few = distinct.limit(limit + 1).count() <= limit
    keep = spark.sparkContext.broadcast(np.unique(distinct.select("h").toPandas()["h"].to_numpy(np.int64))) if few else None
    found = docs.select("id", "text").mapInArrow(_windows(sizes, keep), KIND)
    item_size = known.groupBy("item_id").agg(
        F.countDistinct("size", "h").alias("item_windows"), F.countDistinct("item_at").alias("item_places"), (F.max("item_at") + WINDOW).alias("length")
    )
    # hot windows meet the small distinct side of items
    once = known.select("item_id", "size", "h", "h2", "item_slots", "item_at").distinct().join(item_size.select("item_id", "length"), "item_id")
    hits = found.join(once, ["size", "h", "h2"]).withColumn("offset", F.col("at") - F.col("item_at"))
    cell = F.col("offset") / F.col("length")
    part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("value"))
    hits = hits.withColumn("part", F.explode(F.array(part(0, F.lit(0)), part(1, F.col("offset")), part(2, F.floor(cell)), part(3, F.floor(cell + 0.5)))))
    key = ["id", "item_id", "part", (F.col("size") < 0).alias("verbatim")]
    pairs = hits.select(*key, "h", "item_at", F.explode_outer(F.arrays_zip("item_slots", "slots")).alias("z")).select("id", "item_id", "part", "verbatim", "h", "item_at", F.col("z.item_slots").alias("want"), F.col("z.slots").alias("got"))
    by_value = pairs.groupBy("id", "item_id", "part", "verbatim", "want").agg(F.collect_set("h").alias("hs"), F.collect_set("item_at").alias("places"), F.size(F.collect_set("got")).alias("n"))
    score = by_value.groupBy("id", "item_id", "part", "verbatim").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hs")))).cast("long").alias("n_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
        F.count("want").alias("slots"),
        F.count(F.when(F.col("want").isNotNull() & (F.col("n") == 1), 1)).alias("steady"),
    )
    out = score.join(item_size, "item_id").withColumn("coverage", F.round(F.col("n_windows") / F.col("item_windows"), 6))
    template = ((F.col("coverage") >= SHARE) | (F.col("n_windows") >= ENOUGH)) & (F.col("steady") * 2 >= F.col("slots"))
    whole = (F.col("part.kind") == 1) & (F.col("places") == F.col("item_places"))
    out = out.withColumn("slots_consistent", F.when(F.col("verbatim"), whole).otherwise(template))
    out = out.groupBy("id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("coverage").alias("coverage"), F.max("slots_consistent").alias("slots_consistent"))
    out = out.filter("slots_consistent").select("id", "item_id", "n_windows", "item_windows", "coverage", "slots_consistent")
    return out.unionByName(short_matches(docs.select("id", "text"), items))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, ...) for every document that holds a benchmark item, verbatim or with other slot values."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return contaminated(docs, items).withColumnRenamed("id", "doc_id")
