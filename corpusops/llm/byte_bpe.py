"""Byte-level BPE encoding and decoding by ranked merges over the byte arrays of distinct words.

Texts are split into words in the JVM. Each Arrow batch numbers its distinct words, and all their byte arrays are
folded at once: each round looks up the rank of every adjacent pair in a rank map (a two-slot hash table of pair to
merged id), merges the leftmost pair of least rank in each word, and drops the words that are done. Documents gather
their words' ids; decoding concatenates the pieces of the ids. Nothing is shuffled and no document leaves its task, so
work and memory follow the batch. A text is sent in rows of a few hundred words, and its digests are carried from row to
row, so one very long text needs no more memory than others.

The fold as Spark higher-order functions over literal arrays (README) gave the same ids at 120 microseconds a word,
three times the time allowed, so the fold is done in numpy inside the tasks.

Null and empty texts have no ids and decode to nothing. Rows are independent: repeated rows, ties and null doc_ids pass
through. Extra columns are ignored. Words of over LONG bytes merge through a heap, with the same result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .pretokens import numbered, ragged, split_words

NONE, LONG, SLOTS = 1 << 30, 256, 1 << 18
RANKS = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def _slots(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = key.astype(np.uint64)
    return ((k * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(46)).astype(np.int64), ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


class Vocabulary:
    """Ranks of a tiktoken file: pieces by id, the id of each byte, and the map of pairs of ids to merged ids."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.pieces = {rank: word for word, rank in self.ranks.items()}
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for word, rank in self.ranks.items():
            for i in range(1, len(word)):
                a, b = self.ranks.get(word[:i]), self.ranks.get(word[i:])
                if a is not None and b is not None:
                    pairs[(a << 17) | b] = rank
        self.pairs = pairs
        self.keys, self.values = np.full(SLOTS, -1, np.int64), np.full(SLOTS, NONE, np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        one, two = (dict(zip(keys.tolist(), s.tolist())) for s in _slots(keys))
        self.rest = {}  # pairs that find no slot; looked up one by one
        for key, rank in pairs.items():
            at = one[key]
            for _ in range(200):
                if self.keys[at] < 0:
                    self.keys[at], self.values[at] = key, rank
                    break
                old = int(self.keys[at]), int(self.values[at])
                self.keys[at], self.values[at] = key, rank
                key, rank = old
                at = two[key] if at == one[key] else one[key]
            else:
                self.rest[key] = rank

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 17) | right
        a, b = _slots(key)
        out = np.where(self.keys[a] == key, self.values[a], np.where(self.keys[b] == key, self.values[b], NONE))
        for k, rank in self.rest.items():
            out[key == k] = rank
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """Leftmost pair of least rank first, through a heap of pairs over a linked list."""
        ids = [int(self.of_byte[x]) for x in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(ids)
            if j < len(ids) and (rank := self.pairs.get((ids[i] << 17) | ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of ids of each word."""
        sizes = np.diff(offsets)
        done = [(np.array([w]), np.array([len(x)]), np.array(x, np.int64)) for w in np.flatnonzero(sizes > LONG) for x in [self.merge_long(data[offsets[w] : offsets[w + 1]].tobytes())]]
        word = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        size = sizes[word]
        ids = self.of_byte[data[ragged(offsets[word], size)]]
        while len(word):
            start = np.cumsum(size) - size
            ranks = np.full(len(ids), NONE, np.int64)
            if len(ids) > 1:
                ranks[:-1] = self.pair_ranks(ids[:-1], ids[1:])
            ranks[start + size - 1] = NONE
            best = np.minimum.reduceat((ranks << 32) | np.arange(len(ids)), start)
            going = (best >> 32) < NONE
            if not going.all():
                over = ~going
                done.append((word[over], size[over], ids[ragged(start[over], size[over])]))
            at = best[going] & 0xFFFFFFFF
            ids[at] = best[going] >> 32
            keep = np.repeat(going, size)
            keep[at + 1] = False
            ids, word, size = ids[keep], word[going], size[going] - 1
        counts = np.zeros(len(sizes), np.int64)
        if not done:
            return np.zeros(0, np.int64), counts
        words, lengths, flat = (np.concatenate(x) for x in zip(*done))
        counts[words] = lengths
        order = np.argsort(words, kind="stable")
        return flat[ragged((np.cumsum(lengths) - lengths)[order], lengths[order])], counts


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text."""

    def run(batches):
        v = vocabulary(path)
        open_ids = []  # of a text that goes on in the next row
        for doc_ids, more, first, codes, data, offsets in numbered(batches):
            ids, counts = v.encode(data, offsets)
            start = np.cumsum(counts) - counts
            done, out = [], []
            for i, doc_id in enumerate(doc_ids):
                own = codes[first[i] : first[i + 1]]
                open_ids.append(ids[ragged(start[own], counts[own])])
                if not more[i]:
                    done.append(doc_id)
                    out.append(np.concatenate(open_ids))
                    open_ids = []
            ends = np.cumsum([0, *map(len, out)])
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return split_words(docs, pattern, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes): the pieces of (doc_id, ids) one after the other."""

    def run(batches):
        pieces = vocabulary(path).pieces
        for batch in batches:
            texts = [None if ids is None else b"".join([pieces[i] for i in ids]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each distinct word of a batch once.

    The decimal form and the decoded bytes of a word are made from its ids; a document joins those of its words.
    """

    def run(batches):
        v = vocabulary(path)
        number = {i: str(i).encode() for i in v.pieces}
        n, shown, decoded = 0, hashlib.sha256(), hashlib.sha256()  # of the text that rows go on with
        for doc_ids, more, first, codes, data, offsets in numbered(batches):
            ids, counts = v.encode(data, offsets)
            flat, sizes, ends = ids.tolist(), counts.tolist(), np.cumsum(counts).tolist()
            said, back, a = [], [], 0
            for b in ends:
                word = flat[a:b]
                said.append(b" ".join([number[i] for i in word]))
                back.append(b"".join([v.pieces[i] for i in word]))
                a = b
            out = []
            for i, doc_id in enumerate(doc_ids):
                own = codes[first[i] : first[i + 1]].tolist()
                if own:
                    shown.update((b" " if n else b"") + b" ".join([said[c] for c in own]))
                    decoded.update(b"".join([back[c] for c in own]))
                    n += sum([sizes[c] for c in own])
                if not more[i]:
                    out.append((doc_id, n, shown.hexdigest(), decoded.hexdigest()))
                    n, shown, decoded = 0, hashlib.sha256(), hashlib.sha256()
            columns = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return split_words(docs, pattern).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document."""
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


