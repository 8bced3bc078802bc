"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

Each Arrow batch inserts its distinct pre-tokens in a trie of bytes, level by level. The forward score of a node (the
least cost of any split of its prefix into pieces, and the fewest pieces among splits of that cost) is computed once for
all words that share the prefix; each word stores the count at its terminal node, and documents sum their words'.

The pieces are those of a tiktoken rank file; the cost of a piece is the rounded millionfold natural logarithm of its
rank plus 2, the negative log-probability under Zipf's law up to a constant. Every byte is a piece, so every text has a
split. Costs are integers, so ties are exact. Pieces that end at a node are found by walking a second trie, of the
reversed pieces, through an exact table of (state, byte) pairs. Words of over LONG bytes take the same walk one by one,
in time linear in their length.

Null and empty texts count 0. Rows are independent of each other; null and repeated doc_ids pass through. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import RANKS, read_ranks
from .common import table
from .pretokens import numbered, split_words, sums_by_row

P = np.uint64(0x9E3779B97F4A7C15)
FAR, LONG = 1 << 60, 256


class Unigram:
    def __init__(self, path: str):
        self.walk, costs = {}, [FAR]  # state << 8 | byte -> state, in the trie of reversed pieces
        for word, rank in read_ranks(path).items():
            state = 0
            for x in reversed(word):
                state = self.walk.setdefault((state << 8) | x, len(costs))
                if state == len(costs):
                    costs.append(FAR)
            costs[state] = round(1e6 * float(np.log(rank + 2)))
        self.cost_list, self.costs = costs, np.array(costs, np.int64)
        # multiplication by an odd number is one to one, so equal hashes are equal pairs
        hashes = np.fromiter(self.walk, np.uint64, len(self.walk)) * P
        order = np.argsort(hashes)
        self.hashes, self.states = hashes[order], np.fromiter(self.walk.values(), np.int64, len(self.walk))[order]
        self.first = np.searchsorted(self.hashes >> np.uint64(46), np.arange((1 << 18) + 1, dtype=np.uint64))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next state of each pair, or -1."""
        h = ((state.astype(np.uint64) << np.uint64(8)) | byte) * P
        top = (h >> np.uint64(46)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(len(h), -1, np.int64)
        going = np.flatnonzero(at < end)
        while len(going):
            hit = self.hashes[at[going]] == h[going]
            out[going[hit]] = self.states[at[going[hit]]]
            going = going[~hit]
            at[going] += 1
            going = going[at[going] < end[going]]
        return out

    def count_long(self, word: bytes) -> int:
        walk, costs = self.walk, self.cost_list
        best, pieces = [0], [0]
        for j in range(1, len(word) + 1):
            state, least, n = 0, FAR, 0
            for i in range(j - 1, -1, -1):
                state = walk.get((state << 8) | word[i], -1)
                if state < 0:
                    break
                cost = costs[state] + best[i]
                if cost < least or (cost == least and pieces[i] + 1 < n):
                    least, n = cost, pieces[i] + 1
            best.append(least)
            pieces.append(n)
        return pieces[-1]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pieces of the least-cost split of each word."""
        sizes = np.diff(offsets)
        counts = np.zeros(len(sizes), np.int64)
        for w in np.flatnonzero(sizes > LONG).tolist():
            counts[w] = self.count_long(data[offsets[w] : offsets[w + 1]].tobytes())
        active = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        node = np.zeros(len(active), np.int64)  # of each active word, at the level before
        # by level: cost, pieces, byte and parent of each node
        levels = [(np.zeros(1, np.int64), np.zeros(1, np.int64), None, None)]
        depth = 0
        while len(active):
            depth += 1
            byte = data[offsets[active] + depth - 1].astype(np.int64)
            child, at = np.unique((node << 8) | byte, return_inverse=True)
            parent, own = child >> 8, (child & 255).astype(np.uint64)
            levels.append((np.full(len(child), FAR, np.int64), np.zeros(len(child), np.int64), own, parent))
            best, pieces = levels[-1][:2]
            some, up, state = np.arange(len(child)), np.arange(len(child)), np.zeros(len(child), np.int64)
            for back in range(1, depth + 1):
                _, _, letters, parents = levels[-back]
                state = self.step(state, letters[up])
                up = parents[up]
                on = state >= 0
                some, up, state = some[on], up[on], state[on]
                if not len(some):
                    break
                cost, n = self.costs[state] + levels[-back - 1][0][up], levels[-back - 1][1][up] + 1
                better = (cost < best[some]) | ((cost == best[some]) & (n < pieces[some]))
                best[some[better]], pieces[some[better]] = cost[better], n[better]
            ended = sizes[active] == depth
            counts[active[ended]] = pieces[at[ended]]
            active, node = active[~ended], at[~ended]
        return counts


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    return Unigram(path)


def count_tokens(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every whole text."""

    def run(batches):
        model = unigram(path)
        words = tokens = 0  # of the text that rows go on with
        for doc_ids, more, first, codes, data, offsets in numbered(batches):
            out = []
            for doc_id, on, w, n in zip(doc_ids, more, np.diff(first).tolist(), sums_by_row(model.count(data, offsets)[codes], first).tolist()):
                words, tokens = words + w, tokens + n
                if not on:
                    out.append((doc_id, words, tokens))
                    words = tokens = 0
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_pretokens", "n_tokens"])

    return split_words(docs, pattern, id_col, text_col).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
