"""Sorting the suffixes of a shard by induction, with common-prefix values, through queues on disk.

The text is an array of bytes raised by one, with 0 between pieces. A suffix is S if it is smaller than the next one,
else L; an S after an L is an LMS suffix. The substrings between LMS places get names in their order, and the string of
names, at most half as long, is sorted first: that gives the order of the LMS suffixes. From them the L suffixes are
induced in rising order of their first byte and from those the S suffixes in falling order: a suffix hands the one that
starts a place before it to the queue of that one's first byte, where it arrives in its final order. Tuples of place and
common prefix with the tuple before wait in one queue for each byte; queues spill to files of a temporary folder that
goes when the sort is done. The common prefix of two neighbours of a queue is one more than the least common prefix
between the suffixes that handed them over; all values stop at `cap`.

Order and values are exact up to `cap` bytes, which is all that the caller asks for: beyond it the names of equal
stretches are not compared further.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np


class Queues:
    """First in, first out by byte; what exceeds `memory` bytes waits in files."""

    def __init__(self, folder: str, name: str, memory: int):
        self.path, self.memory, self.held = f"{folder}/{name}", memory, 0
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.files: set[int] = set()
        self.kind = np.dtype([("at", np.int64), ("lcp", np.uint8)])

    def push(self, byte: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.setdefault(byte, []).append((at, lcp.copy()))  # the caller goes on with its own
        self.held += at.nbytes + lcp.nbytes
        if self.held > self.memory:
            for b, parts in self.parts.items():
                self.files.add(b)
                with open(f"{self.path}-{b}", "ab") as out:
                    for at, lcp in parts:
                        rows = np.empty(len(at), self.kind)
                        rows["at"], rows["lcp"] = at, lcp
                        rows.tofile(out)
            self.parts, self.held = {}, 0

    def pop(self, byte: int) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        if byte in self.files:
            file = f"{self.path}-{byte}"
            rows = np.fromfile(file, self.kind)
            os.unlink(file)
            self.files.remove(byte)
            parts.append((rows["at"], rows["lcp"]))
        mine = self.parts.pop(byte, [])
        self.held -= sum(at.nbytes + lcp.nbytes for at, lcp in mine)
        parts += mine
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.uint8)
        return tuple(map(np.concatenate, zip(*parts)))


def types(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is S, and the number of equal bytes from each place on (255 at most)."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    end = np.append(differs, n - 1)[np.searchsorted(differs, np.arange(n))]  # last place of each run
    rises = np.append(t[1:] > t[:-1], True)
    return rises[end], np.minimum(end - np.arange(n) + 1, 255).astype(np.uint8)


def names(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings, seven letters of (byte, type) a step."""
    sizes = np.append(np.diff(lms) + 1, 1)
    letters = np.concatenate([t.astype(np.uint64) * np.uint64(2) + is_s, np.zeros(7, np.uint64)])
    rank = np.zeros(len(lms), np.int64)
    active = np.arange(len(lms))
    step = 0
    while len(active):
        word = np.zeros(len(active), np.uint64)
        for i in range(7):
            inside = sizes[active] > step + i
            word = (word << np.uint64(9)) | np.where(inside, letters[np.minimum(lms[active] + step + i, len(letters) - 1)], np.uint64(0))
        order = np.lexsort((word, rank[active])) if step else np.argsort(word)
        r, w = rank[active][order], word[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])])
        # ranks leave room: a rank is the place of its first member among all
        base = np.concatenate([[True], r[1:] != r[:-1]])
        start = np.maximum.accumulate(np.where(base, np.arange(len(r)), 0))
        first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
        rank[active[order]] = r + (first - start)
        step += 7
        same = np.zeros(len(r), bool)
        same[1:] |= ~new[1:]
        same[:-1] |= ~new[1:]
        active = np.sort(active[order[same]])
        active = active[sizes[active] > step]
    return rank


def order_of(rank: np.ndarray, steps: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling until names are unique or `steps` names are compared."""
    n, have = len(rank), 1
    while True:
        order = np.argsort(rank, kind="stable")
        sorted_ = rank[order]
        if have >= steps or (sorted_[1:] != sorted_[:-1]).all():
            return order
        follow = np.full(n, -1, np.int64)
        follow[:-have] = rank[have:]
        order = np.argsort(rank * (n + 1) + follow + 1)  # ranks are below n
        new = np.concatenate([[True], (rank[order][1:] != rank[order][:-1]) | (follow[order][1:] != follow[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        have *= 2


def common(t: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix of an order with the one before it."""
    padded = np.concatenate([t, np.zeros(cap + 1, t.dtype)])
    out = np.zeros(len(order), np.uint8)
    active = np.arange(1, len(order))
    for i in range(cap):
        active = active[padded[order[active] + i] == padded[order[active - 1] + i]]
        out[active] = i + 1
        if not len(active):
            break
    return out


def _hand_over(queues: Queues, t: np.ndarray, at: np.ndarray, lcp: np.ndarray, byte: int, wanted: np.ndarray, cap: int) -> None:
    """Suffixes before those of a scanned bucket go to their queues."""
    before = at - 1
    ok = (before >= 0) & wanted[before]
    first = t[np.maximum(before, 0)]
    ok &= first != byte
    if not ok.any():
        return
    places = np.flatnonzero(ok)
    to = first[places]
    grouped = np.argsort(to, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(to[grouped])) + 1, [len(to)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        mine = places[grouped[a:b]]
        least = np.zeros(len(mine), np.uint8)  # the first one comes after suffixes of another bucket
        if len(mine) > 1:
            spans = np.minimum.reduceat(lcp[: mine[-1] + 1], mine[:-1] + 1)
            least[1:] = spans
        queues.push(int(to[grouped[a]]), before[mine], np.minimum(least + 1, cap).astype(np.uint8))


def _bucket(at: np.ndarray, lcp: np.ndarray, t: np.ndarray, byte: int, wanted: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """A queue's suffixes and those before them that start with the same byte, round by round."""
    all_at, all_lcp, depth = [at], [lcp], 0
    while len(at):
        depth += 1
        before = at - 1
        same = np.flatnonzero((before >= 0) & wanted[before] & (t[np.maximum(before, 0)] == byte))
        if not len(same):
            break
        least = np.full(len(same), depth, np.uint8) if depth < cap else np.full(len(same), cap, np.uint8)
        if len(same) > 1:
            least[1:] = np.minimum(np.minimum.reduceat(lcp[: same[-1] + 1], same[:-1] + 1) + 1, cap)
        at, lcp = before[same], least
        all_at.append(at)
        all_lcp.append(lcp)
    return np.concatenate(all_at), np.concatenate(all_lcp)


def sorted_suffixes(t: np.ndarray, cap: int, memory: int = 64 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes in falling order, bucket by bucket: places, and the common prefix of each with the one before it (0 for a
    bucket's first). t: bytes + 1, 0 between pieces and at the end."""
    is_s, run = types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    seeds = lms[order_of(names(t, is_s, lms), cap)]
    shared = common(t, seeds, cap)
    of_seed = np.searchsorted(t[seeds], np.arange(258)) if len(seeds) else np.zeros(258, np.int64)
    capped = lambda x: np.minimum(x, cap).astype(np.uint8)
    with tempfile.TemporaryDirectory() as folder:
        large, ready, small = (Queues(folder, name, memory) for name in ("l", "ready", "s"))
        for byte in range(257):
            at, lcp = _bucket(*large.pop(byte), t, byte, ~is_s, cap)
            if len(at):
                ready.push(byte, at, lcp)
            own = seeds[of_seed[byte] : of_seed[byte + 1]]
            if len(own):
                more = shared[of_seed[byte] : of_seed[byte + 1]].copy()
                more[0] = capped(min(run[at[-1]], run[own[0]])) if len(at) else 0
                at, lcp = np.concatenate([at, own]), np.concatenate([lcp, more])
            if len(at):
                lcp[0] = 0
                _hand_over(large, t, at, lcp, byte, ~is_s, cap)
        for byte in range(256, -1, -1):
            at, lcp = _bucket(*small.pop(byte), t, byte, is_s, cap)
            own, more = ready.pop(byte)
            if len(own):
                # in falling order a value belongs to the next one
                turned = np.concatenate([[0], more[:0:-1]]).astype(np.uint8)
                own = own[::-1]
                if len(at):
                    turned[0] = capped(min(run[at[-1]], run[own[0]]))
                at, lcp = np.concatenate([at, own]), np.concatenate([lcp, turned])
            if len(at):
                lcp[0] = 0
                _hand_over(small, t, at, lcp, byte, is_s, cap)
                yield at, lcp
