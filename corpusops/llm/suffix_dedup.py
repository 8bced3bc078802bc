"""Removal of repeated 50-byte strings across documents, exact, over whole texts.

Whole copies of a document with a smaller doc_id need no comparison: all their strings start there. The others go on:

Every 50-byte string has one anchor: the leftmost 16-byte string of least hash inside it. Equal strings have equal
anchors at equal offsets, so only suffixes that start at anchors (one in about 18) need to meet. A 50-byte string also
holds the 33 bytes that start at its anchor, or the 33 bytes that start 17 before it. Tasks deal packed hashes of both
to shards, one for each SHARD bytes of the corpus, SHARDS at least; those of one document only go. Texts then give, for
each anchor left, the bytes around it whose 50-byte strings it stands for; equal surroundings of a batch are one entry.

A hot passage does not follow its anchor into one shard. Of the places of a batch with one hash, which several documents
of the batch have, only one of the smallest and one of the largest document go to the hash's shard; that the others
repeat is known. Of the documents of a batch with equal surroundings, only the smallest goes to their shard; the others
lose all of them to it. What is known goes by its document.

Shards sort the suffixes of the surroundings by induction (induced_sort.py), part by part of PART surroundings or so;
strings that share 50 bytes are neighbours, and the smallest document of each is found; what starts in a smaller document
than one's own is removed.

Null and empty texts have nothing to remove. Rows with a null doc_id come last of all and cover nothing for each other;
rows that repeat a doc_id are one document, with several texts where these differ: they do not remove each other's bytes.
Spans carry a hash of what they say, so that each is cut from the text it belongs to. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, stored, table
from .induced_sort import sorted_suffixes
from .pretokens import ragged

SIZE, GRAM = 50, 16
SPAN = SIZE - GRAM + 1
#: Offsets of the anchor up to NEAR leave SIDE bytes from the anchor on; larger ones SIDE bytes from NEAR before it.
NEAR = SPAN // 2
SIDE = SIZE - NEAR
SHARDS, SHARD = 64, 4_000_000
PART = 10_000
P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
POWER, UPPER = np.uint64(pow(int(P), GRAM, 1 << 64)), np.uint64(0xFFFFFFFF00000000)
LAST = (1 << 63) - 1


def _grams(x: np.ndarray, size: int, p: np.uint64) -> np.ndarray:
    """Polynomial hash of each string of `size` bytes, by doubling."""
    h, have = x.astype(np.uint64) + np.uint64(1), 1
    out, got = None, 0
    power = int(p)
    while True:
        if size & have:
            if out is None:
                out, got = h, have
            else:
                n = len(x) - size + 1 if (got + have) == size else len(x) - (got + have) + 1
                shift = np.uint64(pow(int(p), have, 1 << 64))
                out = out[:n] * shift + h[got : got + n]
                got += have
            if got == size:
                return out[: len(x) - size + 1]
        h = h[:-have] * np.uint64(power) + h[have:]
        power = power * power % (1 << 64)
        have *= 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * Q
    return h ^ (h >> np.uint64(32))


def _anchors(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Positions, hashes, first and last start of the 50-byte strings that each anchor stands for; unmixed hashes of all
    16-byte strings."""
    n = len(x) - SIZE + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, e.astype(np.uint64), e, e, e.astype(np.uint64)
    grams = _grams(x, GRAM, P)
    h = _mix(grams)
    # leftmost least hash (of its upper 32 bits) of each run of SPAN: minima of blocks of powers of two, places in the low bits
    best, have = (h & UPPER) | np.arange(len(h), dtype=np.uint64), 1
    while have * 2 <= SPAN:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    at = (np.minimum(best[:n], best[SPAN - have : SPAN - have + n]) & ~UPPER).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:], [n]]) - 1
    return at[first], h[at[first]], first, last, grams


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes, and first and last start of the 50-byte strings that each anchor of a text stands for."""
    return _anchors(x)[:4]


def sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what must repeat with a 50-byte string, and twice the position of the anchor, plus 1 for the left side."""
    at, _, first, last, grams = _anchors(x)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def h(i: np.ndarray) -> np.ndarray:  # the hash of SIDE bytes, from those of two times GRAM and of one more
        return _mix((grams[i] * POWER + grams[i + GRAM]) * P + (x[i + 2 * GRAM].astype(np.uint64) + np.uint64(1)))

    right, left = at[at - last <= NEAR], at[at - first > NEAR]
    return np.concatenate([h(right), _mix(h(left - NEAR) + Q)]), np.concatenate([right * 2, left * 2 + 1])


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else x.tobytes())


def _unpack(x: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _pack_steps(x: np.ndarray) -> bytes:
    """Whole numbers as differences, byte by byte: the first bytes of all, the second bytes of all, and so on."""
    steps = np.diff(x, prepend=x.dtype.type(0))
    return _pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, x.itemsize).T))


def _unpack_steps(x: bytes, kind) -> np.ndarray:
    planes = _unpack(x).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _said(x: np.ndarray | bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of what stands in spans of a text."""
    view = memoryview(x)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(a.tolist(), b.tolist())), np.uint64, len(a)).view(np.int64)


def _zip(batches):
    """Texts compressed, and a hash by which whole copies meet."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in (b.slice(i, 1000) for b in batches for i in range(0, len(b), 1000)):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack.compress(t) for t in raw], pa.binary()), pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary())], names=["doc_id", "zipped", "whole"])


def _texts(batch):
    for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("zipped").to_pylist()):
        yield (LAST if i is None else i), _unpack(text)


def _known(h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of places sorted by hash and document, those of hashes with several documents, save one of the smallest document
    and one of the largest, by which other batches learn of the hash."""
    first = np.concatenate([[True], h[1:] != h[:-1]])
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(h)) - 1
    known = np.repeat(docs[start] < docs[end], end - start + 1)
    known[start] = known[end] = False
    return known


def _dealt(shard: np.ndarray, h: np.ndarray, docs: np.ndarray, at: np.ndarray, known: bool) -> Iterator[pa.RecordBatch]:
    """A row a shard. Places stay in order of documents, in which they pack well."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
    shard, h, docs, at = shard[order], h[order], docs[order], at[order]
    cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(h)]])
    each = lambda pack, c: pa.array([pack(c[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
    hashes = pa.nulls(len(cuts) - 1, pa.binary()) if known else each(_pack, _short(h))
    yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]].astype(np.int32)), hashes, each(_pack_steps, docs), each(_pack_steps, at)], names=["shard", "h", "docs", "at"])


def _by_doc(docs: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(docs.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _deal(shards: int):
    """Packed anchors (hash, document, position) by shard; without hashes, places known to repeat, by document."""

    def run(batches):
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, len(b), 2000)):
            found = []
            for doc, x in _texts(batch.sort_by("doc_id")):
                h, at = sides(x)
                found.append((h, np.full(len(at), doc, np.int64), at.astype(np.int32)))
            h, docs, at = (np.concatenate(c) for c in zip(*found)) if found else ([], [], [])
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")  # documents rise already
            known = np.empty(len(h), bool)
            known[order] = _known(h[order], docs[order])
            rest = ~known
            yield from _dealt((h[rest] >> np.uint64(40)).astype(np.int64) % shards, h[rest], docs[rest], at[rest], False)
            if known.any():
                yield from _dealt(_by_doc(docs[known], shards), h[known], docs[known], at[known], True)

    return run


def _short(h: np.ndarray) -> np.ndarray:
    """The lower 32 bits of each hash, whose upper bits chose the shard: a chance match only makes a candidate."""
    return h.astype("<u4")


def _places(docs: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Places packed by document."""
    order = np.lexsort((at, docs))
    docs, at = docs[order], at[order]
    if len(docs):
        cuts = np.concatenate([[0], np.flatnonzero(docs[1:] != docs[:-1]) + 1, [len(docs)]])
        for i in range(0, len(cuts) - 1, 10_000):
            part = cuts[i : i + 10_001]
            yield pa.RecordBatch.from_arrays([pa.array(docs[part[:-1]]), pa.array([at[a:b].tobytes() for a, b in zip(part[:-1], part[1:])], pa.binary())], names=["doc", "at"])


def _repeated(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that occur in several documents, packed by document."""
    h, docs, at = [], [], []
    for batch in rows:
        for r in batch.select(["h", "docs", "at"]).to_pylist():
            own, places = _unpack_steps(r["docs"], np.int64), _unpack_steps(r["at"], np.int32)
            if r["h"] is None:
                yield from _places(own, places)
                continue
            h.append(_unpack(r["h"], "<u4"))
            docs.append(own)
            at.append(places)
    if not h:
        return
    h, docs, at = (np.concatenate(c) for c in (h, docs, at))
    order = np.argsort(h)
    h, docs, at = h[order], docs[order], at[order]
    start = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
    several = np.minimum.reduceat(docs, start) < np.maximum.reduceat(docs, start)
    keep = np.repeat(several, np.diff(np.concatenate([start, [len(h)]])))
    yield from _places(docs[keep], at[keep])


AROUND = ["shard", "h", "texts", "sizes", "counts", "docs", "starts"]


def _surroundings(shards: int):
    """By shard: distinct surroundings of anchors with the smallest document of the batch that has them and its starts;
    without hashes, by document, the spans (docs, starts, sizes, and in place of texts their hashes) that the others lose to it."""

    def run(batches):
        for batch in (b.slice(i, 500) for b in batches for i in range(0, len(b), 500)):
            seen: dict[bytes, int] = {}  # a surrounding has one anchor, so its text names it
            ids, found = [], []
            some = batch.column("some").to_pylist()
            for (doc, x), wanted in zip(_texts(batch), some):
                at, h, first, last = anchors(x)
                asked = np.zeros(2 * len(x) + 2, bool)
                for w in wanted:
                    places = np.frombuffer(w, np.int32)
                    asked[places[places < len(asked)]] = True  # others are of another text with this doc_id
                right, left = asked[at * 2], asked[at * 2 + 1]
                # starts up to NEAR before the anchor need the right side, others the left
                first = np.where(left, first, np.maximum(first, at - NEAR))
                last = np.where(right, last, np.minimum(last, at - NEAR - 1))
                on = (right | left) & (first <= last)
                first, last, text = first[on], last[on], x.tobytes()
                ids += [seen.setdefault(text[i:j], len(seen)) for i, j in zip(first.tolist(), (last + SIZE).tolist())]
                found.append((h[on], np.full(len(first), doc, np.int64), first.astype(np.int32)))
            if not ids:
                continue
            texts, ids = list(seen), np.array(ids, np.int64)
            h, docs, starts = (np.concatenate(c) for c in zip(*found))
            of, sizes = np.empty(len(texts), np.uint64), np.fromiter(map(len, texts), np.int32, len(texts))
            of[ids] = h
            least = np.full(len(texts), LAST)
            np.minimum.at(least, ids, docs)
            gone = docs > least[ids]
            lost = (docs[gone], starts[gone], ids[gone]) if gone.any() else None
            order = np.flatnonzero(~gone)[np.argsort(ids[~gone], kind="stable")]
            counts = np.bincount(ids[~gone], minlength=len(texts))
            member = np.cumsum(counts) - counts
            shard = ((of >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
            dealt = np.argsort(shard, kind="stable")
            for e in np.split(dealt, np.flatnonzero(np.diff(shard[dealt])) + 1):
                own = order[ragged(member[e], counts[e])]
                packed = [of[e], b"".join(texts[k] for k in e.tolist()), sizes[e], counts[e].astype(np.int32), docs[own], starts[own]]
                yield pa.RecordBatch.from_arrays([pa.array([shard[e[0]]], pa.int32()), *[pa.array([_pack(c)], pa.binary()) for c in packed]], names=AROUND)
            if lost:
                docs, starts, ids = lost
                distinct, place = np.unique(ids, return_inverse=True)
                checks = np.fromiter((xxhash.xxh3_64_intdigest(texts[k]) for k in distinct.tolist()), np.uint64, len(distinct)).view(np.int64)[place]
                sizes = sizes[ids]
                to = _by_doc(docs, shards)
                for shard in np.unique(to).tolist():
                    on = to == shard
                    packed = {"docs": docs[on], "starts": starts[on], "sizes": sizes[on], "texts": checks[on]}
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *[pa.array([_pack(packed[c]) if c in packed else None], pa.binary()) for c in AROUND[1:]]], names=AROUND)

    return run


def _covered(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of starts, by document, whose 50-byte string starts in a smaller document. Anchors with one hash stay
    together; the rest of a shard goes through in parts of about PART surroundings."""
    cols: dict[str, list] = {}
    kinds = (("h", np.uint64), ("texts", np.uint8), ("sizes", np.int32), ("counts", np.int32), ("docs", np.int64), ("starts", np.int32))
    for batch in rows:
        for r in batch.select(AROUND[1:]).to_pylist():
            one = {name: _unpack(r[name], kind) for name, kind in kinds if r[name] is not None}
            if "h" not in one:
                a = one["starts"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(one["docs"]), pa.array(a), pa.array(a + one["sizes"]), pa.array(one["texts"].view(np.int64))], names=["doc", "a", "b", "said"])
                continue
            for name, x in one.items():
                cols.setdefault(name, []).append(x)
    if not cols:
        return
    c = {k: np.concatenate(v) for k, v in cols.items()}
    del cols
    order = np.argsort(c["h"], kind="stable")
    h = c["h"][order]
    edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
    sizes, counts = c["sizes"].astype(np.int64), c["counts"].astype(np.int64)
    begin, member = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + PART, side="right")) - 1)
        own = order[edges[i] : edges[j]]
        of = ragged(member[own], counts[own])
        yield from _part({"texts": c["texts"][ragged(begin[own], sizes[own])], "sizes": c["sizes"][own], "counts": c["counts"][own], "docs": c["docs"][of], "starts": c["starts"][of]})
        i = j


def _distinct(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Equal surroundings of several tasks as one, with the members of all."""
    sizes, counts = c["sizes"].astype(np.int64), c["counts"].astype(np.int64)
    begin, member, raw = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts, c["texts"].tobytes()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(raw[a : a + n], len(seen)) for a, n in zip(begin.tolist(), sizes.tolist())), np.int64, len(sizes))
    first = np.unique(ids, return_index=True)[1]
    order = np.argsort(ids, kind="stable")
    of = ragged(member[order], counts[order])
    return {"texts": c["texts"][ragged(begin[first], sizes[first])], "sizes": c["sizes"][first], "counts": np.bincount(ids, weights=counts).astype(np.int64), "docs": c["docs"][of], "starts": c["starts"][of]}


def _part(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of the surroundings by induction; neighbours that share 50 bytes are one string."""
    c = _distinct(c)
    sizes, counts = c["sizes"].astype(np.int64), c["counts"].astype(np.int64)
    member = np.cumsum(counts) - counts
    least = np.minimum.reduceat(c["docs"], member)
    strings = sizes - SIZE + 1
    shown = np.cumsum(strings) - strings
    begin = np.cumsum(sizes + 1) - (sizes + 1)  # a 0 ends each piece
    text = np.zeros(int((sizes + 1).sum()), np.int16)
    text[ragged(begin, sizes)] = c["texts"].astype(np.int16) + 1
    entry = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    smallest = np.empty(int(strings.sum()), np.int64)
    for at, lcp in sorted_suffixes(text, SIZE):
        start = np.flatnonzero(lcp < SIZE)
        group = np.cumsum(lcp < SIZE) - 1
        own = entry[at]
        first = np.minimum.reduceat(least[own], start)[group]
        offset = at - begin[own]
        whole = offset < strings[own]  # what is shorter ends before its 50th byte
        smallest[shown[own[whole]] + offset[whole]] = first[whole]
    # a run of starts for each member: strings of its entry with a smaller document than its own
    many = np.repeat(np.arange(len(sizes)), counts)
    step = 200_000
    place = np.cumsum(sizes) - sizes
    for i in range(0, len(many), step):
        m = many[i : i + step]
        n = strings[m]
        who = np.repeat(np.arange(len(m)), n)
        j = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        hit = smallest[shown[m][who] + j] < c["docs"][i : i + step][who]
        who, j = who[hit], j[hit]
        s = c["starts"][i : i + step][who] + j
        if not len(who):
            continue
        new = np.concatenate([[True], (who[1:] != who[:-1]) | (s[1:] != s[:-1] + 1)])
        a, b = np.flatnonzero(new), np.concatenate([np.flatnonzero(new)[1:], [len(who)]]) - 1
        at = place[m[who[a]]]
        yield pa.RecordBatch.from_arrays([pa.array(c["docs"][i : i + step][who[a]]), pa.array(s[a].astype(np.int64)), pa.array(s[b].astype(np.int64) + SIZE), pa.array(_said(c["texts"], at + j[a], at + j[b] + SIZE))], names=["doc", "a", "b", "said"])


def _cut(batches):
    for batch in (b.slice(i, 1000) for b in batches for i in range(0, len(b), 1000)):
        out = []
        for (_, x), spans, copy in zip(_texts(batch), batch.column("spans").to_pylist(), batch.column("copy").to_pylist()):
            mark = np.zeros(len(x) + 1, np.int32)
            if spans:
                a, b, said = (np.array([s[k] for s in spans], np.int64) for k in ("a", "b", "said"))
                # rows that repeat a doc_id with another text have spans of the other, which say something else here
                inside = b <= len(x)
                a, b, said = a[inside], b[inside], said[inside]
                own = _said(x, a, b) == said
                np.add.at(mark, a[own], 1)
                np.add.at(mark, b[own], -1)
            if copy and len(x) >= SIZE:
                mark[0] += 1
            gone = np.cumsum(mark[:-1]) > 0
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(x) else 0
            out.append((len(x), int(gone.sum()), runs, x[~gone].tobytes()))
        n, removed, runs, kept = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every document."""
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(SHARDS, parts(docs), n_bytes // SHARD)
    zipped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_zip, "doc_id long, zipped binary, whole binary")
    key = F.coalesce("doc_id", F.lit(LAST))
    first = zipped.groupBy("whole").agg(F.min(key).alias("first"))
    copies = stored(zipped.select("whole", key.alias("doc")).join(first, "whole").filter("doc > first").groupBy("doc").agg(F.collect_set("whole").alias("wholes")), "copies")
    is_copy = F.coalesce(F.array_contains("wholes", F.col("whole")), F.lit(False))
    unique = zipped.join(copies, key == copies["doc"], "left").filter(~is_copy).select("doc_id", "zipped")
    repeated = unique.mapInArrow(_deal(shards), "shard int, h binary, docs binary, at binary").groupBy("shard").applyInArrow(_repeated, "doc long, at binary")
    wanted = repeated.groupBy("doc").agg(F.collect_list("at").alias("some"))
    texts = unique.join(wanted, key == wanted["doc"]).select("doc_id", "zipped", "some")
    around = texts.mapInArrow(_surroundings(shards), "shard int, h binary, texts binary, sizes binary, counts binary, docs binary, starts binary")
    spans = around.groupBy("shard").applyInArrow(_covered, "doc long, a long, b long, said long").groupBy("doc").agg(F.collect_list(F.struct("a", "b", "said")).alias("spans"))
    marks = stored(spans.join(copies, "doc", "full"), "spans")
    marked = zipped.join(marks, key == marks["doc"], "left").select("doc_id", "zipped", "spans", is_copy.alias("copy"))
    return marked.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 50-byte strings of smaller documents."""
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


