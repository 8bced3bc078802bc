"""What op4 deals to its shards: small, in order of documents, and the same after unpacking."""

import random

import numpy as np
import pyarrow as pa

from corpusops.llm import suffix_dedup as S


def test_dealt_places_are_small_and_come_back():
    roll = random.Random(2)
    texts = ["".join(roll.choices("abcdefgh ", k=1500)).encode() for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300, 0, -1)), "zipped": [S._pack(t) for t in texts]})
    rows = [r for b in S._deal(7)(iter([batch])) for r in b.to_pylist()]
    want = {(300 - k, int(at), int(h)) for k, t in enumerate(texts) for h, at in zip(*S.sides(np.frombuffer(t, np.uint8)))}
    got, n_bytes = set(), 0
    for r in rows:
        docs, at, h = S._unpack_steps(r["docs"], np.int64), S._unpack_steps(r["at"], np.int32), S._unpack(r["h"], "<u4")
        assert (np.diff(docs) >= 0).all()
        got |= set(zip(docs.tolist(), at.tolist(), h.tolist()))
        n_bytes += sum(len(r[c]) for c in ("docs", "at", "h"))
    assert got == {(doc, at, h & 0xFFFFFFFF) for doc, at, h in want}
    assert n_bytes < 8 * len(want)


def test_hashes_of_sides_are_those_of_their_bytes():
    x = np.frombuffer(random.Random(3).randbytes(3000), np.uint8)
    h, at = S.sides(x)
    plain = S._mix(S._grams(x, S.SIDE, S.P))
    for value, place in zip(h, at.tolist()):
        assert value == (S._mix(plain[place // 2 - S.NEAR : place // 2 - S.NEAR + 1] + S.Q)[0] if place % 2 else plain[place // 2])


def test_anchor_is_the_leftmost_least_string_of_its_window():
    x = np.frombuffer(b"".join(random.Random(4).choices([b"ab", b"abab", b"c", b"dd"], k=400)), np.uint8)
    at, _, first, last = S.anchors(x)
    h = (S._mix(S._grams(x, S.GRAM, S.P)) >> np.uint64(32)).tolist()
    want = [i + min(range(S.SPAN), key=lambda k: (h[i + k], k)) for i in range(len(x) - S.SIZE + 1)]
    assert want == [a for a, i, j in zip(at.tolist(), first.tolist(), last.tolist()) for _ in range(i, j + 1)]
