"""Hot passages in suffix dedup: what several documents of a batch share goes to the shards once."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("corpusops.llm")

from corpusops.llm import suffix_dedup as S  # noqa: E402


def brute(rows):
    """Per text: bytes covered by 50-byte strings that start in a smaller document."""
    first = {}
    for doc, text in rows:
        x = text.encode()
        for i in range(len(x) - 49):
            s = x[i : i + 50]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in rows:
        x = text.encode()
        gone = [False] * len(x)
        for i in range(len(x) - 49):
            if first[x[i : i + 50]] < doc:
                gone[i : i + 50] = [True] * 50
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("tasks", [1, 7])
def test_hot_passages(spark, tasks):
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(2, 9)))
    passages = [" ".join(word() for _ in range(20)) for _ in range(4)]
    rows = []
    for i in range(240):
        parts = [" ".join(word() for _ in range(random.randint(0, 12)))]
        for _ in range(random.randint(0, 3)):
            p = random.choice(passages)
            a = random.randint(0, 30)
            parts += [random.choice([p, p[a:], p[: len(p) - a], p + p]), word()]
        rows.append((i // 2 if i % 40 == 1 else i, " ".join(parts)))  # some ids repeat
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in S.dedup(d).collect())
    assert got == brute(rows)


def test_known_places():
    h = np.array([1, 1, 1, 1, 2, 2, 3, 4, 4, 4], np.uint64)
    docs = np.array([5, 5, 6, 9, 7, 7, 1, 1, 2, 3], np.int64)
    assert S._known(h, docs).tolist() == [False, True, True, False, False, False, False, False, True, False]


def test_one_document_of_a_batch_goes_to_the_shard():
    """Of 400 documents with a passage, the hash's shard gets two places, and the passage's shard one document."""
    passage = np.random.default_rng(1).integers(97, 123, 120).astype(np.uint8).tobytes()
    texts = [b"%05d" % i + passage for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "zipped": [S._pack(t) for t in texts]})
    dealt = [r for b in S._deal(8)([batch]) for r in b.to_pylist()]
    at = S.sides(np.frombuffer(texts[0], np.uint8))[0]
    own = sum(len(S._unpack(r["docs"], np.int64)) for r in dealt if r["h"] is not None)
    assert own < 6 * len(at) + 400 * 3  # places near the numbers differ from text to text
    wanted = [[S.sides(np.frombuffer(t, np.uint8))[1].astype(np.int32).tobytes()] for t in texts]
    around = [r for b in S._surroundings(8)([batch.append_column("some", pa.array(wanted))]) for r in b.to_pylist()]
    members = sum(len(S._unpack(r["docs"], np.int64)) for r in around if r["h"] is not None)
    lost = sum(len(S._unpack(r["docs"], np.int64)) for r in around if r["h"] is None)
    assert lost > 400 and members < lost
