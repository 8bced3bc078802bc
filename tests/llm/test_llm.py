"""Operators over text against brute force and on edge rows."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpusops.llm")
import public_tokenizers  # noqa: E402

from corpusops.llm import byte_bpe, chat_format, decontaminate, language_id, license_scan, line_dedup, simhash, suffix_dedup, token_counts, topk_search  # noqa: E402
from corpusops.llm.common import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, zipped int"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, None, None, 1) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


EDGE = [None, "", " ", "a", "it's  the\n\n 12 dogs!!", "é" * 300, "ab" * 400, " x y \u0085z", "the the the", "the the the", "x" + " " * 700 + "y", "日本語 テキスト 🙂🙂"]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))


def test_bpe_is_that_of_tiktoken(spark, ranks):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = public_tokenizers.path(byte_bpe.RANKS)
    d = docs(spark, EDGE)
    ids = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(d, path).collect()}
    assert ids == {i: enc.encode_ordinary(t or "") for i, t in enumerate(EDGE)}
    back = {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode(byte_bpe.encode(d, path), path).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(EDGE)}
    for r in byte_bpe.round_trip(d, path).collect():
        assert r["n_tokens"] == len(ids[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256((EDGE[r["doc_id"]] or "").encode()).hexdigest()
    assert byte_bpe.encode(docs(spark, EDGE).filter("doc_id < 0"), path).count() == 0


def test_long_words_merge_as_short_ones(ranks):
    v = byte_bpe.vocabulary(public_tokenizers.path(byte_bpe.RANKS))
    random.seed(1)
    for _ in range(50):
        word = "".join(random.choice("abetion ") for _ in range(random.randint(1, 200))).encode()
        import numpy as np

        ids, _ = v.encode(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        assert ids.tolist() == v.merge_long(word)


def test_token_counts(spark, ranks):
    import math

    cost = {w: round(1e6 * math.log(r + 2)) for w, r in ranks.items()}

    def brute(word: bytes) -> int:
        best = [(0, 0)]
        for j in range(1, len(word) + 1):
            best.append(min((best[i][0] + cost[word[i:j]], best[i][1] + 1) for i in range(j) if word[i:j] in cost))
        return best[-1][1]

    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs(spark, EDGE), public_tokenizers.path(byte_bpe.RANKS)).collect()}
    assert got == {i: sum(brute(w.encode()) for w in pattern.findall(t or "")) for i, t in enumerate(EDGE)}


ITEM = "A train leaves Paris at 9 with 120 passengers and 30 of them get off after 45 minutes on the way to the old town"


def test_decontaminate(spark):
    again = ITEM.replace("Paris", "Rome").replace("120", "95").replace("45", "20")
    d = spark.createDataFrame([(1, f"Some words first. {ITEM}. And after."), (2, again), (3, "nothing of the kind is said in this text at all"), (4, None), (5, "")], "id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short")], "id long, text string")
    assert sorted((r["id"], r["item_id"]) for r in decontaminate.contaminated(d, items).collect()) == [(1, 7), (2, 7)]
    assert sorted((r["id"], r["item_id"]) for r in decontaminate.contaminated(d, items, limit=1).collect()) == [(1, 7), (2, 7)]
    assert decontaminate.contaminated(d, items.filter("id < 0")).count() == 0


def test_decontaminate_wants_consistent_slots(spark):
    item = "we counted 3 birds and then 3 fish near 3 boats while 5 men and 5 boys sang about 5 ships on the sea"
    numbers = iter(range(10, 99))
    mixed = re.sub(r"\d", lambda m: str(next(numbers)), item)
    d = spark.createDataFrame([(1, mixed), (2, item.replace("3", "8"))], "id long, text string")
    items = spark.createDataFrame([(1, item)], "id long, text string")
    assert [r["id"] for r in decontaminate.contaminated(d, items).collect()] == [2]


def brute_suffix(rows):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark):
    random.seed(2)
    words = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 7))) for _ in range(30)]
    base = [" ".join(random.choice(words) for _ in range(80)) for _ in range(12)]
    texts = base + [base[0], base[1][20:300] + base[2][10:200], "z" * 49, "z" * 120, "z" * 130, None, "", base[3][:50], base[3][:49]]
    rows = list(enumerate(texts))
    random.shuffle(rows)
    d = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.dedup(d).collect()}
    assert got == brute_suffix(rows)
    assert suffix_dedup.dedup(d.filter("doc_id < 0")).count() == 0


def brute_bayes(rows, held):
    """Predictions by plain naive Bayes with counts smoothed by one half, over rows (id, text, lang)."""
    import math
    from collections import Counter

    learn = [(t, lang) for i, t, lang in rows if i not in held and t is not None and lang is not None]
    langs = sorted({x for _, x in learn})
    counts = {x: Counter() for x in langs}
    for t, lang in learn:
        counts[lang].update(language_id.buckets(t).tolist())
    size = 1 << language_id.BITS
    totals = {x: sum(counts[x].values()) + size / 2 for x in langs}
    out = {}
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            out[i] = ("und", 0.0)
            continue
        logs = {x: math.log(sum(y == x for _, y in learn) / len(learn)) + sum(math.log((counts[x][b] + 0.5) / totals[x]) for b in language_id.buckets(t).tolist()) for x in langs}
        best = max(langs, key=lambda x: logs[x])
        out[i] = (best, 1 / sum(math.exp(v - logs[best]) for v in logs.values()))
    return out


@pytest.mark.parametrize("block", [250, 1])
def test_language_id_is_naive_bayes(spark, block):
    random.seed(11)
    kinds = {"en": "the of and to in a is that", "de": "der die und das nicht ein ist", "fr": "le la et les des un est que"}
    rows = [(i, " ".join(random.choice(v.split()) for _ in range(random.randint(1, 6))), k) for i, (k, v) in enumerate(itertools.islice(itertools.cycle(kinds.items()), 60))]
    rows += [(100, None, "en"), (101, "", None), (102, "12 !!", "de"), (103, "the und le", None), (104, "the und le", None), (105, rows[0][1], "xx")]
    d = spark.createDataFrame([(*r, 7, "own") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string").repartition(3)
    held = {r[0] for r in d.filter(language_id.held_out()).select("doc_id").collect()}
    model = language_id.train(d.filter(~language_id.held_out()), block)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(d, model).collect()}
    want = brute_bayes(rows, held)
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()}
    assert all(abs(got[i][1] - s) < 1e-4 for i, (_, s) in want.items())
    assert language_id.predict(d.filter("doc_id < 0"), model).count() == 0
    none = language_id.train(d.filter("doc_id < 0"))
    assert {r["lang_pred"] for r in language_id.predict(d, none).collect()} == {"und"}


def test_language_counts_do_not_hang_on_layout(spark, monkeypatch):
    """Equal for any layout, and for very long texts cut into pieces."""
    import numpy as np

    random.seed(12)
    texts = ["".join(random.choice("abcÀß. ") for _ in range(random.randint(0, 90))) for _ in range(40)]
    want = np.bincount(np.concatenate([language_id.buckets(t) for t in texts]), minlength=1 << language_id.BITS)
    import pyarrow as pa

    for chunk, together in ((1 << 20, 1 << 16), (1 << 20, 100), (7, 30)):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        monkeypatch.setattr(language_id, "TOGETHER", together)
        got = np.zeros_like(want)
        for out in language_id._count([pa.RecordBatch.from_pydict({"lang": ["x"] * len(part), "text": part}) for part in (texts[:5], texts[5:])]):
            np.add.at(got, out["bucket"].to_numpy(), out["n"].to_numpy())
        assert (got == want).all()
        assert (np.sort(np.concatenate([*language_id._pieces(texts[0] + "Z")])) == np.sort(language_id.buckets(texts[0] + "Z"))).all()


def test_texts_of_equal_fingerprints_are_verified(spark):
    """Forty times the same word hides what differs from the fingerprints; such texts are no copies."""
    random.seed(6)
    words = [f"w{i}" for i in range(500)]
    one, two = ("ha " * 40 + " ".join(random.sample(words, 20)) for _ in range(2))
    rows = [(1, one), (2, two), (3, one), (4, two.upper()), (5, one.replace("ha ha", "ha  ha")), (6, None), (7, "")]
    assert simhash.fingerprints_of(one, 5, 2) == simhash.fingerprints_of(two, 5, 2) and simhash.jaccard(one, two) < 0.8
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 1), (5, 1), (4, 2), (7, 6)}


def test_short_items_meet_whole_documents(spark):
    from corpusops.llm import decontaminate

    items = spark.createDataFrame([(1, "Who wrote Hamlet"), (2, "Solve x + 4 = 9"), (3, None), (4, "")], "id long, text string")
    docs_ = spark.createDataFrame([(10, "who wrote Hamlet?"), (11, "Solve x + 4 = 9"), (12, "Who wrote Hamlet and when"), (13, None), (14, " "), (15, "Solve x + 4 = 8")], "id long, text string")
    got = {(r["id"], r["item_id"]) for r in decontaminate.contaminated(docs_, items).collect()}
    assert got == {(10, 1), (11, 2)}


def test_top_k(spark):
    random.seed(3)
    rows = [(i, [random.choice([-0.25, 0.0, 0.5]) for _ in range(4)]) for i in range(300)] + [(300, None), (301, [None, 1.0, 1.0, 1.0]), (302, [float("nan")] * 4), (400, [0.5] * 4), (400, [0.5] * 4)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk_search.usable(d)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(v.filter("vec_id % 100 = 0"), v, 10).collect())
    known = [(i, [int(1024 * x) for x in e]) for i, e in rows if e and None not in e and e[0] == e[0]]
    want = []
    for q, x in [(i, e) for i, e in known if i % 100 == 0]:  # a row that repeats is a query of its own
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in known if i != q)[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want) and len(got) == 50
    assert topk_search.top_k(v.filter("vec_id < 0"), v, 10).count() == 0 and topk_search.top_k(v.filter("vec_id < 0"), v.filter("vec_id < 0"), 10).count() == 0


def test_simhash(spark):
    random.seed(4)
    base = " ".join(random.choice("red blue old new tree road sea".split()) + str(random.randint(0, 9)) for _ in range(300))
    texts = [base, base + " end", base, None, "", "A b", "a B", base.replace("tree1", "tree2")]
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.groups(docs(spark, texts)).collect()}
    fp = {i: simhash.fingerprint(t) & (2**64 - 1) for i, t in enumerate(texts)}
    assert {i: f & (2**64 - 1) for i, (f, _) in got.items()} == fp and fp[3] == fp[4] == 0 and fp[5] == fp[6]
    least = {i: i for i in fp}
    for _ in fp:
        for a, b in itertools.product(fp, fp):
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                least[a] = least[b] = min(least[a], least[b])
    assert {i: c for i, (_, c) in got.items()} == least


def test_simhash_links_find_every_pair(spark):
    random.seed(5)
    base = random.getrandbits(63)
    values = sorted({base} | {base ^ sum(1 << k for k in random.sample(range(63), random.randint(1, 4))) for _ in range(60)})
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in values], "fp long")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 3}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_line_dedup(spark):
    random.seed(6)
    long = " ".join("".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    near = long[:-5] + "xxxxx"
    texts = [f"first\n{long}\nalone in this text only", f"{near}\nsecond line that nobody else has", long.upper(), None, "", "short\nshort"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "second line that nobody else has", 2: "", 3: None, 4: "", 5: "short\nshort"}
    assert line_dedup.removed_lines(docs(spark, texts).filter("doc_id < 0")).count() == 0


def test_chat_trees(spark):
    rows = [(1, 1, None, "user", "a<b&c", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "</turn>\n&lt;", 0.9), (1, 4, 3, None, None, None), (2, 9, 5, "user", "orphan", 0.0)]
    m = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    out = chat_format.format_paths(m, chat_format.chosen_paths(m))
    got = {r["tree"]: [tuple(x) for x in r["t"]] for r in out.select("tree", chat_format.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("user", "a<b&c"), ("assistant", "</turn>\n&lt;"), ("", "")], 2: [("user", "orphan")]}
    both = chat_format.chosen_paths(m, best=5).groupBy("tree", "leaf").count().collect()
    assert sorted((r["tree"], r["leaf"], r["count"]) for r in both) == [(1, 2, 2), (1, 4, 3), (2, 9, 1)]
    assert chat_format.chosen_paths(m.filter("tree < 0")).count() == 0


def test_chat_rings(spark):
    rows = [(1, 1, 3, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 0.0), (1, 3, 2, "user", "c", 0.0), (1, 4, 3, "assistant", "d", 0.0), (1, 5, 5, "user", "self", 0.0), (2, 1, None, "user", "x", 0.0)]
    m = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    assert sorted((r["tree"], r["id"]) for r in chat_format.ring_heads(m).collect()) == [(1, 1), (1, 5)]
    got = sorted((r["tree"], r["leaf"], r["id"], r["depth"]) for r in chat_format.chosen_paths(m).collect())
    assert got == [(1, 4, 1, 1), (1, 4, 2, 2), (1, 4, 3, 3), (1, 4, 4, 4), (1, 5, 5, 1), (2, 1, 1, 1)]


def brute_licenses(text, threshold=license_scan.THRESHOLD):
    """Every span of every place, one template after the other."""
    words, best = license_scan.words_of(text or ""), {}
    pairs = [" ".join(p) for p in zip(words, words[1:])]
    for name, body in sorted(license_scan.TEMPLATES.items()):
        t = license_scan.words_of(body)
        grams, n = {" ".join(p) for p in zip(t, t[1:])}, len(t)
        for start in range(max(0, len(words) - n) + 1):
            own = set(pairs[start : start + n - 1])
            shared = len(own & grams)
            dice = 2 * shared / (len(own) + len(grams))
            if dice >= threshold:
                best[name] = min(best.get(name, (0, 0, 0, 0)), (-dice, start, n, shared))
    over = lambda x, y: x[1] < y[1] + y[2] and y[1] < x[1] + x[2]
    return {(k, x[1], x[2], round(-x[0], 6)) for k, x in best.items() if not any(over(x, y) and (-y[3], y[0], j) < (-x[3], x[0], k) for j, y in best.items())}


def test_licenses_with_words_inserted(spark):
    """Words inserted anywhere, before every anchor too: each span counts as brute force has it."""
    random.seed(10)
    texts = []
    for name in ("mpl-2.0-header", "mit-text", "apache-2.0-header", "gpl-3.0-header"):
        for k in (2, 4, 8, 12):
            words = license_scan.TEMPLATES[name].split()
            for _ in range(k):
                words.insert(random.randrange(len(words)), random.choice(["alpha", "beta", "gamma"]))
            texts.append("some code here " * random.randint(0, 30) + " ".join(words) + " and more code" * random.randint(0, 30))
    head = license_scan.TEMPLATES["apache-2.0-header"].split()
    texts.append(" ".join(head[:5] + ["one", "two"] + head[5:30] + ["three", "four"] + head[30:]))
    texts.append(license_scan.MIT + " x" * 20_000 + " " + license_scan.TEMPLATES["mpl-2.0-header"])
    got: dict = {i: set() for i in range(len(texts))}
    for r in license_scan.scan(docs(spark, texts)).collect():
        got[r["doc_id"]].add((r["license"], r["start"], r["n_words"], r["dice"]))
    assert got == {i: brute_licenses(t) for i, t in enumerate(texts)}
    assert [x[0] for x in got[16]] == ["apache-2.0-header"]
    assert sum(bool(v) for v in got.values()) > 12


def test_any_number_of_license_templates(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "SMALL", 10)
    monkeypatch.setattr(license_scan, "MANY", 10)
    many = {f"t{i}": f"notice number {i} of the software a{i} b{i} c{i}" for i in range(300)}
    rows = docs(spark, ["see notice number 7 of the software a7 b7 c7 here", None, "", many["t299"], many["t299"]], [5, None, 6, None, 5])
    got = sorted((r["doc_id"] or 0, r["license"], r["start"], r["dice"]) for r in license_scan.scan(rows, many).collect())
    assert got == [(0, "t299", 0, 1.0), (5, "t299", 0, 1.0), (5, "t7", 1, 1.0)]


def test_license_scan(spark):
    mit = license_scan.MIT.split()
    wrapped = "\n".join(" ".join(mit[i : i + 7]) for i in range(0, len(mit), 7))
    altered = license_scan.MIT.replace("free of charge", "without any fee").replace("AUTHORS", "WRITERS")
    texts = [
        "x\nLICENSED under the  apache license version 2 0", None, "", "mit", "Released under the MIT License.\nReleased under the MIT License.",
        "This work is licensed under the GNU General Public License, version 2.", f"Copyright 2024 Somebody.\n\n{wrapped}\nint main() {{}}", f"// {altered}", "We say here: this program was released under the MIT license. And so on.",
        "Copyright 2024 X. All rights reserved.", license_scan.TEMPLATES["gpl-3.0-header"] + " Then " + license_scan.TEMPLATES["bsd-3-clause-text"], "license software warranty " * 40, "This work is licenced under the GNU General Public License, version 3.",
    ]
    got: dict = {i: set() for i in range(len(texts))}
    for r in license_scan.scan(docs(spark, texts)).collect():
        got[r["doc_id"]].add((r["license"], r["start"], r["n_words"], r["dice"]))
    assert got == {i: brute_licenses(t) for i, t in enumerate(texts)}
    names = {i: sorted(x[0] for x in v) for i, v in got.items()}
    assert names == {0: ["apache-2.0"], 1: [], 2: [], 3: [], 4: ["mit"], 5: ["gpl-2.0"], 6: ["mit-text"], 7: ["mit-text"], 8: ["mit"], 9: ["all-rights-reserved"], 10: ["bsd-3-clause-text", "gpl-3.0-header"], 11: [], 12: ["gpl-3.0"]}
    assert license_scan.scan(docs(spark, texts).filter("doc_id < 0")).count() == 0


def test_long_words_count_alike(ranks):
    import numpy as np

    model = token_counts.unigram(public_tokenizers.path(byte_bpe.RANKS))
    random.seed(12)
    for _ in range(20):
        word = "".join(random.choice("abetionz") for _ in range(random.randint(1, 200))).encode()
        assert model.count(np.frombuffer(word, np.uint8), np.array([0, len(word)])).tolist() == [model.count_long(word)]


def test_texts_of_many_rows(spark, ranks, monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    from corpusops.llm import pretokens

    monkeypatch.setattr(pretokens, "ROW_WORDS", 3)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["one two three four five six seven eight", None, "a b c", "a b c d", "x" * 3000]
    for r in byte_bpe.round_trip(docs(spark, texts), public_tokenizers.path(byte_bpe.RANKS)).collect():
        t = texts[r["doc_id"]] or ""
        ids = enc.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    counts = {r["doc_id"]: r["n_pretokens"] for r in token_counts.count_tokens(docs(spark, texts), public_tokenizers.path(byte_bpe.RANKS)).collect()}
    assert counts == {0: 8, 1: 0, 2: 3, 3: 4, 4: 1}
