"""The pipeline's stages against brute force on a small table with nulls, repeats, ties and clashing names."""

import random

import pytest

pytest.importorskip("corpusops.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from corpusops.llm import language_id, line_dedup, simhash  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, gone string, _p int"
random.seed(21)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "web", len(t or ""), "s", "g", 1) for i, t, lang in rows], KIND)


def ids(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in df.collect())


def test_language(spark):
    rows = [(i, f"the and of {i}" if i % 2 else f"und der das {i}", "en" if i % 2 else "de") for i in range(60)] + [(90, None, "en"), (91, "", "en"), (92, "12 34", None), (None, "the of and", None), (3, "the and of 3", "en")]
    d = table(spark, rows)
    out = corpus_pipeline.identify(spark, d, "")
    assert out.columns == d.columns and ids(out) == sorted([*range(60), 3, -1])
    assert corpus_pipeline.identify(spark, d.filter("doc_id < 0"), "").count() == 0


def test_lines(spark):
    long = prose(40)
    rows = [(1, f"{long}\nonly here one", "en"), (2, f"{long[:-3]}xyz\nonly here two", "en"), (3, "Only here ONE ", "en"), (4, None, None), (5, "", None), (None, "no id here\nonly here two", None), (7, "twice in a row\ntwice in a row", "en")]
    d = table(spark, rows)
    out = corpus_pipeline.drop_lines(spark, d, "")
    assert out.columns == d.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    want = {1: rows[0][1], 2: "only here two", None: "no id here", 7: "twice in a row"}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert corpus_pipeline.drop_lines(spark, d.filter("doc_id < 0"), "").count() == 0


def test_copies_against_brute_force(spark):
    base = [prose(150) for _ in range(12)]
    rows = []
    for k, text in enumerate(base):
        words = text.split()
        rows.append((10 * k, text, "en"))
        for j, share in enumerate((0.01, 0.02, 0.3)):  # words replaced; similarity about 0.9, 0.82 and below 0.2
            changed = [random.choice(WORDS) if random.random() < share else w for w in words]
            rows.append((10 * k + j + 1, " ".join(changed), "en"))
    rows += [(500, base[0], "en"), (501, "A b c", "en"), (502, "a B c", "en"), (503, "a b d", "en"), (None, base[0], "en")]
    random.shuffle(rows)
    d = table(spark, rows)
    known = [(i, t) for i, t, _ in rows if i is not None]
    least = {i: i for i, _ in known}
    for _ in range(4):
        for i, t in known:
            for j, u in known:
                if simhash.jaccard(t, u) >= 0.8:
                    least[i] = least[j] = min(least[i], least[j])
    out = corpus_pipeline.drop_copies(spark, d, "")
    want = {i for i in least if least[i] == i} | {-1}
    got = ids(out)
    assert out.columns == d.columns and want <= set(got)  # nothing goes that has no copy
    found = (len(known) + 1 - len(got)) / (len(known) + 1 - len(want))
    assert found >= 0.9
    assert corpus_pipeline.drop_copies(spark, d.filter("doc_id < 0"), "").count() == 0


def test_benchmark_and_tokens(spark, tmp_path):
    item = "A train leaves Paris at 9 with 120 passengers and 30 of them get off after 45 minutes on the way to the old town"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"See here. {item} And so on.", "en"), (2, item.replace("Paris", "Rome").replace("120", "95"), "en"), (3, prose(50), "en"), (4, None, None), (None, item, "en"), (3, prose(9), "en")]
    d = table(spark, rows)
    out = corpus_pipeline.drop_benchmark(spark, d, str(tmp_path))
    assert out.columns == d.columns and ids(out) == [3, 3, 4]
    assert corpus_pipeline.drop_benchmark(spark, d.filter("doc_id < 0"), str(tmp_path)).count() == 0
    last = corpus_pipeline.tokenize(spark, d, str(tmp_path))
    assert ids(last) == [-1, 1, 2, 3, 3, 4] and corpus_pipeline.tokenize(spark, d.filter("doc_id < 0"), "").count() == 0


def test_recall_of_near_pairs(spark):
    """Planted pairs of similarity 0.8 to 0.9: at least nine in ten meet in a table."""
    rows, n = [], 0
    for k in range(150):
        words = prose(200).split()
        twin = list(words)
        while simhash.jaccard(" ".join(words), " ".join(twin)) > 0.88:
            twin[random.randrange(200)] = "x" + random.choice(WORDS)
        if simhash.jaccard(" ".join(words), " ".join(twin)) >= 0.8:
            rows += [(2 * k, " ".join(words), "en"), (2 * k + 1, " ".join(twin), "en")]
            n += 1
    gone = {r["doc_id"] for r in simhash.near_copies(table(spark, rows)).collect()}
    assert gone <= {2 * k + 1 for k in range(150)} and len(gone) >= 0.9 * n


def test_recall_of_lines(spark):
    rows, n = [], 0
    for k in range(150):
        line = prose(random.choice([8, 30, 110]))
        twin = list(line)
        while line_dedup_similarity(line, "".join(twin)) > 0.84:
            twin[random.randrange(len(twin))] = "z"
        if line_dedup_similarity(line, "".join(twin)) >= 0.8:
            rows += [(2 * k, line, "en"), (2 * k + 1, "".join(twin), "en")]
            n += 1
    got = {r["doc_id"]: r["kept_doc_id"] for r in line_dedup.removed_lines(table(spark, rows)).collect()}
    assert all(k == i - 1 for i, k in got.items()) and len(got) >= 0.9 * n


def line_dedup_similarity(x, y):
    a, b = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (x, y))
    return len(a & b) / len(a | b)


def test_stages_are_named():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"] and language_id.UND == "und"
