"""Copies of benchmark items whose windows repeat, that stand twice, or that have few plain words."""

import pytest

pytest.importorskip("corpusops.llm")
from corpusops.llm import decontaminate  # noqa: E402

APPLES = "Tom has 3 red apples in the big box. Ann has 5 red apples in the big box."
TRAIN = "A train leaves here at 9 with 120 passengers and 30 of them get off after 45 minutes on the way to the old town"
BARE = "Alice Bob 12 kg 15 kg 7 cm Carol Dave 99"


def test_each_occurrence_is_judged(spark):
    other = TRAIN.replace("120", "95").replace("30", "12").replace("45", "20").replace(" 9 ", " 8 ")
    third = TRAIN.replace("120", "70").replace("30", "11").replace("45", "25").replace(" 9 ", " 7 ")
    texts = {1: f"Before that. {APPLES} After that.", 2: f"{TRAIN}. Then something else comes. {other}.", 3: f"{other}. Then something else comes. {third}.", 4: f"we saw {BARE} there", 5: "we saw " + BARE.replace("12", "13") + " there", 6: "nothing of the kind"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    items = spark.createDataFrame([(1, APPLES), (2, TRAIN), (3, BARE)], "id long, text string")
    want = [(1, 1), (2, 2), (3, 2), (4, 3)]
    for limit in (decontaminate.LIMIT, 1):
        assert sorted((r["id"], r["item_id"]) for r in decontaminate.contaminated(docs, items, limit).collect()) == want


def templated(text):
    """(template word, plain form) of each word that counts."""
    out, begins = [], True
    for raw in (text or "").split():
        plain, kind, end = decontaminate._word(raw)
        if kind:
            kind = 1 if kind == 4 and begins else kind
            out.append(({2: decontaminate.NUM, 3: decontaminate.UNIT, 4: decontaminate.NAME}.get(kind, plain), plain))
        begins = end if kind or end else False
    return out


def windows(words, size):
    rows = [(i, words[i : i + size]) for i in range(len(words) - size + 1)]
    kinds = (decontaminate.NUM, decontaminate.UNIT, decontaminate.NAME)
    return [(i, tuple(t for t, _ in w), [p for t, p in w if t in kinds]) for i, w in rows if sum(t not in kinds for t, _ in w) >= min(decontaminate.PLAIN, size)]


def holds(doc, item):
    """The rule of the module's docstring for one document and one item, over all their pairs of windows."""
    d, i = templated(doc), templated(item)
    if len(i) < decontaminate.SHORTEST:
        return False
    size = min(decontaminate.WINDOW, len(i))
    counted = windows(i, size)
    if not counted:
        plain = [p for _, p in i]
        return any([p for _, p in d[k : k + len(i)]] == plain for k in range(len(d) - len(i) + 1))
    length, total = max(k for k, *_ in counted) + decontaminate.WINDOW, len({key for _, key, _ in counted})
    groups = {}
    for a, key, got in windows(d, size):
        for b, other, want in counted:
            if key == other:
                offset = a - b
                for part in ((0, 0), (1, offset), (2, offset // length), (3, int((offset / length + 0.5) // 1))):
                    keys, values = groups.setdefault(part, (set(), {}))
                    keys.add(key)
                    for w, g in zip(want, got):
                        values.setdefault(w, set()).add(g)
    return any((len(keys) >= decontaminate.SHARE * total or len(keys) >= decontaminate.ENOUGH) and 2 * sum(len(v) == 1 for v in values.values()) >= len(values) for keys, values in groups.values())


def test_against_brute_force(spark):
    import random

    random.seed(31)
    words = "the train leaves station with red boxes near old river town and goes back again Paris Rome Ann Bob kg km 3 5 12 40".split()
    text = lambda n: " ".join(random.choice(words) + random.choice(["", "", "", ".", ","]) for _ in range(n))
    items = {i: text(n) for i, n in enumerate([4, 5, 6, 7, 8, 9, 12, 20, 30, 30])}
    items[10], items[11] = None, "Ann Bob 3 kg 5 km 12 40 kg"
    change = lambda t, share: " ".join(random.choice(words) if random.random() < share else w for w in t.split())
    docs = {}
    for k in range(90):
        item = random.choice([v for v in items.values() if v])
        docs[k] = f"{text(random.randint(0, 25))} {change(item, random.choice([0, 0, 0.1, 0.3]))} {text(random.randint(0, 25))}"
    docs |= {100: None, 101: "", 102: items[9] + " " + items[9], 103: "?! ... --"}
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], "id long, text string, item_id string, h int")
    it = spark.createDataFrame([(i, t, 2) for i, t in items.items()] + [(9, items[9], 3)], "id long, text string, at int")
    got = {(r["id"], r["item_id"]) for r in decontaminate.contaminated(d, it).collect()}
    assert got == {(a, b) for a, t in docs.items() for b, u in items.items() if holds(t, u)} and len(got) > 20
    assert decontaminate.contaminated(d.filter("id < 0"), it).count() == 0
