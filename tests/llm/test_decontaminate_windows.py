"""Windows of all sizes in one pass, sieved by the benchmark's hashes, against windows made one by one."""

import random
import unicodedata

import numpy as np
import pyarrow as pa

from corpusops.llm import decontaminate as D


def test_windows_of_sizes_share_their_hashes_and_the_sieve_loses_none():
    roll = random.Random(4)
    words = ["the", "river", "Anna", "bend.", "12.5", "km", "(old)", "--", "stone", "falls", "of", "a", "b", "grün"]
    texts = pa.array([None, "", *(" ".join(roll.choices(words, k=n)) for n in range(40))])
    every = {s: (at.tolist(), row.tolist(), place.tolist(), h, h2, [slots(i) for i in at.tolist()]) for s, at, row, place, h, h2, slots in D.windows_of(texts, (8, -8, 5, -6))}
    assert set(every) == {8, 5, -8, -6}
    for size in (8, 5, -8, -6):
        (alone,) = D.windows_of(texts, (size,))
        assert alone[1].tolist() == every[size][0] and (alone[4] == every[size][3]).all() and (alone[5] == every[size][4]).all()
        keep = np.unique(roll.sample(every[size][3].tolist(), 9))
        (found,) = D.windows_of(texts, (size,), keep, D._sieve(keep))
        want = [k for k, h in enumerate(every[size][3].tolist()) if h in set(keep.tolist())]
        assert [*zip(*(c.tolist() for c in found[1:4]))] == [(every[size][0][k], every[size][1][k], every[size][2][k]) for k in want]
        assert [found[6](i) for i in found[1].tolist()] == [every[size][5][k] for k in want]


def slow_word(raw):
    end = raw.rstrip("\"')]}").endswith((".", "!", "?"))
    core = raw.strip("\"'()[]{}<>.,;:!?*#&|_~`")
    core = "".join(c for c in core if not unicodedata.category(c).startswith("P")) if not D.NUMBER.fullmatch(core) else core
    if not any(map(str.isalnum, core)):
        return "", 0, end
    if D.NUMBER.fullmatch(core):
        return core, 2, end
    plain = core.lower()
    if plain in D.UNITS:
        return plain, 3, end
    return plain, 4 if core[:1].isupper() and core[1:].islower() else 1, end


def test_words_of_letters_take_the_short_way_to_the_same_form():
    roll = random.Random(8)
    for _ in range(30000):
        raw = "".join(roll.choices("aAbZé.!?,'\")-_/$5٣ʼ一々ⅷ²", k=roll.randint(1, 6)))
        assert D._word(raw) == slow_word(raw), raw
    for raw in ("km", "Km", "km.", "(KM)", "Anna", "ANNA", "x²", "٣", "Ǆ", "ß"):
        assert D._word(raw) == slow_word(raw), raw
