"""Order and common prefixes of suffixes against brute force, with queues that spill."""

import random

import pytest

pytest.importorskip("corpusops.llm")
import numpy as np  # noqa: E402

from corpusops.llm import induced_sort  # noqa: E402


@pytest.mark.parametrize("trial", range(60))
def test_suffixes(trial):
    random.seed(trial)
    letters = random.choice(["ab", "abc", "abcdefgh ", "aaab", "é日a"])
    pieces = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(random.randint(1, 12))]
    pieces += [random.choice(pieces) + "x", "a" * random.randint(1, 80)]
    t = np.concatenate([[b + 1 for b in p.encode()] + [0] for p in pieces]).astype(np.int16)
    cap = random.choice([5, 20, 50])
    head = [tuple(t[i : i + cap].tolist()) for i in range(len(t))]
    at, lcp = (np.concatenate(x).tolist() for x in zip(*induced_sort.sorted_suffixes(t, cap, memory=random.choice([0, 60, 1 << 20]))))
    assert sorted(x for x in at if t[x]) == np.flatnonzero(t).tolist()
    for k in range(1, len(at)):
        one, two = head[at[k - 1]], head[at[k]]
        same = next((i for i, (a, b) in enumerate(zip(one, two)) if a != b), min(len(one), len(two)))
        if 0 not in one[: same + 1] and 0 not in two[: same + 1]:  # the end of a piece orders nothing
            assert one >= two and lcp[k] == same
