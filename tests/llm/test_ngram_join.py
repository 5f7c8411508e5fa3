import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import ngram_join
from rasterloom.llm.components import components

from .test_substring import mirrored


def brute(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", low(t)) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    home = list(range(len(rows)))

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                home[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    line = " ".join(rng.choices(vocabulary, k=12))
    out = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w) + (f"\n{line}" if rng.random() < 0.5 else ""))
    rng.shuffle(out)
    return list(enumerate(out))


CASES = {
    "empty table": [],
    "small": [(5, None), (4, ""), (3, "  "), (9, "A b"), (2, "a  B"), (1, "a b c"), (None, "a b"), (7, "one two three four five"), (8, "ONE two three four\tfive"), (6, "É"), (0, "é")],
    "repeats": [(1, "a b c d e f g")] * 3 + [(2, "a b c d e f g h")],
    "very long": [(1, " ".join(f"w{i}" for i in range(60_000))), (2, " ".join(f"w{i}" for i in range(100, 60_000))), (3, "z" * 3_000_000)],
    "mirrored": [(i, x) for i, x in enumerate(mirrored(1024))] + [(9 + i, "a b c d " + x) for i, x in enumerate(mirrored(2048))],
    "chain": [(i, " ".join(f"c{j}" for j in range(i * 6, i * 6 + 60))) for i in range(30, 0, -1)],
    "random 1": corpus(1),
    "random 2": corpus(2),
}


@pytest.mark.parametrize("case", CASES)
def test_equals_brute_force(docs, case):
    got = ngram_join.jaccard_components(docs(CASES[case])).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(CASES[case])


@pytest.mark.parametrize("case", ["small", "repeats"])
def test_different_sets_with_one_hash(docs, monkeypatch, case):
    monkeypatch.setattr(ngram_join, "class_of", lambda x: np.uint64(7))
    got = ngram_join.jaccard_components(docs(CASES[case])).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(CASES[case])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcD"), max_size=20), st.lists(st.sampled_from("abcd"), max_size=20), st.integers(1, 5))
def test_overlap(x, y, k):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in ([a.lower() for a in x], y)]
    assert ngram_join.overlap(" ".join(x).encode(), " ".join(y).encode(), k) == (len(sets[0]), len(sets[1]), len(sets[0] & sets[1]))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    home = {}

    def find(i):
        while home.setdefault(i, i) != i:
            i = home[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        home[y] = x
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


def test_prefix_bound():
    for n in range(1, 200):
        for m in range(-(-75 * n // 100), n + 1):
            overlap = -(-75 * (n + m) // 175)
            assert ngram_join.in_common(n, m, 75) >= 1 or overlap > m
