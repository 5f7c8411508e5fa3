import hashlib
import random
from collections import Counter

import pytest

from rasterloom.llm import substring
from rasterloom.llm.substring import SuffixAutomaton, remove_repeats, substring_dedup


def brute(rows, w=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for (d, _), x in zip(rows, words):
        gone = {i + j for i in range(len(x) - w + 1) if seen[tuple(x[i : i + w])] > 1 for j in range(w)}
        kept = b" ".join(v for i, v in enumerate(x) if i not in gone)
        out.append((d, len(x), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, vocabulary, n=60):
    rng = random.Random(seed)
    make = lambda k: rng.choices(vocabulary, k=k)
    passages = [make(rng.randint(30, 90)) for _ in range(6)]
    out = []
    for i in range(n):
        x = make(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "changed"
            x += p[rng.randint(0, 5) :] + make(rng.randint(0, 20))
        out.append((rng.choice([i, i, i // 2]), " \t".join(x)))
    return out


def mirrored(n):
    """Two words, letter by letter each other's opposite, which sums of powers modulo 2**64 don't tell apart."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


CASES = {
    "empty table": [],
    "mirrored": [(i, " ".join(f"w{j}" for j in range(34)) + " " + x) for i, x in enumerate(mirrored(1024))] + [(9 + i, " ".join(x)) for i, x in enumerate(mirrored(1024))],
    "one row many times": [(1, " ".join(f"w{i % 90}" for i in range(200)))] * 150 + [(None, " ".join(f"w{i}" for i in range(20, 80)))] * 150,
    "small": [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "a " * 34), (5, "b " * 35), (6, "c " * 36), (7, "ab " * 200)],
    "repeats": [(1, " ".join(f"w{i}" for i in range(80)))] * 2 + [(None, " ".join(f"w{i}" for i in range(20, 60)))] * 2 + [(1, "x y")],
    "very long": [(1, " ".join(f"w{i}" for i in range(40_000))), (2, " ".join(f"w{i}" for i in range(39_000, 40_500))), (3, "z" * 2_000_000)],
    "words": corpus(1, [f"v{i}" for i in range(3000)]),
    "few words": corpus(2, ["a", "b"]),
    "hot passage": [(i, f"s{i} " + " ".join(f"h{j}" for j in range(50)) + f" e{i} e{i % 7}") for i in range(400)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("most", [256, 3])
def test_equals_brute_force(docs, monkeypatch, case, most):
    monkeypatch.setattr(substring, "AUTOMATON", most)
    assert sorted((tuple(r) for r in substring_dedup(docs(CASES[case])).collect()), key=str) == brute(CASES[case])


def test_texts(docs):
    rows = CASES["words"]
    got = sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in remove_repeats(docs(rows)).collect())
    assert got == sorted((d, h) for d, _, _, h in brute(rows))


@pytest.mark.parametrize("seed", range(5))
def test_automaton(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ab" if seed % 2 else "abc", k=rng.randint(0, 25))) for _ in range(6)]
    copies = [rng.randint(1, 3) for _ in texts]
    a = SuffixAutomaton()
    for t, n in zip(texts, copies):
        a.add(list(t), n)
    a.finish()
    times = lambda f: sum(n for t, n in zip(texts, copies) for i in range(len(t)) if t.startswith(f, i))
    ask = "".join(rng.choices("abcd", k=40))
    for most in (1, 3, 99):
        for i, (length, n) in enumerate(a.statistics(list(ask), most)):
            best = next(k for k in range(min(most, i + 1), -1, -1) if k == 0 or times(ask[i - k + 1 : i + 1]))
            assert length == best and (best == 0 or n == times(ask[i - best + 1 : i + 1]))
