import random
import re
from collections import Counter

import pytest

from rasterloom.llm.decontam import contaminated

ITEM = "item_id long, text string"


def shingles(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(rows, items):
    out = {}
    for d, t in rows:
        s = shingles(t)
        for j, it in items:
            q = shingles(it)
            m = len(q)
            for a in range(len(s) - m + 1 if m else 0):
                k = sum((Counter(s[a : a + m]) & Counter(q)).values())
                if k / (2 * m - k) >= 0.75:
                    out[d, j] = max(out.get((d, j), 0), k / (2 * m - k))
    return out


def corpus(seed):
    rng = random.Random(seed)
    v = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(v, k=rng.choice([3, 5, 6, 20, 40])))) for i in range(12)]
    rows = []
    for d in range(120):
        w = rng.choices(v, k=rng.randint(0, 80))
        if d % 3 == 0:
            p = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2)):
                p[rng.choice([0, -1, rng.randrange(len(p))])] = "edit"
            at = rng.randint(0, len(w))
            w[at:at] = p
        rows.append((d, rng.choice([" ", ", ", "\n"]).join(w).title()))
    return rows, items


CASES = {
    "empty tables": ([], []),
    "no items": ([(1, "a b c d e f")], []),
    "no documents": ([], [(1, "a b c d e f")]),
    "edges": ([(1, None), (2, ""), (3, "a b"), (None, "x one two three four five six y"), (5, "One, two; THREE four - five_six!"), (5, "One, two; THREE four - five_six!"), (6, "ab " * 60_000)], [(1, "one two three four five six"), (2, None), (3, ""), (None, "A b"), (4, "ab " * 9), (5, "one two three four five six")]),
    "random 1": corpus(1),
    "random 2": corpus(2),
}


@pytest.mark.parametrize("case", CASES)
def test_equals_brute_force(spark, docs, case):
    rows, items = CASES[case]
    got = contaminated(docs(rows), spark.createDataFrame(items, ITEM).selectExpr("*", "1 AS no", "2 AS m")).collect()
    want = brute(rows, items)
    assert len(got) == len(want) and {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in got} == want


def test_documents_shorter_than_an_item(spark, docs):
    """A document of fewer shingles than an item is compared as a whole: union n + m - common."""
    w = [f"w{i}" for i in range(59)]
    item, small = " ".join(w), " ".join(f"s{i}" for i in range(8))
    rows = [(k, " ".join(w[:-k])) for k in range(1, 20)] + [(50 + k, " ".join(w[k:])) for k in (1, 5, 13, 14)] + [(70, " ".join([*w[:30], "x", *w[31:57]])), (None, " ".join(w[2:-2])), (80, " ".join(f"s{i}" for i in range(7))), (81, "s0 s1 s2 s3 s4 s5")]
    items = [(1, item), (2, small), (3, " ".join(w[:50]))]
    want = {}
    for d, t in rows:
        for j, q in items:
            a, b = Counter(shingles(t)), Counter(shingles(q))
            n, m = a.total(), b.total()
            common = (a & b).total()
            if n < m and common / (n + m - common) >= 0.75:
                want[d, j] = (0, n, pytest.approx(common / (n + m - common)))
    want_longer = brute(rows, items)
    got = {(r["doc_id"], r["item_id"]): (r["start_shingle"], r["n_shingles"], r["similarity"]) for r in contaminated(docs(rows), spark.createDataFrame(items, ITEM)).collect()}
    assert want[5, 1][2] == 50 / 55 and (13, 1) in want and (14, 1) not in want and (70, 1) in want and (80, 2) in want
    assert {k: v for k, v in got.items() if k not in want_longer} == want and want.keys() | want_longer.keys() == got.keys()


def test_recall_at_the_threshold(spark, docs):
    """Passages that are just similar enough, whose fingerprints differ the most."""
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices([f"v{j}" for j in range(900)], k=rng.choice([30, 44, 60])))) for i in range(40)]
    rows = []
    for d in range(400):
        w = rng.choice(items)[1].split()
        for _ in range(50):
            x = list(w)
            for at in rng.sample(range(len(x)), rng.randint(1, 3)):
                x[at] = f"e{rng.randrange(99)}"
            t = " ".join(["b"] * rng.randint(0, 9) + x + ["a"] * rng.randint(0, 9))
            if any(0.75 <= v < 0.8 for v in brute([(d, t)], items).values()):
                rows.append((d, t))
                break
    want = brute(rows, items)
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs(rows), spark.createDataFrame(items, ITEM)).collect()}
    assert len(want) > 150 and got <= want.keys() and len(got) >= 0.99 * len(want)
