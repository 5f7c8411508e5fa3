import hashlib
import re
from collections import defaultdict

import pytest

from rasterloom.llm.exact import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[ \t-\r]", "", t or "")].append((i, t))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))
        out += [(i, best[0], len(members), hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


CASES = {
    "empty table": [],
    "nulls and blanks": [(1, None), (2, ""), (3, " \t\n"), (None, "a b"), (5, "ab"), (6, "a b"), (None, None)],
    "ties and repeats": [(3, "x y"), (1, "xy"), (2, "x y"), (2, "x y"), (4, "y x"), (4, "y x")],
    "very long": [(1, "ab " * 400_000), (2, "ab" * 400_000), (3, "ab" * 400_000 + "c")],
    "code points": [(1, "\U0001f600\U0001f600"), (2, "\U0001f600 \U0001f600"), (3, "é"), (4, "é")],
    "one hot text": [(i, "the same" + " " * (i % 3)) for i in range(3000)] + [(i, f"other {i}") for i in range(3000, 3500)],
}


@pytest.mark.parametrize("case", CASES)
def test_equals_brute_force(docs, case):
    got = exact_dedup(docs(CASES[case])).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(CASES[case])
    kept = defaultdict(int)
    for r in got:
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) <= {1}


def test_carries_rows(docs):
    df = docs([(1, "a b"), (2, "ab"), (3, None)])
    kept = exact_dedup(df, carry=True).where("kept").select("row.*")
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
