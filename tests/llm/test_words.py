import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import kneser_ney, words

TEXT = st.text(alphabet=st.sampled_from("aB é\t\n\x0b\x0c\r  \U0001f600"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.integers(1, 5), st.booleans())
def test_shingles_equal_python(texts, k, large):
    column = pa.array(texts, pa.large_string() if large else pa.string())
    split = [[x for x in re.split(r"[\x20\x09-\x0d]+", t or "") if x] for t in texts]
    h, rows = words.hashed_words(column)
    assert np.diff(rows).tolist() == [len(w) for w in split]
    flat = [x for w in split for x in w]
    assert len({(a, int(b)) for a, b in zip(flat, h)}) == len(set(flat)) == len(set(h.tolist()))
    s, row = words.shingles(h, rows, k)
    want = [(i, tuple(w[j : j + k])) for i, w in enumerate(split) for j in range(max(1, len(w) - k + 1) if w else 0)]
    assert row.tolist() == [i for i, _ in want]
    assert len(set(zip((x for _, x in want), s.tolist()))) == len({x for _, x in want}) == len(set(s.tolist()))


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_ngram_keys(texts):
    raw, offsets = words.buffers(pa.array(texts, pa.string()))
    got = kneser_ney.ngrams(raw, offsets)
    n = kneser_ney.ORDER
    pads = [bytes(n - 1) + bytes(0x20 if 9 <= b <= 13 else b for b in t.encode()) for t in texts]
    assert got.tolist() == [int.from_bytes(p[i : i + n], "big") for p in pads for i in range(len(p) - n + 1)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=8), st.integers(0, 3))
def test_long_words_and_their_place(lengths, before):
    """A word's hash depends on its bytes and the seed only, also where blocks end and beyond the longest one hashed by blocks."""
    column = pa.array([" " * before + " ".join("ab" * (n // 2) + "c" * (n % 2) for n in lengths)])
    alone = [words.hashed_words(pa.array(["ab" * (n // 2) + "c" * (n % 2)]))[0][0] for n in lengths]
    assert words.hashed_words(column)[0].tolist() == alone and len(set(alone)) == len(set(lengths))
    assert not set(words.hashed_words(column, seed=5)[0].tolist()) & set(alone)


def test_no_sum_of_powers():
    """Words that a polynomial modulo 2**64 can't tell apart, whatever its base is."""
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
        b = a.translate(str.maketrans("ab", "ba"))
        assert words.hashed_words(pa.array([a]))[0][0] != words.hashed_words(pa.array([b]))[0][0]
        x, y = ((" ".join(t)) for t in (a, b))
        (h, _), (g, _) = words.hashed_words(pa.array([x])), words.hashed_words(pa.array([y]))
        ends = np.array([len(h)])
        assert words.sequences(h, np.array([0]), ends)[0] != words.sequences(g, np.array([0]), ends)[0]


def test_sliced_columns_and_cuts():
    column = pa.array(["skip", "a b", None, "c"]).slice(1)
    assert np.diff(words.hashed_words(column)[1]).tolist() == [2, 0, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["x" * 10, "", "y" * 3, None, "z"])], ["id", "text"])
    parts = list(words.slices(iter([batch, batch.slice(0, 0)]), size=4))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(5)) and len(parts) > 1
