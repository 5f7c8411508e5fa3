import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterloom.llm import bpe

TEXTS = [None, "", " ", "a", "Hello  world\n\n it's we'll 'tis  ", "naïve café – ½ ١٢٣", "\U0001f600 ​ x́ 　y", "x" * 5000, "<|endoftext|>", "a<|endoftext|> b <|endoftext", "tab\tand\r\nline  \n end ", "b" * 3 + " " * 2000 + "c", "a b " * 50_000]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def expected(t, text):
    e = t.encode(text or "", add_special_tokens=False).ids
    return len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()


def test_equals_the_library(docs, reference):
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(docs(TEXTS)).collect()}
    assert got == {i: expected(reference, t) for i, t in enumerate(TEXTS)}


def test_round_trip(docs):
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs(TEXTS))).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty_table(docs):
    assert bpe.digests(docs([])).count() == 0 and bpe.decode(bpe.encode(docs([]))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_any_text(texts):
    t = Tokenizer.from_file(bpe.default_vocabulary()) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = t
    if not hasattr(test_any_text, "c"):
        test_any_text.c = bpe.Codec(open(bpe.default_vocabulary(), "rb").read())
    texts = [x.encode("utf-8", "ignore").decode() for x in texts]
    for text, ids in zip(texts, test_any_text.c.encode(texts)):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and test_any_text.c.decode(ids) == t.decode(ids.tolist(), skip_special_tokens=False)
