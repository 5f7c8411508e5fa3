"""BPE encoding and decoding through a table of distinct words.

Texts are cut into the words that the tokenizer's own pattern gives. Each block of documents has its table of distinct
words; every word of it that the worker hasn't met yet is encoded once, and ids are joined back by position. Decoding
joins ids with the table of pieces. The table of a block stays in its task: dealing each occurrence of a word through
a shuffle to one table of the whole corpus would move several times the input.

Nulls: a null text encodes as an empty one (no ids). Empty texts give no ids and an empty decoded text. Strings of
special tokens inside a text become those tokens, as the tokenizers library does it. Rows are independent, so ties,
repeated rows and an empty table need no care; only the two named columns are read.
"""

from __future__ import annotations

import gc
import hashlib
import os
import threading
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.common import materialise
from rasterloom.llm.words import slices, trim

#: The byte-level pattern of the vocabulary's pre-tokenizer (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker remembers, and the longest word (bytes) among them.
REMEMBERED = 150_000
LONGEST = 64
#: Seconds after a task for which its worker keeps the codec.
IDLE = 3.0
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means: printable Latin-1 stands for itself, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one byte-level vocabulary, with a bounded table of distinct words."""

    def __init__(self, data: bytes):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = regex.compile(PATTERN).findall
        of, vocabulary = byte_of_char(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.pieces: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.pieces[i] = piece.encode() if piece in self.added else bytes(of[c] for c in piece)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if self.cut and any(x in text for x in self.added):
            return [w for part in self.cut(text) if part for w in ([part] if part in self.added else self.find(part))]
        return self.find(text)

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian, 32 bits each) of words; encodings hold much more than ids, so they are asked for in parts."""
        got = {}
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            got |= {w: array("I", e.ids).tobytes() for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False))}
        return got

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [self.words(t) for t in texts]
        table, new = {}, []
        for w in set().union(*split):
            if (ids := self.young.get(w)) is None and (ids := self.old.get(w)) is not None:
                self.young[w] = ids
            if ids is None:
                new.append(w)
            else:
                table[w] = ids
        got = self.learn(new)
        table |= got
        # Words of the last half of what may be remembered, and before them those of the half before.
        self.young |= {w: b for w, b in got.items() if len(w) <= LONGEST} if len(got) <= REMEMBERED // 2 else {}
        if len(self.young) > REMEMBERED // 2:
            self.old, self.young = self.young, {}
        for words in split:
            yield np.frombuffer(b"".join([table[w] for w in words]), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", errors="replace")


class _Kept:
    """A worker's codec. Its next task goes on with it; where none comes for a while, its memory is handed back, as other tasks need it."""

    lock = threading.Lock()
    of: int | None = None
    codec: Codec | None = None
    timer: threading.Timer | None = None

    @classmethod
    def drop(cls) -> None:
        with cls.lock:
            cls.of = cls.codec = cls.timer = None
        gc.collect()
        trim()


@contextmanager
def _codec(sent: Broadcast) -> Iterator[Codec]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # threads of its own each come with a heap of their own
    with _Kept.lock:
        if _Kept.timer:
            _Kept.timer.cancel()
        codec, of = _Kept.codec, hash(sent.value)
        if codec is None or _Kept.of != of:
            codec = _Kept.codec = Codec(sent.value)
            _Kept.of = of
    try:
        yield codec
    finally:
        with _Kept.lock:
            _Kept.timer = threading.Timer(IDLE, _Kept.drop)
            _Kept.timer.daemon = True
            _Kept.timer.start()


def _vocabulary(spark: SparkSession, path: str | None) -> Broadcast:
    """A vocabulary file (a megabyte or two)."""
    with open(path or default_vocabulary(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: the ids of every whole text."""
    data = _vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(data) as codec:
            for b in slices(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int32) for x in codec.encode(_texts(b))], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """doc_id, text: ids joined with the table of pieces, special tokens included; null ids decode as an empty text."""
    data = _vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(data) as codec:
            for b in batches:
                texts = [codec.decode(np.array(x or [], dtype=np.int64)) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids").mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encode and decode every text and keep counts and digests only, without moving ids between processes."""
    data = _vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(data) as codec:
            for b in slices(batches):
                n, of_ids, of_text = [], [], []
                for ids in codec.encode(_texts(b)):
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    of_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    # Written here, where batches are small; a digest is a hundredth of its text.
    return materialise(df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, DIGESTS), "digests", keep=True)


def _texts(b: pa.RecordBatch) -> list[str]:
    return [t or "" for t in b.column(1).to_pylist()]
