"""Language identification by words first, then ever shorter character n-grams.

Per language, the model has smoothed log frequencies of words and of the n-grams of 4, 3, 2 and 1 characters of padded
words. A word the model knows adds its own log frequencies; an unseen word is covered by its known n-grams of four
characters, positions that these leave open by shorter ones. The sums, by language, give a softmax over the languages.

It is fitted on the labelled rows with the smallest hashes of their identifiers, `sample` per language at most (a
documented bound, so the model is bounded and is broadcast), and keeps `vocabulary` words and n-grams of each length
per language at most. Every whole text is scored.

Nulls: rows without a language aren't learned from. A null text, or one without a letter, is `und` with score 0. A
null identifier is scored as any other row. Ties go to the language that sorts first. Repeated rows get equal results.
With no labelled rows, everything is `und`. Only the named columns are read; language and identifier never take part
in a prediction.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise, scratch, small_side
from rasterloom.llm.words import slices, trim

#: Longest and shortest n-grams, labelled rows per language, entries per language and kind, words a task remembers.
NGRAMS, SAMPLE, VOCABULARY, REMEMBERED = (4, 3, 2, 1), 3000, 50_000, 100_000
WORD = r"\p{L}[\p{L}\p{M}]*"


def bucket(ident: Column, n: int) -> Column:
    """crc32 of an identifier's decimal text, modulo n; a null identifier is as an empty text."""
    return F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] or [padded]


def sampled(df: DataFrame, ident: str, label: str, sample: int) -> DataFrame:
    """About `sample` rows of each label, those with the smallest hashes of their identifiers."""
    counts = materialise(df.groupBy(label).count(), "labels")
    share = counts.select(F.col(label), F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count")).alias("share"))
    most = F.lit(float(1 << 31))
    return df.join(small_side(share), label).where(F.pmod(F.xxhash64(ident), F.lit(1 << 31)) < F.col("share") * most).drop("share")


def fit(df: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> "Model":
    """df: doc_id, text, lang of the rows to learn from."""
    with scratch(df.sparkSession):
        return _fit(df, sample, vocabulary)


def _fit(df: DataFrame, sample: int, vocabulary: int) -> "Model":
    rows = sampled(df.where("lang IS NOT NULL AND text IS NOT NULL"), "doc_id", "lang", sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, seen = regex.compile(WORD).findall, defaultdict(int)
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in find(text.lower()):
                    seen[lang, w] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    words = rows.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialise(words, "words")
    # The words of a bounded sample, the most frequent ones of which stay, of all languages in one job.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    top = words.withColumn("place", place).where(F.col("place") <= 4 * vocabulary).toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    langs = sorted(top["lang"].unique().to_pylist())
    counts: list[dict[str, dict[str, int]]] = [{x: {} for x in langs} for _ in range(1 + len(NGRAMS))]
    for lang in langs:
        group = top.filter(pc.equal(top["lang"], lang))
        pairs = list(zip(group["word"].to_pylist(), group["n"].to_pylist()))
        counts[0][lang] = {w: n for w, n in pairs[:vocabulary] if n > 1}
        for k, size in enumerate(NGRAMS):
            of: dict[str, int] = defaultdict(int)
            for w, n in pairs:
                for g in grams(w, size):
                    of[g] += n
            counts[1 + k][lang] = dict(sorted(of.items(), key=lambda x: (-x[1], x[0]))[:vocabulary])
    return Model(langs, counts)


class Model:
    """Log frequencies of words, then of n-grams (divided by their length): for each kind what an unseen one has in every language, and
    for each entry the languages that have seen it, and by how much it exceeds that. So it grows with the entries, not with entries by languages."""

    def __init__(self, langs: list[str], counts: list[dict[str, dict[str, int]]]):
        self.langs, self.rows, size = langs, [], 0
        self.unseen, ends, of_lang, more = np.zeros((1 + len(NGRAMS), len(langs))), array("q", [0]), array("q"), array("d")
        for kind, (n, of) in enumerate(zip((1, *NGRAMS), counts)):
            keys = sorted(set().union(*of.values())) if langs else []
            total = [sum(of[x].values()) + len(keys) for x in langs]
            self.unseen[kind] = [math.log(0.5 / t) / n if t else 0.0 for t in total]
            self.rows.append({k: size + i for i, k in enumerate(keys)})
            size += len(keys)
            for k in keys:
                for i, x in enumerate(langs):
                    if seen := of[x].get(k, 0):
                        of_lang.append(i)
                        more.append(math.log((seen + 0.5) / 0.5) / n)
                ends.append(len(more))
        self.kinds = np.repeat(np.arange(len(self.rows)), [len(r) for r in self.rows])
        self.starts, self.lengths = np.array(ends[:-1], dtype=np.int64), np.diff(np.array(ends, dtype=np.int64))
        self.of_lang, self.more = np.array(of_lang, dtype=np.int64), np.array(more, dtype=np.float64)

    def total(self, rows: list[int], times: list[int]) -> np.ndarray:
        """Sums of the rows' values by language."""
        at, n = np.array(rows, dtype=np.int64), np.array(times, dtype=np.float64)
        long = self.lengths[at]
        entry = np.repeat(self.starts[at] - np.cumsum(long) + long, long) + np.arange(long.sum())
        return np.bincount(self.kinds[at], weights=n, minlength=len(self.unseen)) @ self.unseen + np.bincount(self.of_lang[entry], weights=self.more[entry] * np.repeat(n, long), minlength=len(self.langs))

    def of_word(self, word: str) -> tuple[int, ...]:
        """Rows that add up to a word: its own, or those of the n-grams that cover it."""
        if (row := self.rows[0].get(word)) is not None:
            return (row,)
        padded, out = f"^{word}$", []
        open_ = [True] * len(padded)
        for n, rows in zip(NGRAMS, self.rows[1:]):
            for i in range(len(padded) - n + 1):
                if True in open_[i : i + n] and (row := rows.get(padded[i : i + n])) is not None:
                    out.append(row)
                    open_[i : i + n] = [False] * n
            if True not in open_:
                break
        return tuple(out)


def predict(df: DataFrame, model: Model) -> DataFrame:
    """df: doc_id, text; adds lang_pred and score to every other column but text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, m, known = regex.compile(WORD).findall, sent.value, {}  # known goes with the task
        for b in slices(batches):
            got = []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                seen = find((text or "").lower())
                if not seen or not m.langs:
                    got.append(("und", 0.0))
                    continue
                at, times = [], []
                for w, n in Counter(seen).items():
                    if (rows := known.get(w)) is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        rows = known[w] = m.of_word(w)
                    at += rows
                    times += [n] * len(rows)
                total = m.total(at, times) if at else np.zeros(len(m.langs))
                best = int(total.argmax())
                got.append((m.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())))
            columns = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [*kept, "lang_pred", "score"])
        known.clear()
        trim()

    # Written here, where batches are small; a prediction is a hundredth of its text.
    return materialise(df.select(*[F.col(f"`{c}`") for c in [*kept, "text"]]).mapInArrow(run, schema), "languages", keep=True)
