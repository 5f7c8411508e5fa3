"""Toxicity by compression distance: windows are compressed with a dictionary of toxic and one of ordinary text.

Training takes the labelled rows with the smallest identifier hashes, `sample` per label at most (a documented bound),
in equal parts of its languages. Both dictionaries are trained by zstandard: the ordinary one on windows of a few words
of ordinary rows, the toxic one on windows of toxic rows from which words that ordinary rows have as well are left out;
with them, its segments would be those of the many ordinary words that toxic rows consist of, and the few telling ones
wouldn't get in. A word stays if it begins (or is) as a language's toxic rows have it far more often than its ordinary
ones, in changing surroundings; what stays is the word or that beginning alone, whichever tells halves of the sample
apart better. To compress ordinary words alike, the toxic dictionary goes before the ordinary one, which is trained
without words that begin so.
A window's distance is the difference of its two compressed lengths; a text's features are how far, and in what share,
its windows exceed what ordinary windows show. A logistic curve, fitted to distances under dictionaries that the other
half of the sample trained, calibrates them to a score, in which 0.7 separates the labels best.

Nulls: rows without a label or text aren't learned from; a null or empty text gets the score of a text without any toxic
window. Identifiers, labels and languages take no part in a score. Rows without a language are a language of their own
in training, as are all rows of a table without that column. Equal texts get equal scores. Without labelled rows of both
kinds every score is 0. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise, scratch, small_side
from rasterloom.llm.langid import sampled
from rasterloom.llm.words import slices

#: Labelled rows per label, in equal parts of its languages, that training reads, words of a window, bytes of each dictionary, the level of compression.
SAMPLE, WINDOW, DICTIONARY, LEVEL = 6000, 16, 1 << 16, 3
#: A second bound: bytes of windows, at 80 each, that train the ordinary dictionary; of more windows every n-th is taken.
ORDINARY = DICTIONARY * 40
#: A beginning of toxic rows' words is distinctive if this share of rows has it, so many times as often in as many words as ordinary rows, by a G-test of this value.
ROWS, LIFT, G_TEST = 0.01, 8.0, 15.0
#: Characters of the beginnings looked at, besides whole words; one nearly as frequent (so large a share) as a shorter one takes its place.
SHORTEST, LONGEST, NEARLY = 4, 16, 0.95
#: Size of the toxic dictionary: so many times its distinct words, the smallest one at least.
TIMES, SMALLEST = 2, 1024
#: Share of ordinary windows whose distance stays below the calibrated one, and the score from which a text is toxic.
QUANTILE, THRESHOLD = 0.99, 0.7


def windows(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode().split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


class Model:
    def __init__(self, ordinary: bytes = b"", toxic: bytes = b""):
        """ordinary, toxic: dictionaries trained on either text. The toxic one is put before the ordinary one, so what is ordinary compresses alike."""
        self.content, self.theta, self.weights = (ordinary, toxic + ordinary), 0.0, None
        self.packers = None

    def __getstate__(self):
        return self.__dict__ | {"packers": None}

    def distances(self, text: str | None) -> np.ndarray:
        """By how many bytes each window is shorter with the toxic dictionary."""
        if not self.packers:
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=6, strategy=zstandard.STRATEGY_LAZY2)
            self.packers = []
            for c in self.content:
                d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                self.packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
        plain, toxic = self.packers
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], dtype=np.int64)

    def features(self, text: str | None) -> list[float]:
        d = self.distances(text)
        over = np.maximum(0, d - self.theta)
        return [float(np.log1p(over.sum())), float(over.max(initial=0)), float((over > 0).sum() > 1), float(np.log1p(len(d))), float((over > 0).sum() / max(1, len(d)))]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        z = float(np.dot(self.weights, [1.0, *self.features(text)]))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _beginnings(word: bytes) -> list[bytes]:
    w = word.decode()
    return [*(w[:n].encode() for n in range(SHORTEST, min(len(w), LONGEST + 1))), word]


def _marks(toxic: list[str], ordinary: list[str]) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """Words and beginnings that one language's toxic texts have far more often than its ordinary ones, in changing surroundings, and the words that begin so: the share of toxic texts with each."""
    split = lambda t: t.lower().encode().split()
    # No more rows have a beginning than its words have in all, so most are left out before rows are counted.
    seen = Counter(w for t in toxic for w in set(split(t)))
    most: Counter[bytes] = Counter()
    for w, k in seen.items():
        for g in set(_beginnings(w)):
            most[g] += k
    possible = {g for g, k in most.items() if k >= ROWS * len(toxic)}
    rows, times, total = [], [], []
    for texts in (ordinary, toxic):
        rows.append(Counter())
        times.append(Counter())
        total.append(0)
        known: dict[bytes, list[bytes]] = {}
        for t in texts:
            here: Counter[bytes] = Counter()
            for w, k in Counter(split(t)).items():
                total[-1] += k
                if w not in known:
                    known[w] = [g for g in _beginnings(w) if g in possible]
                for g in known[w]:
                    here[g] += k
            rows[-1].update(here.keys())
            times[-1].update(here)
    share = len(toxic) / (len(toxic) + len(ordinary))
    marks = set()
    for g, n in rows[1].items():
        m = rows[0][g]
        g_test = 2 * (n * np.log(n / ((n + m) * share)) + (m * np.log(m / ((n + m) * (1 - share))) if m else 0))
        more = n / len(toxic) > m / len(ordinary) and times[1][g] * total[0] >= LIFT * times[0][g] * total[1]
        if g_test >= G_TEST and n >= ROWS * len(toxic) and more:
            marks.add(g)
    # Copies of one text bring its words in the same places each time: a mark must follow about as many words as there are rows with it.
    after: dict[bytes, set[bytes]] = {g: set() for g in marks}
    for t in toxic:
        words = split(t)
        for u, w in zip([b"", *words], words):
            for g in known[w]:
                if g in after:
                    after[g].add(u)
    marks = {g for g in marks if 2 * len(after[g]) >= rows[1][g]}
    longer: dict[bytes, int] = {}
    for g in marks:
        shorter = g.decode()[:-1].encode()
        longer[shorter] = max(longer.get(shorter, 0), rows[1][g])
    marks = {g for g in marks if longer.get(g, 0) < NEARLY * rows[1][g]}
    shortest = {g: rows[1][g] / len(toxic) for g in marks if not any(x != g and x in marks for x in _beginnings(g))}
    return shortest, {w: k / len(toxic) for w, k in seen.items() if any(g in marks for g in known[w])}


def _distinctive(by: dict[int, list[tuple[str, str | None]]]) -> tuple[list[bytes], list[bytes]]:
    """The marks of every language, and the words that begin with them, rarer ones first."""
    shares: tuple[dict[bytes, float], dict[bytes, float]] = ({}, {})
    for lang in {x for _, x in by[1]}:
        toxic, ordinary = ([t for t, x in by[y] if x == lang] for y in (1, 0))
        if ordinary:
            for found, into in zip(_marks(toxic, ordinary), shares):
                for w, share in found.items():
                    into[w] = max(share, into.get(w, 0.0))
    marks, forms = (sorted(x, key=lambda w: (x[w], w)) for x in shares)
    return marks, forms


def _told(texts: list[str], marks: list[bytes], whole: bool) -> list[bytes]:
    """Windows of toxic texts without the words that don't begin with a mark; of the others all (whole) or the mark alone."""
    by_length = sorted(marks, key=len)
    first = tuple(marks)
    cut = cache(lambda w: (w if whole else next(g for g in by_length if w.startswith(g))) if w.startswith(first) else None)
    kept = ([x for w in t.lower().encode().split() if (x := cut(w))] for t in texts)
    return [b" " + b" ".join(k[i : i + WINDOW]) + b" " for k in kept for i in range(0, len(k), WINDOW)]


def _train(samples: list[bytes], size: int) -> bytes:
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: they are the dictionary
        return b"".join(samples)[-size:]


def _dictionaries(by: dict[int, list[tuple[str, str | None]]]) -> list[Model]:
    """A model whose toxic dictionary is trained on the marks in toxic windows, and one on the whole words that begin with them."""
    marks, forms = _distinctive(by)
    first = tuple(marks)
    begins = cache(lambda word: word.startswith(first))
    samples = [w for t, _ in by[0] for w in windows(" ".join(x for x in t.lower().split() if not begins(x.encode())))]
    step = max(1, len(samples) * 80 // ORDINARY)
    ordinary = _train(samples[::step], DICTIONARY)
    texts = [t for t, _ in by[1]]
    sizes = [min(DICTIONARY, max(SMALLEST, TIMES * sum(len(x) + 1 for x in found))) for found in (marks, forms)]
    return [Model(ordinary, _train(_told(texts, marks, whole), size)) for whole, size in zip((False, True), sizes)]


def trained(rows: list[tuple[int | None, str, int, str | None]]) -> Model:
    """rows: identifier, text, label, language of a bounded sample. Dictionaries of either half are calibrated on the other; the model's own are of all rows. Of its two kinds the one that told more rows apart is taken."""
    half = [hashlib.md5(str(i).encode()).digest()[0] & 1 for i, *_ in rows]
    parts = [{y: [(t, lang) for (_, t, label, lang), o in zip(rows, half) if label == y and o == k] for y in (0, 1)} for k in (0, 1)]
    if not all(p[y] for p in parts for y in (0, 1)):
        return Model()
    checks = [(_dictionaries(parts[k]), parts[1 - k]) for k in (0, 1)]
    models = _dictionaries({y: parts[0][y] + parts[1][y] for y in (0, 1)})
    right = [_calibrate(model, [(m[kind], p) for m, p in checks]) for kind, model in enumerate(models)]
    return models[int(np.argmax(right))]


def _calibrate(model: Model, checks: list[tuple[Model, dict[int, list[tuple[str, str | None]]]]]) -> float:
    """Set the model's curve by models of a half and the rows of the other; returns how many of these it tells apart."""
    model.theta = float(np.quantile(np.concatenate([m.distances(t) for m, p in checks for t, _ in p[0]]), QUANTILE))
    x, y = [], []
    for m, p in checks:
        m.theta = model.theta
        for label in (0, 1):
            x += [[1.0, *m.features(t)] for t, _ in p[label]]
            y += [float(label)] * len(p[label])
    x, y = np.array(x), np.array(y)
    weights = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-x @ weights))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(weights))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    # Move the curve so that the threshold is where the two labels are told apart best.
    z = x @ weights
    order = np.argsort(z)
    right = np.concatenate(([y.sum()], y.sum() - np.cumsum(y[order]) + np.cumsum(1 - y[order])))
    edges = np.concatenate(([z.min() - 1], z[order], [z.max() + 1]))
    right[1:-1][np.diff(z[order]) == 0] = -1
    best = np.flatnonzero(right == right.max())
    at = best[len(best) // 2]
    weights[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - (edges[at] + edges[at + 1]) / 2
    model.weights = weights
    return float(right.max())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text and lang, if there is one; labels: doc_id, toxic (0 or 1) of the rows to learn from. Labels are sampled before texts are looked at."""
    with scratch(docs.sparkSession):
        return trained(_sample(docs, labels, sample))


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> list[tuple[int | None, str, int, str | None]]:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.where("text IS NOT NULL").select("doc_id", lang.alias("lang"), "text")
    strata = labels.where("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).join(docs.select("doc_id", "lang").distinct(), "doc_id")
    strata = materialise(strata.withColumn("stratum", F.concat_ws(" ", "toxic", "lang")), "strata")
    chosen = sampled(strata, "doc_id", "stratum", -(-sample // max(1, strata.select("lang").distinct().count())))
    chosen = small_side(chosen.select(F.col("doc_id").alias("id2"), F.col("lang").alias("lang2"), "toxic"))
    rows = docs.join(chosen, F.expr("doc_id = id2 AND lang <=> lang2"))
    found = ((r["doc_id"], r["text"], r["toxic"], r["lang"]) for r in rows.select("doc_id", "text", "toxic", "lang").toLocalIterator())
    return sorted(found, key=lambda r: (r[:3], r[3] or ""))


def score(df: DataFrame, model: Model) -> DataFrame:
    """df: doc_id, text and others; adds score and predicted to every column but text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept), "score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            scores = [sent.value.score(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            columns = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], [*kept, "score", "predicted"])

    return df.select(*[F.col(f"`{c}`") for c in [*kept, "text"]]).mapInArrow(run, schema)
