"""Substring dedup: word windows that occur more than once anywhere are covered and removed.

Every window of `window` words selects one of its k-grams, the one with the least hash (the leftmost of equals), so
equal windows select the same k-gram at the same place. Consecutive windows with one selected k-gram form a region. The
selected k-grams, not the windows, are counted over the corpus; windows of k-grams that occur once are unique. Where
all regions of a k-gram are equal, all their windows repeat. Otherwise the distinct regions of the k-gram, each with
the number of its copies, are the reference shard of a suffix automaton: regions are streamed through it, and matching
statistics and occurrence counts tell which windows repeat. Regions and automata are dealt by their k-gram instead of
broadcast: each automaton broadcast to every document would cost the square of the corpus. K-grams with more distinct
regions than an automaton should hold have their windows counted one by one instead, with the same result.

Regions are told apart by two hashes of their words, the second under a key drawn for the run (128 bits in all); what
passes through an automaton is compared word by word. Which k-gram is selected changes the work, never the result.

Nulls: a null text has no words. A null identifier is a document as any other. Rows equal in identifier and text are
two occurrences of all their windows. Texts shorter than a window lose nothing. An empty table gives an empty result.
Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise, partitions, scratch
from rasterloom.llm.words import hashed_words, mix, new_key, sequences, signed, slices, word_bounds, word_hashes

#: Words of a selected k-gram, and distinct regions that one automaton holds.
K, AUTOMATON = 10, 256
_ODD = np.uint64(0xD6E8FEB86659FD93)


class SuffixAutomaton:
    """All factors of several word sequences, with the number of their occurrences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.len) - 1

    def _split(self, p: int, q: int, w) -> int:
        """The state of the longest factor of p's followed by w, where q holds longer ones, too."""
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, copies: int = 1) -> None:
        last = 0
        for w in words:
            if (q := self.next[last].get(w)) is not None:  # the prefix is known from another sequence
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, q, w)
            else:
                new, p = self._state(self.len[last] + 1, {}, 0), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, w)
                last = new
            self.count[last] += copies

    def finish(self) -> None:
        """Pass counts on to all suffixes."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def statistics(self, words: list, at_most: int) -> Iterator[tuple[int, int]]:
        """For each word the length (at_most) of the longest factor that ends with it, and how often that factor occurs."""
        v, length = 0, 0
        for w in words:
            while v and w not in self.next[v]:
                v = self.link[v]
                length = self.len[v]
            if w in self.next[v]:
                v, length = self.next[v][w], length + 1
            while v and self.len[self.link[v]] >= at_most:
                v = self.link[v]
            length = min(length, at_most) if v else 0
            yield length, self.count[v] if v else 0


def repeated(regions: list[list], copies: list[int], window: int) -> list[int]:
    """For each region the windows (a bit each, by their start) that occur at least twice in all of them."""
    automaton = SuffixAutomaton()
    for r, n in zip(regions, copies):
        automaton.add(r, n)
    automaton.finish()
    return [sum(1 << (i - window + 1) for i, (length, n) in enumerate(automaton.statistics(r, window)) if length >= window and n > 1) for r in regions]


def _runs(h: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of windows and selected k-gram's place, of each region."""
    none = np.zeros(0, dtype=np.int64)
    if len(h) < window:
        return none, none, none
    g = np.zeros(len(h) - K + 1, dtype=np.uint64)
    for j in range(K):
        g = g * _ODD + h[j : len(h) - K + 1 + j]
    key = (mix(g) >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    least, have, want = key, 1, window - K + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    sel = (least & np.uint64((1 << 32) - 1)).astype(np.int64)
    n = np.diff(rows)
    left = np.repeat(rows[1:], n)[: len(sel)] - np.arange(len(sel))
    starts = np.flatnonzero(left >= window)
    if not len(starts):
        return none, none, none
    new = np.concatenate(([True], (sel[starts[1:]] != sel[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), sel[starts[first]]


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: of the kept words, joined by single spaces."""
    return _applied(df, id_col, text_col, window, digests=True)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, text: the kept words, joined by single spaces."""
    return _applied(df, id_col, text_col, window, digests=False)


def _applied(df: DataFrame, id_col: str, text_col: str, window: int, digests: bool) -> DataFrame:
    if not K <= window <= K + 62:
        raise ValueError(f"a window has {K} to {K + 62} words")
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), text.alias("text"))
    with scratch(spark):
        found = materialise(_repeats(docs, window), "repeats", keep=True)
    # A set: rows equal in identifier and text bring the same marks.
    marks = found.groupBy("doc_id", "content").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))
    joined = docs.join(marks.withColumnsRenamed({"doc_id": "id2", "content": "content2"}), F.expr("doc_id <=> id2 AND content = content2"), "left")
    kind = "kept_sha256 string" if digests else "text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_words, n_removed, kept = [], [], []
            for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = t.encode().split()
                n_words.append(len(words))
                if m:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    start, mask = np.array([x["start"] for x in m]), np.array([x["mask"] for x in m], dtype=np.int64)
                    for i in range(window - K + 1):
                        at = np.unique(start[(mask >> i) & 1 == 1] + i)
                        edge[at] += 1
                        edge[at + window] -= 1
                    out = np.cumsum(edge[:-1]) > 0
                    words = [w for w, x in zip(words, out.tolist()) if not x]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            last = pa.array([hashlib.sha256(x).hexdigest() for x in kept] if digests else [x.decode() for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), last], ["doc_id", "n_words", "n_removed", kind.split()[0]])

    return joined.select("doc_id", "text", "marks").mapInArrow(run, f"doc_id long, n_words long, n_removed long, {kind}")


def _repeats(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, content, start, mask: bit i of mask says that the window at start + i occurs elsewhere."""

    key = new_key()

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, rows = hashed_words(b.column(2))
            start, n, sel = _runs(h, rows, window)
            if not len(start):
                continue
            keyed = hashed_words(b.column(2), seed=key)[0]
            end, within = start + n + window - 1, (sel - start).astype(np.uint64)
            found = [mix(sequences(x, start, end) ^ mix(within + np.uint64(1))) for x in (h, keyed)]
            row = np.searchsorted(rows, start, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), *map(signed, (sequences(h, sel, sel + K), *found)), pa.array((start - rows[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["doc_id", "content", "anchor", "region", "check", "start", "n"],
            )

    where = materialise(docs.mapInArrow(regions, "doc_id long, content long, anchor long, region long, check long, start int, n int"), "regions")
    both = F.struct("region", "check")
    of_anchor = where.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.min(both).alias("least"), F.max(both).alias("most")).where("times > 1")
    # Written first, so that the join's sides are plain shuffles, of which Spark can split a hot k-gram's.
    of_anchor = materialise(of_anchor.select("anchor", (F.col("least") != F.col("most")).alias("mixed")), "repeated")
    again = materialise(where.join(of_anchor, "anchor"), "again")
    full = F.expr("shiftleft(1L, n) - 1")
    same = again.where("NOT mixed").select("doc_id", "content", "start", full.alias("mask"))

    # One occurrence stands for all copies of a region.
    distinct = again.where("mixed").groupBy("anchor", "region", "check").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "content", "start", "n")).alias("at"))
    distinct = materialise(distinct, "distinct")
    size = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("regions"))
    ask = distinct.join(size, "anchor").select("anchor", "region", "check", "copies", (F.col("regions") > AUTOMATON).alias("large"), "at.*")
    lists = ask.groupBy("doc_id", "content").agg(F.collect_list(F.struct("anchor", "region", "check", "copies", "large", "start", "n")).alias("asked"))
    lists = lists.withColumnsRenamed({"doc_id": "id2", "content": "content2"})
    answered = docs.join(lists, F.expr("doc_id <=> id2 AND content = content2"))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A region's words for an automaton, or its windows' hashes. Rows equal in identifier and text come one after the other, and the first answers for all."""
        before = None
        for b in slices(batches):
            out: list[tuple] = []
            for i, c, t, asked in zip(*(b.column(k).to_pylist() for k in range(4))):
                if (i, c) == before:
                    continue
                before = i, c
                words = t.encode().split()
                for a in asked:
                    part = words[a["start"] : a["start"] + a["n"] + window - 1]
                    name = a["anchor"], a["region"], a["check"], a["copies"]
                    if a["large"]:
                        raw = np.frombuffer(b" ".join(part), dtype=np.uint8)
                        s, e, _ = word_bounds(raw, np.array([0, len(raw)]))
                        at = np.arange(a["n"])
                        out.append((*name, None, *(sequences(word_hashes(raw, s, e, seed), at, at + window).view(np.int64).tolist() for seed in (0, key))))
                    else:
                        out.append((*name, b" ".join(part).decode(), None, None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["anchor", "region", "check", "copies", "words", "x", "y"])

    asked = answered.select("doc_id", "content", "text", "asked")
    parts = materialise(asked.mapInArrow(contents, "anchor long, region long, check long, copies long, words string, x array<long>, y array<long>"), "contents")

    def automata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[str, int]] = {}
        anchor = None

        def answer() -> pa.RecordBatch:
            keys = list(held)
            masks = repeated([held[k][0].encode().split() for k in keys], [held[k][1] for k in keys], window)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([anchor] * len(keys), [r for r, _ in keys], [c for _, c in keys], masks)], ["anchor", "region", "check", "mask"])

        for b in batches:
            for a, r, c, copies, words in zip(*(b.column(i).to_pylist() for i in range(5))):
                if a != anchor:
                    if held:
                        yield answer()
                    anchor, held = a, {}
                held[r, c] = words, copies
        if held:
            yield answer()

    by_automaton = parts.where("words IS NOT NULL").select("anchor", "region", "check", "copies", "words").repartition(partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor").mapInArrow(automata, "anchor long, region long, check long, mask long")
    of = ["anchor", "region", "check"]
    single = parts.where("words IS NULL").dropDuplicates(of).selectExpr(*of, "copies", "posexplode(arrays_zip(x, y)) AS (i, w)").selectExpr(*of, "copies", "i", "w.x", "w.y")
    often = single.groupBy("anchor", "x", "y").agg(F.sum("copies").alias("times")).where("times > 1").drop("times")
    by_window = single.join(often, ["anchor", "x", "y"], "left_semi").groupBy(*of).agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    masks = materialise(by_automaton.unionByName(by_window), "masks")
    mixed = again.where("mixed").join(masks, of).where("mask != 0").select("doc_id", "content", "start", "mask")
    return same.unionByName(mixed)


ORACLE = """
WITH w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), r AS MATERIALIZED (
  SELECT doc_id, i FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)
), c AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r
), e AS (
  SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) > 0
), k AS (
  SELECT e.doc_id, count(c.p) AS n_removed, string_agg(CASE WHEN c.p IS NULL THEN e.x END, ' ' ORDER BY e.p) AS kept
  FROM e LEFT JOIN c USING (doc_id, p) GROUP BY e.doc_id
)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
