"""Jaccard self-join of word-shingle sets by prefix filters under several global token orders.

Two sets of similarity t or more share a token among the first n - ceil(t n) + 1 of each, whatever the order is, and
one more for each token by which these prefixes are made longer. Order one is by hash; it is cheap, and a set of whose
prefix too few tokens are in any other prefix is done. For what is left, order two puts frequent tokens last; order
three is by another hash. A pair must share enough of its prefixes under all of them before its sets are compared.

Documents with equal sets are one class, joined once. A class goes by a hash of its set, and a second one, under a key
drawn for the run, finds different sets that share the first. Links are verified by comparing words, not hashes. To find components, the members of a token's list are first
compared with one of them, the one with the fewest rare tokens before it (each set with that of most of its lists), then
long lists are dealt into small parts, twice, and compared within these; pairs inside a component that this links need no
comparison, all others get it. No list, class or component is collected anywhere.

Nulls: a null text counts as empty; an empty set links with nothing. A row with a null identifier links with nothing
and has a null component. Equal rows are one class. An empty table gives an empty result. Only the two named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise, partitions, scratch, small_side
from rasterloom.llm.components import components
from rasterloom.llm.words import hashed_words, mix, new_key, shingles, signed, slices, trim

#: Postings that a task gathers before it emits them; tokens that the second order may put last, bytes of tokens a task counts at once, and how often it must meet one among them.
FLUSH, FREQUENT, COUNTED, SEEN = 500_000, 131_072, 16 << 20, 2
#: Rounds in which members of long lists are compared in parts of about so many before all are.
ROUNDS, WIDTH = 2, 16
#: Different sets with equal hashes that are put up with.
CLASHES = 10_000
_SECOND, _THIRD = np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D)


def sets_of(column: pa.Array, k: int, key: int = 0) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """Each row's distinct shingle hashes, ascending, and, if there is a key, a hash of the set that shares nothing with theirs."""
    h, rows = hashed_words(column, lower=True)
    s, row = shingles(h, rows, k)
    again = shingles(hashed_words(column, lower=True, seed=key)[0], rows, k)[0] if key else s
    at = np.searchsorted(row, np.arange(len(column) + 1))
    for i in range(len(column)):
        x = s[at[i] : at[i + 1]]
        order = np.argsort(x)
        x = x[order]
        new = np.ones(len(x), dtype=bool)
        np.not_equal(x[1:], x[:-1], out=new[1:])
        yield x[new], mix(again[at[i] : at[i + 1]][order[new]] ^ np.uint64(key)).sum(dtype=np.uint64) if key else np.uint64(0)


def class_of(x: np.ndarray) -> np.uint64:
    """A hash of a set."""
    return mix(np.array([mix(x ^ _THIRD).sum(dtype=np.uint64) + np.uint64(len(x))]))[0]


def overlap(x: bytes, y: bytes, k: int) -> tuple[int, int, int]:
    """Sizes of two texts' sets and of what they have in common, by comparing words, not hashes."""
    ids: dict[bytes, int] = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in t.lower().split()], dtype=np.uint64) for t in (x, y))
    if min(len(a), len(b)) < k:  # one sequence, which only an equal one equals
        n, m = (min(len(v), 1) if len(v) < k else len(np.unique(np.lib.stride_tricks.sliding_window_view(v, k), axis=0)) for v in (a, b))
        return n, m, int(len(a) > 0 and np.array_equal(a, b))
    codes, most = np.concatenate((a[: len(a) - k + 1], b[: len(b) - k + 1])), len(ids)
    for j in range(1, k):
        if most * len(ids) >= 1 << 64:
            codes = np.unique(codes, return_inverse=True)[1].astype(np.uint64)
            most = len(codes)
        codes = codes * np.uint64(len(ids)) + np.concatenate((a[j : len(a) - k + 1 + j], b[j : len(b) - k + 1 + j]))
        most *= len(ids)
    p, q = np.unique(codes[: len(a) - k + 1]), np.unique(codes[len(a) - k + 1 :])
    return len(p), len(q), common(p, q)


def common(x: np.ndarray, y: np.ndarray) -> int:
    z = np.sort(np.concatenate((x, y)))
    return int((z[1:] == z[:-1]).sum())


def required(n: int, percent: int) -> int:
    """The least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def prefix(n: int, percent: int) -> int:
    """Tokens of a set that are looked at: as many as one in common takes, and a tenth of the set more."""
    return min(n, n - required(n, percent) + 1 + n // 10)


def in_common(n: int, m: int, percent: int) -> int:
    """Tokens that the prefixes of two sets, of n and m, have in common at least, under any order."""
    overlap = -(-percent * (n + m) // (100 + percent))
    return overlap - max(n - prefix(n, percent), m - prefix(m, percent))


def _prefix_sql(n: str, percent: int) -> str:
    return f"least({n}, {n} - ({percent} * {n} + 99) DIV 100 + 1 + {n} DIV 10)"


class _Postings:
    """Gathers (token, class, size, position) and emits them packed by bucket: at most two of a token go to its bucket, which shows
    there that it is shared; further ones are known to be shared and are dealt anywhere. So no bucket gets a hot token's whole list."""

    FIELDS = np.dtype([("token", "<u8"), ("cls", "<u8"), ("n", "<u4"), ("pos", "<u4")])

    def __init__(self, buckets: int, positions: bool):
        self.buckets, self.positions, self.parts, self.size = buckets, positions, [], 0

    def add(self, tokens: np.ndarray, cls: np.uint64, n: int) -> bool:
        x = np.empty(len(tokens), dtype=self.FIELDS)
        x["token"], x["cls"], x["n"], x["pos"] = tokens, cls, n, np.arange(len(tokens))
        self.parts.append(x)
        self.size += len(x)
        return self.size >= FLUSH

    def pack(self, x: np.ndarray) -> bytes:
        raw = x["token"].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() + x["cls"].tobytes()
        return raw + x["n"].tobytes() + x["pos"].tobytes() if self.positions else raw

    @classmethod
    def unpack(cls, raw: bytes, positions: bool) -> np.ndarray:
        n = len(raw) // (22 if positions else 14)
        x = np.zeros(n, dtype=cls.FIELDS)
        token = np.zeros((n, 8), dtype=np.uint8)
        token[:, 2:] = np.frombuffer(raw, np.uint8, 6 * n).reshape(n, 6)
        x["token"] = token.view("<u8")[:, 0]
        x["cls"] = np.frombuffer(raw, "<u8", n, 6 * n)
        if positions:
            x["n"], x["pos"] = np.frombuffer(raw, "<u4", n, 14 * n), np.frombuffer(raw, "<u4", n, 18 * n)
        return x

    @staticmethod
    def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct by token and class, in order, with each one's place in its token's list and the length of that list."""
        x = x[np.lexsort((x["cls"], x["token"]))]
        if len(x) > 1:
            x = x[np.concatenate(([True], (x["token"][1:] != x["token"][:-1]) | (x["cls"][1:] != x["cls"][:-1])))]
        new = np.concatenate(([True], x["token"][1:] != x["token"][:-1])) if len(x) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(x)))
        return x, np.arange(len(x)) - np.repeat(start, length), np.repeat(length, length)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        x, place, _ = self.grouped(np.concatenate(self.parts))
        self.parts, self.size = [], 0
        bucket = (mix(x["token"].copy() >> np.uint64(16)) % np.uint64(self.buckets)).astype(np.int64)
        known = place >= 2
        bucket[known] = mix(x["cls"][known]) % np.uint64(self.buckets)
        for shared in (False, True):
            y, b = x[known == shared], bucket[known == shared]
            order = np.argsort(b, kind="stable")
            y, b = y[order], b[order]
            at = np.searchsorted(b, np.arange(self.buckets + 1))
            full = np.flatnonzero(np.diff(at))
            if len(full):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full), pa.array([shared] * len(full)), pa.array([self.pack(y[at[i] : at[i + 1]]) for i in full], pa.binary())], ["bucket", "shared", "packed"]
                )


def _shared(packed: DataFrame, buckets: int, positions: bool) -> DataFrame:
    """token, cls, n, pos of the postings whose token at least two classes have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(x), 100_000):
                y = x[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([signed(y["token"].copy()), signed(y["cls"].copy()), pa.array(y["n"].astype(np.int64)), pa.array(y["pos"].astype(np.int64))], ["token", "cls", "n", "pos"])

        parts = []
        for b in batches:
            for shared, raw in zip(b.column(1).to_pylist(), b.column(2)):
                x = _Postings.unpack(raw.as_py(), positions)
                if shared:
                    yield from out(x)
                else:
                    parts.append(x)
        if parts:
            x, _, length = _Postings.grouped(np.concatenate(parts))
            yield from out(x[length > 1])
        trim()

    return packed.repartition(buckets, "bucket").mapInArrow(run, "token long, cls long, n long, pos long")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, with_content: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links lead to, its own included), and content, a hash of the text, if asked for."""
    with scratch(df.sparkSession):
        rows, of_class = _classes(df, id_col, text_col, k, percent)
        of_class = materialise(of_class, "component-ids", keep=True)
    out = rows.join(of_class, "cls", "left")
    return out.select("doc_id", *(["content"] if with_content else []), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _classes(df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, content, n_shingles, cls of every row, and cls, component_id of every class."""
    buckets = 2 * partitions(df.sparkSession)
    docs = df.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{text_col}` AS text", f"xxhash64(`{text_col}`) AS content")

    key = new_key()

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [(len(x), class_of(x).view(np.int64) if len(x) else None, y.view(np.int64)) for x, y in sets_of(b.column(1), k, key)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, pa.int64()) for c in list(zip(*got)) or [[]] * 3)], ["doc_id", "content", "n_shingles", "cls", "check"])

    rows = materialise(docs.mapInArrow(classes, "doc_id long, content long, n_shingles long, cls long, check long"), "classes", keep=True)
    # Different sets with one hash: about one in 2**64 pairs, so these few are sent to all tasks; they go by their second hash.
    clash = rows.groupBy("cls").agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least != most").select("cls")
    clash = frozenset(r["cls"] for r in clash.limit(CLASHES + 1).collect())
    if len(clash) > CLASHES:
        raise ValueError("too many different sets with equal hashes")
    if clash:
        rows = rows.withColumn("cls", F.when(F.col("cls").isin(list(clash)), F.col("check")).otherwise(F.col("cls")))

    def named(column: pa.Array) -> Iterator[tuple[np.ndarray, np.uint64]]:
        """Each row's set and class."""
        if not clash:
            yield from ((x, class_of(x)) for x, _ in sets_of(column, k))
        else:
            yield from ((x, y if int(c.view(np.int64)) in clash else c) for x, y in sets_of(column, k, key) for c in [class_of(x)])

    def first_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post = _Postings(buckets, positions=False)
        for b in slices(batches):
            for x, c in named(b.column(1)):
                if len(x) and post.add(x[: prefix(len(x), percent)], c, len(x)):
                    yield from post.flush()
        yield from post.flush()

    reps = rows.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    packed = docs.where("doc_id IS NOT NULL").mapInArrow(first_order, "bucket long, shared boolean, packed binary")
    enough = f"shared >= {_prefix_sql('n', percent)} - (n - ({percent} * n + 99) DIV 100)"
    left = materialise(_shared(packed, buckets, positions=False).groupBy("cls").agg(F.count(F.lit(1)).alias("shared")).join(reps, "cls").where(enough).select("cls", "rep"), "first-order")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept = [i for i, (c, (x, y)) in enumerate(zip(b.column(0).to_pylist(), named(b.column(1)))) if len(x) and int(y.view(np.int64)) == c]
            yield b.take(pa.array(kept, pa.int64()))

    chosen = docs.join(small_side(left), docs.doc_id == left.rep).select("cls", "text")
    whole = materialise(chosen.mapInArrow(sets, "cls long, text string"), "sets")
    frequent = _frequent(whole, k)
    shared = materialise(_shared(whole.mapInArrow(_second_order(frequent, buckets, k, percent), "bucket long, shared boolean, packed binary"), buckets, positions=True), "second-order")

    # First against one member of each token's list, then whatever is in different components.
    centre = shared.groupBy("token").agg(F.min(F.struct("pos", "cls", "n")).alias("c"))
    near = shared.join(centre, "token").where("cls != c.cls AND " + _SIZES.format(n="n", m="c.n", p=percent))
    most = near.groupBy("cls", F.col("c.cls").alias("cls2")).agg(F.count(F.lit(1)).alias("times")).groupBy("cls").agg(F.max(F.struct("times", "cls2")).alias("best"))
    stars = materialise(_pairs(most.select("cls", F.col("best.cls2").alias("cls2"))).distinct(), "stars")
    links = materialise(_verified(stars, whole, k, percent), "links")
    found, tested, open_ = components(links), stars, shared
    for salt in [*range(ROUNDS), None]:
        open_ = materialise(_open(open_, found), "open")
        met = _met(open_, percent, salt)
        more = materialise(_verified(met.join(tested, ["a", "b"], "left_anti"), whole, k, percent), "links")
        if more.limit(1).count():
            links = links.unionByName(more)
            found = components(links)
        if salt is not None:
            tested = tested.unionByName(met)
    members = reps.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows, members.join(least, "component").select("cls", "component_id")


def _open(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Postings of tokens in several components, with these."""
    of = shared.select("token", "cls", "n", "pos").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = of.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("length")).where("x != y").select("token", "length")
    return of.join(mixed, "token")


def _met(open_: DataFrame, percent: int, salt: int | None) -> DataFrame:
    """a, b: pairs across components that a token's list brings together; with a salt, only those that fall into one of the parts a long list is dealt into."""
    if salt is not None:
        open_ = open_.where(f"length > {4 * WIDTH}").withColumn("part", F.expr(f"pmod(xxhash64(token, cls, {salt}L), length DIV {WIDTH})"))
    keys = ["token"] if salt is None else ["token", "part"]
    x, y = open_.select(*keys, "cls", "n", "pos", "component"), open_.selectExpr(*keys, "cls AS cls2", "n AS m", "pos AS pos2", "component AS component2")
    # The first token in common is where both sets have room for the overlap from there on; later ones say nothing new.
    room = f"{100 + percent} * least(n - pos, m - pos2) >= {percent} * (n + m)"
    pairs = _pairs(x.join(y, keys).where("cls < cls2 AND component != component2 AND " + _SIZES.format(n="n", m="m", p=percent) + " AND " + room)).distinct()
    return pairs if salt is None else materialise(pairs, "met")


_SIZES = "100 * least({n}, {m}) >= {p} * greatest({n}, {m})"


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b"))


def _frequent(whole: DataFrame, k: int) -> np.ndarray:
    """The most frequent tokens, rarest first; at most FREQUENT, counted in every set. Which ones these are only affects speed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            t, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            kept = c >= (SEEN if len(t) > COUNTED // 16 else 1)  # a small block can't tell which tokens are rare
            return pa.RecordBatch.from_arrays([signed(t[kept]), pa.array(c[kept].astype(np.int64))], ["token", "seen"])

        parts, size = [], 0
        for b in slices(batches):
            for x, _ in sets_of(b.column(0), k):
                parts.append(x)
                size += x.nbytes
                if size >= COUNTED:
                    yield out(parts)
                    parts, size = [], 0
        yield out(parts)

    counted = whole.select("text").mapInArrow(run, "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen")).where("seen > 1")
    # Steps grow beyond 4096, so there are few of them; those that together have too many tokens are left out.
    step = F.when(F.col("seen") < 4096, F.col("seen")).otherwise(4096 + F.floor(16 * F.log2(F.col("seen") / 4096)))
    counted = materialise(counted.withColumn("step", step.cast("long")), "frequent")
    least, total = None, 0
    for r in counted.groupBy("step").count().orderBy(F.col("step").desc()).collect():
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["step"]
    top = counted.where(F.col("step") >= F.lit(least)).toPandas().sort_values(["seen", "token"])
    return top["token"].to_numpy(dtype=np.int64).copy().view(np.uint64)


def _second_order(frequent: np.ndarray, buckets: int, k: int, percent: int):
    rank = np.argsort(frequent).astype(np.uint64)
    values = np.sort(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post = _Postings(buckets, positions=True)
        for b in slices(batches):
            for cls, (x, _) in zip(b.column(0).to_pylist(), sets_of(b.column(1), k)):
                key = mix(x ^ _SECOND) >> np.uint64(1)
                if len(values):
                    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
                    last = values[at] == x
                    key[last] = rank[at[last]] | np.uint64(1 << 63)
                first = x[np.argsort(key, kind="stable")[: prefix(len(x), percent)]]
                if post.add(first, np.array([cls], dtype=np.int64).view(np.uint64)[0], len(x)):
                    yield from post.flush()
        yield from post.flush()
        trim()

    return run


def _verified(pairs: DataFrame, whole: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs that share enough of their prefixes under the other orders, too, and then enough of their shingles, which are compared as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "x"):
            kept = []
            for i, ((x, _), (y, _)) in enumerate(zip(sets_of(b.column(2), k), sets_of(b.column(3), k))):
                p, q = prefix(len(x), percent), prefix(len(y), percent)
                least = in_common(len(x), len(y), percent)
                if common(x[:p], y[:q]) < least or common(*(z[np.argsort(mix(z ^ _THIRD))[:m]] for z, m in ((x, p), (y, q)))) < least:
                    continue
                n, m, both = overlap(b.column(2)[i].as_py().encode(), b.column(3)[i].as_py().encode(), k)
                if 100 * both >= percent * (n + m - both):
                    kept.append(i)
            yield b.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    x = whole.select(F.col("cls").alias("a"), F.col("text").alias("x"))
    y = whole.select(F.col("cls").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


ORACLE = """
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), r AS (
  SELECT doc_id, doc_id AS reached FROM w
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
