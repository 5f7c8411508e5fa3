"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

Tokens are the bytes of the UTF-8 text, white space as one token, so no script or word is out of vocabulary. N-grams
of all trusted rows are counted, without a sample; counts of lower orders are the numbers of distinct left
neighbours. Each order has the three discounts of modified Kneser-Ney from its counts of counts. Probabilities and
back-off weights come from joins of count tables on contexts and suffixes, and are dealt by the last two bytes of
their n-gram into shards of a bounded number of rows. A task joins a block of documents with one shard after the other;
its memory doesn't grow with the model, and no document is shuffled.

A document is kept if its perplexity is at most the quantile of the trusted documents of its language. So that these are
judged like any other text, the quantile is taken of perplexities under a model of the other half of them (halves go by
a hash of the text); three models, of either half and of all, are fitted in one go. A language with too few trusted
documents takes the quantile of all. Every text counts as followed by PRIOR tokens of average trusted text, so that a few
odd bytes don't decide over a very short one.

Nulls: a null or empty text has no tokens, no perplexity, and isn't kept. A null language takes the quantile of all.
A null identifier is scored as any other. Repeated rows get equal results. Without trusted rows there is no threshold
and everything with a token is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise, new_folder, scratch, small_side
from rasterloom.llm.words import buffers, signed, slices, trim

#: Order of the model, n-grams a task gathers before it merges their counts, rows of a shard, bytes of text worked off at once, and so many slices at most where a model has several shards.
ORDER, GATHER, SHARD, SLICE, SLICES = 5, 1_000_000, 4_000_000, 1 << 19, 8
#: Quantile of the thresholds, the trusted documents that a language needs for one of its own, and the tokens of average text.
QUANTILE, ENOUGH, PRIOR = 0.99, 50, 30
#: Where the number of a text's part stands in a key, and the part of all texts.
PART, ALL = 60, 2
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[0x09:0x0E] = 0x20


def ngrams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the key of the ORDER bytes that end with it; bytes before the start of its text are 0."""
    raw = _SPACE[raw]
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = raw.astype(np.uint64)
    for j in range(1, ORDER):
        before = np.zeros(len(raw), dtype=np.uint64)
        before[j:] = raw[: max(0, len(raw) - j)]
        before[place < j] = 0
        key |= before << np.uint64(8 * j)
    return key


def counted(texts: DataFrame) -> DataFrame:
    """part, key, n: how often each n-gram of the highest order occurs in a table's column `text`, by its column `part` (0 or 1)."""

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]).astype(float)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for b in slices(batches, size=SLICE):
            raw, offsets = buffers(b.column(0))
            part = np.repeat(b.column(1).to_numpy(zero_copy_only=False).astype(np.uint64), np.diff(offsets))
            parts.append(np.unique(ngrams(raw, offsets) | part << np.uint64(PART), return_counts=True))
            if sum(len(k) for k, _ in parts) > GATHER:
                parts = [merge(parts)]
                if len(parts[0][0]) > GATHER // 2:
                    yield out(*parts.pop())
        if parts:
            yield out(*merge(parts))

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(PART)).astype(np.int32)), signed(keys & np.uint64((1 << PART) - 1)), pa.array(n, pa.int64())], ["part", "key", "n"])

    found = texts.select("text", F.col("part").cast("int").alias("part")).where("text IS NOT NULL").mapInArrow(run, "part int, key long, n long")
    return found.groupBy("part", "key").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame) -> "Model":
    """The model of a table's column `text`."""
    return fit_parts(texts.withColumn("part", F.lit(0)))[ALL]


def fit_parts(texts: DataFrame) -> dict[int, "Model"]:
    """Count, discount and interpolate, for either part of the texts and for all; the shards of the models stay in the shared folder."""
    with scratch(texts.sparkSession):
        return _fit_parts(texts)


def _fit_parts(texts: DataFrame) -> dict[int, "Model"]:
    halves = materialise(counted(texts), "counts")
    whole = halves.groupBy("key").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("part"), "key", "n")
    counts = {ORDER: materialise(halves.unionByName(whole), "counts")}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = materialise(counts[k + 1].groupBy("part", F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("n")), "counts")
    lower, tables, floor = None, [], {}
    for k in range(1, ORDER + 1):
        less = F.lit(0.0)
        for r in counts[k].groupBy("part").agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect():
            ones = [r[f"n{i}"] for i in (1, 2, 3, 4)]
            y = ones[0] / (ones[0] + 2 * ones[1]) if ones[0] and ones[1] else 0.5
            cut = [min(float(i), max(0.01, i - (i + 1) * y * ones[i] / ones[i - 1])) if ones[i - 1] and ones[i] else 0.5 * i for i in (1, 2, 3)]
            less = F.when(F.col("part") == r["part"], F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])).otherwise(less)
        context = F.shiftrightunsigned("key", 8)
        of = counts[k].groupBy("part", context.alias("context")).agg(F.sum("n").alias("total"), F.sum(less).alias("mass"))
        weights = of.select("part", "context", "total", (F.col("mass") / F.col("total")).alias("weight"))
        seen = counts[k].withColumn("context", context).join(weights, ["part", "context"])
        share = (F.col("n") - less) / F.col("total")
        if lower is None:
            p = seen.select("part", "key", (share + F.col("weight") / 256).alias("p"))
        else:
            suffix = F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            below = lower.select("part", F.col("key").alias("suffix"), F.col("p").alias("q"))
            p = seen.withColumn("suffix", suffix).join(below, ["part", "suffix"]).select("part", "key", (share + F.col("weight") * F.col("q")).alias("p"))
        lower = materialise(p, "probabilities")
        tables.append(lower.select("part", F.lit(k).alias("k"), F.lit(False).alias("backoff"), "key", F.log("p").cast("float").alias("value")))
        if k > 1:
            tables.append(weights.select("part", F.lit(k).alias("k"), F.lit(True).alias("backoff"), F.col("context").alias("key"), F.log("weight").cast("float").alias("value")))
        else:
            floor = {r["part"]: r["weight"] / 256 for r in weights.collect()}  # one context, the empty one, for each part
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    whole = materialise(whole, "model")
    shards = {r["part"]: -(-r["count"] // SHARD) for r in whole.groupBy("part").count().collect()}
    path = new_folder(texts.sparkSession, "shards")
    number = F.lit(1)
    for part, n in shards.items():
        number = F.when(F.col("part") == part, n).otherwise(number)
    # What goes by one byte alone, every shard has.
    one = F.col("k") == F.when(F.col("backoff"), 2).otherwise(1)
    own = F.array(F.pmod(_spread(F.col("key").bitwiseAND(F.lit(0xFFFF))), number).cast("int"))
    dealt = whole.withColumn("shard", F.explode(F.when(one, F.sequence(F.lit(0), number.cast("int") - 1)).otherwise(own)))
    dealt.repartition(max(1, sum(shards.values())), "part", "shard").write.partitionBy("part", "shard").parquet(path)
    return {part: Model(f"{path}/part={part}", shards.get(part, 1), float(np.log(floor.get(part, 1 / 256)))) for part in (0, 1, ALL)}


def _spread(last):
    """A number that two last bytes are dealt by; columns and arrays alike."""
    return last * 40503 % 65521


class Model:
    """Where the shards are; n-grams are dealt to them by their last two bytes. `unseen`: log probability of a byte that no trusted text has."""

    def __init__(self, path: str, shards: int, unseen: float):
        self.path, self.shards, self.unseen, self.kept = path, shards, unseen, None

    def __getstate__(self):
        return self.__dict__ | {"kept": None}

    def shard(self, i: int) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
        """Sorted keys and values by order and kind; one shard is held at a time."""
        if self.kept is None or self.kept[0] != i:
            import pyarrow.parquet as pq
            from pyarrow import fs

            self.kept = None
            files, root = fs.FileSystem.from_uri(self.path)
            infos = files.get_file_info(fs.FileSelector(f"{root}/shard={i}", allow_not_found=True))
            parts = [pq.ParquetFile(files.open_input_file(x.path)).read() for x in infos if x.path.endswith(".parquet")]
            tables = {}
            if parts:
                t = pa.concat_tables(parts)
                k, backoff, key, value = (t.column(c).to_numpy() for c in ("k", "backoff", "key", "value"))
                for order in range(1, ORDER + 1):
                    for kind in (False, True):
                        here = (k == order) & (backoff == kind)
                        at = np.argsort(key[here].view(np.uint64))
                        tables[order, kind] = key[here].view(np.uint64)[at], value[here][at]
            self.kept = (i, tables)
        return self.kept[1]

    def find(self, shard: int, order: int, backoff: bool, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether there is one."""
        known, values = self.shard(shard).get((order, backoff), (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
        if not len(known):
            return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return values[at], known[at] == keys

    def by_shard(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if self.shards == 1:
            yield 0, np.arange(len(keys))
        else:
            of = _spread((keys & np.uint64(0xFFFF)).astype(np.int64)) % self.shards
            for i in range(self.shards):
                if len(here := np.flatnonzero(of == i)):
                    yield i, here

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        out, found = np.full(len(keys), self.unseen, dtype=np.float64), np.zeros(len(keys), dtype=np.int8)
        for i, here in self.by_shard(keys):
            for order in range(ORDER, 0, -1):
                value, ok = self.find(i, order, False, keys[here] & np.uint64((1 << 8 * order) - 1))
                out[here[ok]], found[here[ok]] = value[ok], order
                here = here[~ok]
                if not len(here):
                    break
        missed = np.flatnonzero(found < ORDER)
        before = keys[missed] >> np.uint64(8)
        for i, at in self.by_shard(before):
            for order in range(ORDER, 1, -1):
                short = at[found[missed[at]] < order]
                value, ok = self.find(i, order, True, before[short] & np.uint64((1 << 8 * (order - 1)) - 1))
                out[missed[short[ok]]] += value[ok]
        return out


def perplexities(df: DataFrame, model: Model) -> DataFrame:
    """df: text and others; adds n_tokens and perplexity (null without tokens) to every column but text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept), "n_tokens long, perplexity double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=SLICE * min(SLICES, sent.value.shards)):
            raw, offsets = buffers(b.column(b.schema.get_field_index("text")))
            keys, at = np.unique(ngrams(raw, offsets), return_inverse=True)  # each n-gram of a block is looked up once
            total = np.concatenate(([0.0], np.cumsum(sent.value.log_probabilities(keys)[at])))
            n = np.diff(offsets)
            mean = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1)
            columns = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(np.exp(-mean), pa.float64(), mask=n == 0)], [*kept, "n_tokens", "perplexity"])
        sent.value.kept = None
        trim()

    return df.select(*[F.col(f"`{c}`") for c in [*kept, "text"]]).mapInArrow(run, schema)


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """docs: doc_id, text, lang; trusted: doc_id of the trusted ones. One row per document: doc_id, content (hash of the text), lang, n_tokens, perplexity, threshold, kept."""
    ids = small_side(trusted.where("doc_id IS NOT NULL").select("doc_id").distinct())
    good = docs.select("doc_id", "lang", "text").where("text IS NOT NULL").join(ids, "doc_id", "left_semi").withColumn("part", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    models = fit_parts(good)
    halves = [perplexities(good.where(F.col("part") == part).select("lang", "text"), models[1 - part]) for part in (0, 1)]
    good = materialise(halves[0].unionByName(halves[1]).where("perplexity IS NOT NULL"), "trusted")
    usual = good.agg(F.sum(F.col("n_tokens") * F.log("perplexity")) / F.sum("n_tokens")).first()[0] or 0.0
    smooth = F.exp((F.col("n_tokens") * F.log("perplexity") + PRIOR * F.lit(usual)) / (F.col("n_tokens") + PRIOR))
    good = good.withColumn("perplexity", smooth)
    cut = F.percentile_approx("perplexity", quantile, 10_000).alias("own")
    own = good.where("lang IS NOT NULL").groupBy("lang").agg(cut, F.count(F.lit(1)).alias("n")).where(F.col("n") >= ENOUGH).drop("n")
    limit = F.coalesce(F.col("own"), F.lit(good.agg(cut).first()[0]).cast("double"))
    scored = perplexities(docs.select("doc_id", F.xxhash64("text").alias("content"), "lang", "text"), models[ALL])
    scored = materialise(scored, "perplexity", keep=True).withColumn("perplexity", smooth)
    return scored.join(small_side(own), "lang", "left").select(
        "doc_id", "content", "lang", "n_tokens", "perplexity", limit.alias("threshold"), (F.col("perplexity").isNotNull() & (limit.isNull() | (F.col("perplexity") <= limit))).alias("kept")
    )
