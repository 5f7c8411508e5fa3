"""Benchmark decontamination, in DataFrame operations only.

Words are runs of letters, marks and digits of the lower-cased text; shingles are five words in sequence (a text of
fewer has one, all of its words). A benchmark item with m shingles is compared with the windows of m shingles of a
document; one with fewer than m, but enough for the similarity asked for, is its own one window. A window has so much
in common with an item only if enough of its places have shingles of items of that size; all windows of which this holds
get a fingerprint: a 64-bit SimHash, in which each occurrence of a shingle weighs one. Fingerprints are cut into
radius + 1 blocks, so any two within the radius of each other agree in a block: the join on the item's size, block number
and block value meets every such pair. Those within the radius are verified by the exact weighted Jaccard similarity of
their shingles (least over greatest numbers of occurrences). With the radius of 21, a pair of similarity 0.75, expected at
11 +- 3 bits, is found all but certainly, and a verbatim passage always, except one of an item of fewer than five words:
its only shingle is all of its words, and longer texts have shingles of five words only, so it is found only where it is a
whole document. Blocks that a radius of a third of the bits leaves (two or three bits each) don't tell windows apart, so
it is the places that keep candidates few: a window that is left meets the items of its size, and most often is a match.

Nulls: null and empty texts have no shingles and match nothing; rows with a null identifier are compared, and reported
with it. Rows equal in identifier and text are reported once. Of windows equally similar to an item the first is named.
Empty tables give an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import BROADCAST_ROWS, materialise, scratch, small_side

SHINGLE, RADIUS, SIMILARITY, BITS = 5, 21, 0.75, 64
BETWEEN = r"[^\\p{L}\\p{M}\\p{N}]+"


# Outer explosions below: for an inner one Spark infers a filter on the array's size and computes words anew in it, per shingle.
def shingled(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep and `sh`, the array of shingle hashes."""
    words = f"array_remove(split(lower({text}), '{BETWEEN}'), '')"
    word = ", ".join(f"get(ws, i + {k})" if k else "get(ws, i)" for k in range(SHINGLE))
    hashes = f"if(size(ws) = 0, CAST(array() AS array<bigint>), transform(sequence(0, greatest(size(ws) - {SHINGLE}, 0)), i -> xxhash64({word})))"
    return df.where(f"{text} IS NOT NULL").selectExpr(*keep, f"{words} AS ws").selectExpr(*keep, f"{hashes} AS sh")


def _fingerprints(df: DataFrame, *keys: str) -> DataFrame:
    """keys and `print`: SimHash over rows of one shingle (column `h`) each. Two counters of 32 bits share a sum."""
    lane = lambda k: f"sum((shiftrightunsigned(h, {2 * k}) & 1L) | shiftleft(shiftrightunsigned(h, {2 * k + 1}) & 1L, 32))"
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.expr(lane(k)).alias(f"s{k}") for k in range(BITS // 2)])
    bit = lambda k: f"shiftleft(CAST(2 * ({f's{k // 2} & 4294967295L' if k % 2 == 0 else f'shiftrightunsigned(s{k // 2}, 32)'}) > n AS bigint), {k})"
    return sums.selectExpr(*keys, f"{' | '.join(bit(k) for k in range(BITS))} AS print")


def _blocks(radius: int) -> str:
    """The fingerprint's radius + 1 blocks, as an array of (number, value)."""
    ends = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return "array(" + ", ".join(f"struct({i} AS no, shiftrightunsigned(print, {a}) & {(1 << (b - a)) - 1}L AS value)" for i, (a, b) in enumerate(zip(ends, ends[1:]))) + ")"


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, with_content: bool = False) -> DataFrame:
    """One row per document and item in it: doc_id, item_id, start_shingle, n_shingles, similarity (of the best window), and content, a hash of the text, if asked for."""
    with scratch(docs.sparkSession):
        verified = materialise(_verified(docs, items, id_col, text_col, item_col, item_text, similarity, radius), "verified", keep=True)
    keys = ["doc_id", "item_id", *(["content"] if with_content else [])]
    best = verified.groupBy(*keys).agg(F.max(F.struct("similarity", F.expr("-s AS before"), "size")).alias("best"))
    return best.selectExpr(*keys, "-best.before AS start_shingle", "best.size AS n_shingles", "best.similarity")


def _verified(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, similarity: float, radius: int) -> DataFrame:
    """doc_id, content, item_id, s, size, similarity of every window that is similar enough to an item."""
    given = items.selectExpr(f"`{item_col}` AS item_id", f"`{item_text}` AS item")
    item = materialise(shingled(given, "item", "item_id").withColumn("m", F.size("sh")).withColumn("no", F.monotonically_increasing_id()), "items")
    rows = item.selectExpr("no", "m", "explode(sh) AS h")
    prints = materialise(_fingerprints(rows, "no", "m"), "item-prints")
    wanted = small_side(rows.select("h", "m").distinct())
    base = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"xxhash64(`{text_col}`) AS content", f"`{text_col}` AS text")
    places = shingled(base, "text", "doc_id", "content").selectExpr("doc_id", "content", "size(sh) AS n", "posexplode_outer(sh) AS (p, h)")
    hits = places.join(wanted, "h").where(F.col("n") / F.col("m") >= similarity)
    # A window of w places has c in common with m shingles if c / (w + m - c) reaches the similarity.
    size, need = "least(n, m)", f"CAST(ceil({similarity} * (least(n, m) + m) / (1 + {similarity}) - 1e-9) AS int)"
    found = hits.groupBy("doc_id", "content", "n", "m").agg(F.array_sort(F.collect_set("p")).alias("ps")).selectExpr("*", f"{size} AS w", f"{need} AS need").where("size(ps) >= need")
    # Between the first and the last of `need` neighbouring hits there must be room for no more than a window.
    runs = found.selectExpr("doc_id", "content", "n", "m", "w", "explode_outer(transform(sequence(0, size(ps) - need), i -> struct(get(ps, i) AS first, get(ps, i + need - 1) AS last))) AS r").where("r.last - r.first < w")
    starts = runs.selectExpr("doc_id", "content", "m", "explode_outer(sequence(greatest(0, r.last - w + 1), least(r.first, n - w))) AS s").distinct()
    starts = materialise(starts, "starts")
    around = starts.groupBy("doc_id", "content").agg(F.collect_list(F.struct("m", "s")).alias("starts")).withColumnsRenamed({"doc_id": "id2", "content": "content2"})
    if starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        around = F.broadcast(around)
    near = base.join(around, F.expr("doc_id <=> id2 AND content = content2")).select("doc_id", "content", "text", "starts")
    cut = shingled(near, "text", "doc_id", "content", "starts").selectExpr("doc_id", "content", "sh", "explode_outer(starts) AS w").selectExpr("doc_id", "content", "w.m", "w.s", "slice(sh, w.s + 1, w.m) AS part")
    windows = materialise(cut.dropDuplicates(["doc_id", "content", "m", "s"]).withColumn("window", F.monotonically_increasing_id()), "windows")
    marked = _fingerprints(windows.selectExpr("window", "m", "explode(part) AS h"), "window", "m")
    left = marked.selectExpr("*", f"explode({_blocks(radius)}) AS b").selectExpr("window", "m", "print", "b.no AS block", "b.value")
    right = prints.selectExpr("*", f"explode({_blocks(radius)}) AS b").selectExpr("no", "m AS m2", "print AS print2", "b.no AS block2", "b.value AS value2")
    met = left.join(small_side(right), F.expr(f"m = m2 AND block = block2 AND value = value2 AND bit_count(print ^ print2) <= {radius}"))
    pairs = materialise(met.select("window", "no").distinct(), "pairs")
    times = lambda df, key: df.groupBy(key, "h").agg(F.count(F.lit(1)).alias(f"times_{key}"))
    of_windows = times(windows.join(pairs.select("window").distinct(), "window", "left_semi").selectExpr("window", "explode(part) AS h"), "window")
    shared = pairs.join(of_windows, "window").join(small_side(times(rows, "no")), ["no", "h"]).groupBy("window", "no").agg(F.sum(F.least("times_window", "times_no")).alias("common"))
    sets = shared.join(windows.selectExpr("window", "doc_id", "content", "m", "s", "size(part) AS size"), "window").join(small_side(item.select("no", "item_id")), "no")
    return sets.withColumn("similarity", F.expr("common / (size + m - common)")).where(F.col("similarity") >= similarity).select("doc_id", "content", "item_id", "s", "size", "similarity")
