"""Shards of nearly equal bytes by a k-d tree over row metadata, in DataFrame operations only.

Dimensions are the text's bytes and code points (on a logarithmic scale) and its group's categories (language, source),
by a hash of each, so that a category is one place. A node that has to become m shards is split at the weighted quantile
floor(m/2)/m of its bytes, along the dimension in which it is widest (relative to the whole table). The quantile is found
by histograms over all rows, refined until a bin is negligible; a job handles all nodes of a level, and the driver sees a
bounded number of bins per node.

Rows of equal text take the least of their categories, and coordinates are finished with a hash of the text, so equal
texts stay together; only groups that hold over WHOLE of a shard are dealt by identifier as well.

Nulls: a null text has no bytes, a null category is a category. Equal rows share a shard where their group does, and get
slots of their own. An empty table gives an empty result. Columns that aren't there are no dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise, scratch, small_side

BINS, SCALE = 4096, (1 << 31) - 1
#: A quantile is exact enough if the bin around it has this share of a shard's bytes.
SHARE = 1 / 2000
#: Share of a shard's bytes up to which rows of equal text stay whole; the rows of a larger group still stand together, and only a split that falls among them parts them.
WHOLE = 1 / 25


def _choose(tree, codes: list[str], leaf: Callable[[dict], Column]) -> Column:
    if "split" not in tree:
        return leaf(tree)
    dim, at = tree["split"]
    return F.when(F.col(codes[dim]) < at, _choose(tree["low"], codes, leaf)).otherwise(_choose(tree["high"], codes, leaf))


def _leaves(tree) -> list[dict]:
    return [tree] if "split" not in tree else _leaves(tree["low"]) + _leaves(tree["high"])


def kd_tree(points: DataFrame, dims: Sequence[str], weight: str, tie: str, shards: int) -> tuple[DataFrame, dict]:
    """points with codes c0, c1, ... of its dimensions, and the tree whose leaves have `shards` 1. tie: a column of 32-bit hashes."""
    ends = points.agg(F.sum(weight), *[f(F.coalesce(F.col(d), F.lit(0))).cast("double") for d in dims for f in (F.min, F.max)]).first()
    total, bounds = ends[0] or 0, [(ends[1 + 2 * i] or 0.0, ends[2 + 2 * i] or 0.0) for i in range(len(dims))]
    codes = [f"c{i}" for i in range(len(dims))]
    scaled = [
        (F.floor((F.coalesce(F.col(d).cast("double"), F.lit(lo)) - lo) / ((hi - lo) or 1.0) * SCALE).cast("long") * F.lit(1 << 32) + F.col(tie)).alias(c)
        for d, c, (lo, hi) in zip(dims, codes, bounds)
    ]
    points = points.select("*", *scaled)
    root = {"shards": shards}
    while open_ := [x for x in _leaves(root) if x["shards"] > 1]:
        leaves = _leaves(root)
        for i, x in enumerate(leaves):
            x["no"] = i
        node = _choose(root, codes, lambda x: F.lit(x["no"]))
        here = points.withColumn("node", node).where(F.col("node").isin([x["no"] for x in open_]))
        spread = {r["node"]: r for r in here.groupBy("node").agg(F.sum(weight).alias("w"), *[f(c).alias(f"{f.__name__}_{c}") for c in codes for f in (F.min, F.max)]).collect()}
        for x in open_:
            r = spread.get(x["no"])
            width = [(r[f"max_{c}"] - r[f"min_{c}"]) if r else 0 for c in codes]
            x["dim"] = width.index(max(width))
            x["lo"], x["hi"] = (r[f"min_{codes[x['dim']]}"], r[f"max_{codes[x['dim']]}"] + 1) if r else (0, 1)
            x["want"], x["below"], x["in"] = (r["w"] if r else 0) * (x["shards"] // 2) / x["shards"], 0, r["w"] if r else 0
        while busy := [x for x in open_ if x["in"] > total / shards * SHARE and x["hi"] - x["lo"] > 1]:
            of = {x["no"]: x for x in busy}
            for x in busy:
                x["step"] = -(-(x["hi"] - x["lo"]) // BINS)
            pick = lambda k: F.element_at(F.array(*[F.lit(of.get(i, {}).get(k, 0)).cast("long") for i in range(len(leaves))]), F.col("node") + 1)
            code = F.element_at(F.array(*[F.col(c) for c in codes]), (pick("dim") + 1).cast("int"))
            binned = here.where(F.col("node").isin(list(of))).withColumns({"code": code, "lo": pick("lo"), "hi": pick("hi"), "step": pick("step")}).where("code >= lo AND code < hi")
            for no, x in of.items():
                x["bins"] = {}
            for r in binned.groupBy("node", F.expr("(code - lo) DIV step").alias("bin")).agg(F.sum(weight).alias("w"), F.min("code").alias("least"), F.max("code").alias("most")).collect():
                of[r["node"]]["bins"][r["bin"]] = (r["w"], r["least"], r["most"] + 1)
            for x in busy:
                for k in sorted(x["bins"]):
                    x["in"], x["lo"], x["hi"] = x["bins"][k]  # no further than its rows reach
                    if x["below"] + x["in"] >= x["want"]:
                        break
                    x["below"] += x["in"]
        for x in open_:
            after = x["below"] + x["in"] - x["want"] < x["want"] - x["below"]
            m = x["shards"] // 2
            x |= {"split": (x["dim"], x["hi"] if after else x["lo"]), "low": {"shards": m}, "high": {"shards": x["shards"] - m}}
    return points, root


def shard_by_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: Sequence[str] = ("lang", "source"), shards: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null: this law doesn't grow)."""
    with scratch(df.sparkSession):
        placed = _placed(df, id_col, text_col, categories, shards, overhead)
    sizes = placed.groupBy("shard", "block").count()
    before = sizes.select("shard", "block", (F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32"))
    return placed.withColumn("nth", nth).join(small_side(before), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _placed(df: DataFrame, id_col: str, text_col: str, categories: Sequence[str], shards: int, overhead: int) -> DataFrame:
    """doc_id, size, text_crc32, shard, block: blocks of a shard are numbered each on its own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = lambda h: F.pmod(h, F.lit(1 << 32))
    kinds = [f"k{i}" for i, c in enumerate(c for c in categories if c in df.columns)]
    rows = materialise(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.char_length(text).alias("points"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("content"),
            *[low(F.xxhash64(c)).alias(k) for k, c in zip(kinds, (c for c in categories if c in df.columns))],
        ),
        "metadata",
    )
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    groups = rows.groupBy(F.col("content").alias("group")).agg(F.sum("size").alias("bytes"), *[F.min(k).alias(f"of_{k}") for k in kinds])
    large = F.col("bytes") > (total or 0) / shards * WHOLE
    tied = rows.join(groups, F.col("content") == F.col("group")).select(
        "doc_id", "size", "text_crc32", "content", F.log1p("size").alias("bytes"), F.log1p("points").alias("points"), *[F.col(f"of_{k}").alias(k) for k in kinds],
        F.when(large, F.pmod(F.xxhash64("content"), F.lit(1 << 16)) * (1 << 16) + F.pmod(F.xxhash64("doc_id", "content"), F.lit(1 << 16))).otherwise(low(F.xxhash64("content"))).alias("tie"),
    )
    points, tree = kd_tree(materialise(tied, "tied"), ["bytes", "points", *kinds], "size", "tie", shards)
    codes = [f"c{i}" for i in range(2 + len(kinds))]
    leaves = _leaves(tree)
    for i, x in enumerate(leaves):
        x["no"] = i
    blocks = max(1, count // shards // 5000)
    placed = points.select(
        "doc_id", "size", "text_crc32", _choose(tree, codes, lambda x: F.lit(x["no"])).alias("shard"), F.pmod(F.xxhash64("doc_id", "content"), F.lit(blocks)).alias("block")
    )
    return materialise(placed, "placed", keep=True)
