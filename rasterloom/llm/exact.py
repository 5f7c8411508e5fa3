"""Exact dedup by a content sort, in DataFrame operations only.

Rows are range-partitioned by sampled splitters of their normalised text (of its first PREFIX characters and a hash of
the rest, so that samples stay small and texts with a common beginning are spread), sorted (externally, where memory is
short), and equal texts stand next to each other; the window's full comparison of neighbours tells where a group ends. A text
that more rows have than a part of the table's partitions should hold is dealt into several neighbouring runs, whose
few winners are compared afterwards.

Nulls: a null text counts as empty, so null, empty and all-white-space texts are one group. A null identifier sorts
last among equals. Rows equal in identifier and text are ties: one of them is kept. An empty table gives an empty
result. Only the two named columns (and those carried) are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise, partitions

PREFIX = 48
WHITE_SPACE = r"[\x20\x09-\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (and the input row as `row`, if carried).

    Of equal texts the row with the most code points in its original text stays, then the smallest identifier.
    """
    spark = df.sparkSession
    n = partitions(spark)
    base = df.select(
        F.col(id_col).alias("doc_id"),
        normalised(F.col(text_col)).alias("norm"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
        *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []),
    )
    # A text with over a quarter of a partition's mean rows is dealt into runs; there are 4 n of them at most.
    most = max(256, df.count() // (4 * n))
    hot = (
        base.groupBy(F.xxhash64("norm").alias("h")).count().where(F.col("count") > most)
        .select("h", F.ceil(F.col("count") / most).alias("runs"))
    )
    dealt = (
        base.withColumn("h", F.xxhash64("norm"))
        .join(F.broadcast(hot), "h", "left")
        .withColumn("run", F.when(F.col("runs").isNotNull(), F.pmod(F.xxhash64("doc_id", "points"), "runs")).otherwise(F.lit(0)))
        .withColumn("begin", F.substring("norm", 1, PREFIX))
        .repartitionByRange(n, "begin", "h", "run")
    )
    same = Window.partitionBy("begin", "h", "run", "norm")
    order = same.orderBy(F.col("points").desc(), F.col("doc_id").asc_nulls_last())
    runs = dealt.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.row_number().over(order).alias("nth"),
        F.first(F.struct("points", "doc_id")).over(order).alias("best"),
        F.count(F.lit(1)).over(same).alias("size"),
        F.col("runs").isNotNull().alias("hot"),
        "run",
        *(["row"] if carry else []),
    )
    runs = materialise(runs, "content-sort")
    # One row per run of a hot text: 4 n of them per 4 n runs' worth of rows, so this side is bounded by 8 n rows.
    firsts = runs.where(F.col("hot") & (F.col("nth") == 1))
    of_all = firsts.groupBy(F.col("text_sha256").alias("of_sha")).agg(
        F.min(F.struct((-F.col("best.points")).alias("p"), F.col("best.doc_id").isNull().alias("z"), F.col("best.doc_id").alias("doc_id"), F.col("run").alias("run"))).alias("top"),
        F.sum("size").alias("total"),
    )
    joined = runs.join(F.broadcast(of_all), (F.col("text_sha256") == F.col("of_sha")) & F.col("hot"), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("hot"), F.col("top.doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("total", "size").cast("long").alias("group_size"),
        ((F.col("nth") == 1) & (~F.col("hot") | (F.col("run") == F.col("top.run")))).alias("kept"),
        "text_sha256",
        *(["row"] if carry else []),
    )


ORACLE = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w AS nth
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM g
"""
