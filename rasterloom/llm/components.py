"""Connected components of a distributed edge list by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise, scratch


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_least(both).withColumn("m", F.least("u", "m")), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = large.where("u != v").distinct()
    small = down.join(_least(down), "u")
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for each node with an edge to another; edges of nulls or loops are ignored.

    Every round is written to the shared folder; rounds end when the edges no longer change, after a logarithmic number.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    before = None
    with scratch(edges.sparkSession):
        while True:
            e = materialise(e, "star")
            state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before:
                ends = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")))
                return materialise(ends.distinct(), "components", keep=True)
            before, e = state, _round(e)
