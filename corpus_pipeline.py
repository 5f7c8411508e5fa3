"""Corpus pipeline over documents: quality, exact copies, near copies, benchmark passages, then token ids.

A stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns documents' columns (the last
one its digests); its result is written as Parquet and read again as the next one's docs. Decisions are applied by
identifier and text, so rows that share an identifier but not a text are judged each on its own, and null identifiers
and texts are handled like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, decontam, exact, kneser_ney, ngram_join
from rasterloom.llm.common import delete, materialise, scratch, small_side, table, written


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but the rows that `dropped` (doc_id, content: hash of the text) names."""
    gone = materialise(dropped.select(F.col("doc_id").alias("gone_id"), F.col("content").alias("gone_content")).distinct(), "dropped")
    return docs.join(small_side(gone), docs.doc_id.eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs.text) == F.col("gone_content")), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted model is within their language's threshold."""
    judged = kneser_ney.classify(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return _without(docs, judged.where("NOT kept"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    return exact.exact_dedup(docs, carry=True).where("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest identifier of each group that links of 0.75 or more connect."""
    groups = ngram_join.jaccard_components(docs, with_content=True)
    return _without(docs, groups.where("doc_id != component_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of 0.75 or more to a benchmark item."""
    return _without(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark"), with_content=True))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and digests of token ids, and of the text decoded from them."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", token_ids),
]
#: The first and the last stage have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs, path = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
