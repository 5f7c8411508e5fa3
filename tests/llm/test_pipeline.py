"""The pipeline against what its stages' brute-force versions leave, and its contract."""

import inspect

import corpus_pipeline
from rasterloom.llm import bpe
from rasterloom.llm.queries import ORACLE_SQL, QUERIES

from .test_bpe import expected
from .test_decontam import brute as leaks
from .test_exact import brute as copies
from .test_ngram_join import brute as near

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_one_by_one(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    given, kept = rows_of(docs), stages["quality classifier"](spark, docs, SF)
    ids = {d for d, _ in rows_of(kept)}
    assert kept.columns == docs.columns and all(d in ids for d, _ in given if labels.get(d) == 1) and sum(labels.get(d) == 0 for d in ids) < sum(v == 0 for v in labels.values()) / 2

    given, now = rows_of(kept), stages["exact dedup"](spark, kept, SF)
    assert now.columns == docs.columns and sorted(d for d, _ in rows_of(now)) == sorted({k for _, k, _, _ in copies(given)})
    given, after = rows_of(now), stages["n-gram Jaccard join"](spark, now, SF)
    assert after.columns == docs.columns and sorted(d for d, _ in rows_of(after)) == sorted({c for _, _, c in near(given)})
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    given, clean = rows_of(after), stages["benchmark decontamination"](spark, after, SF)
    bad = {d for d, _ in leaks(given, items)}
    assert bad and clean.columns == docs.columns and sorted(d for d, _ in rows_of(clean)) == sorted(d for d, _ in given if d not in bad)
    t = Tokenizer.from_file(bpe.default_vocabulary())
    assert sorted(tuple(r) for r in stages["BPE encoding and decoding"](spark, clean, SF).collect()) == sorted((d, *expected(t, x)) for d, x in rows_of(clean))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((d, *expected(t, x)) for d, x in rows_of(clean))


def test_edge_rows(spark, docs):
    df = docs([(1, None), (2, ""), (3, "a b"), (3, "c d"), (None, "a b"), (None, None)]).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0, name
        out = stage(spark, df, SF)
        assert out.count() <= 6, name
    assert corpus_pipeline.STAGES[1][1](spark, df, SF).count() == 3 and corpus_pipeline.STAGES[2][1](spark, df, SF).count() == 6


def test_contract():
    assert sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0])) and {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
