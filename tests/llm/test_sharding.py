import random
import zlib
from collections import defaultdict

import pytest

from rasterloom.llm.sharding import kd_tree, shard_by_bytes


def texts(kind):
    rng = random.Random(7)
    if kind == "mixed":
        return [(i, "".join(rng.choices("abc é", k=rng.randint(0, 900)))) for i in range(3000)] + [(i, f"copy {i % 40} " * 30) for i in range(3000, 3400)]
    if kind == "hot":
        return [(i, "one hot text " * 20) for i in range(1500)] + [(i, "".join(rng.choices("abc", k=200))) for i in range(1500, 4000)]
    return {"empty table": [], "few": [(1, None), (None, ""), (2, "a"), (2, "a"), (3, None)]}[kind]


@pytest.mark.parametrize("kind", ["empty table", "few", "mixed", "hot"])
def test_law_and_slots(docs, kind):
    rows = texts(kind)
    got = shard_by_bytes(docs(rows)).collect()
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    slots, load, homes = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if len(rows) > 100:
        mean = sum(load.values()) / 24
        assert len(load) == 24 and max(load.values()) < 1.05 * mean and min(load.values()) > 0.95 * mean
        assert sum(len(h) > 1 for h in homes.values()) <= (1 if kind == "hot" else 0)


@pytest.mark.parametrize("seed", range(3))
def test_tree_equals_brute_force(spark, seed):
    """Every split is along the widest dimension, where the weights on both sides are as near to their due as rows allow."""
    rng = random.Random(seed)
    given = [(float(rng.choice([1, 2, 50, rng.randint(1, 1000)])), rng.choice([0, 0, 7, 9, None]), rng.randint(1, 90), rng.randrange(1 << 32)) for _ in range(2000)]
    shards = rng.choice([5, 24, 13])
    points, tree = kd_tree(spark.createDataFrame(given, "x double, y int, w int, tie long"), ["x", "y"], "w", "tie", shards)
    rows = [((r["c0"], r["c1"]), r["w"]) for r in points.collect()]
    ends = [(min(v), max(v)) for v in ([r[0] for r in given], [r[1] or 0 for r in given])]
    scaled = lambda v, d: int((v - ends[d][0]) / (ends[d][1] - ends[d][0]) * ((1 << 31) - 1))
    assert sorted(c for c, _ in rows) == sorted(tuple((scaled(v or 0, d) << 32) + r[3] for d, v in enumerate(r[:2])) for r in given)
    total = sum(w for _, w in rows)

    def check(node, inside):
        if node["shards"] == 1:
            assert "split" not in node
            return 1
        dim, at = node["split"]
        width = [max(c[d] for c, _ in inside) - min(c[d] for c, _ in inside) for d in (0, 1)]
        assert width[dim] == max(width)
        low, high = [x for x in inside if x[0][dim] < at], [x for x in inside if x[0][dim] >= at]
        due = sum(w for _, w in inside) * (node["shards"] // 2) / node["shards"]
        got = sum(w for _, w in low)
        order, below, best = sorted((c[dim], w) for c, w in inside), 0, due
        for _, w in order:
            below += w
            best = min(best, abs(below - due))
        assert abs(got - due) <= best + total / shards / 2000 and node["low"]["shards"] == node["shards"] // 2
        return check(node["low"], low) + check(node["high"], high)

    assert check(tree, rows) == shards


def test_splits_are_on_metadata(spark):
    """On the driver's documents no split needs the tie."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = shard_by_bytes(docs).select("doc_id", "shard").join(docs, "doc_id").collect()
    pure = defaultdict(set)
    for r in got:
        pure[r["shard"]].add((r["lang"], r["source"]))
    assert len(got) == docs.count() and sum(len(x) for x in pure.values()) < 24 * len(set().union(*pure.values()))


def test_very_long_and_without_categories(spark):
    rows = [(i, "x" * (3_000_000 if i == 7 else i)) for i in range(300)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == [(i, len(t) + 8) for i, t in rows] and {r["shard"] for r in got} <= set(range(24))
