"""Language, toxicity and quality: held-out accuracy on the small tables, brute-force model values, and edge rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rasterloom.llm import kneser_ney, langid, queries, toxicity

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, "12 34 !! \u00bd \u00b2 \u2167 _"), (None, "the of and"), (5, "the of and"), (6, "the of and " * 60_000), (6, "the of and")]


def test_language_accuracy(spark):
    got = queries.op4_language(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert got.count() == truth.count() and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, docs):
    rows = [("en", "the of and with")] * 30 + [("fr", "le de et avec")] * 30 + [(None, "zzz")]
    model = langid.fit(spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string"))
    assert model.langs == ["en", "fr"]
    out = langid.predict(docs(EDGES + [(7, "withe"), (8, "ave")]).select("doc_id", "text"), model).collect()
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append((r["lang_pred"], round(r["score"], 6)))
    assert by[1] == by[2] == by[3] == [("und", 0.0)] and by[5] == by[None] and {x for x, _ in by[6]} == {"en"} and by[7][0][0] == "en" and by[8][0][0] == "fr"
    none = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.predict(docs(EDGES).select("doc_id", "text"), none).collect()} == {"und"}
    assert langid.predict(docs([]).select("doc_id", "text"), model).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_language_equals_brute_force(spark, docs, seed):
    """Fit and prediction against counts, covers and sums written down plainly."""
    rng = random.Random(seed)
    train = [(i, " ".join("".join(rng.choices("abé" if x == "p" else "bcd", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 30))), x) for i in range(40) for x in "pq"]
    ask = [" ".join("".join(rng.choices("abécdx7 ", k=rng.randint(1, 7))) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    split = lambda t: [w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
    pieces = lambda w, n: [w[i : i + n] for i in range(len(w) - n + 1)]
    counts = []
    for n in (0, 4, 3, 2, 1):
        of = {x: Counter() for x in "pq"}
        for _, t, x in train:
            for w in split(t):
                of[x].update([w] if not n else list(w) if n == 1 else pieces(f"^{w}$", n) or [f"^{w}$"])
        counts.append({x: {k: v for k, v in c.items() if n or v > 1} for x, c in of.items()})
    value = lambda kind, key, x, n: math.log((counts[kind][x].get(key, 0) + 0.5) / (sum(counts[kind][x].values()) + len(set(counts[kind]["p"]) | set(counts[kind]["q"])))) / n

    def expected(t):
        total = {"p": 0.0, "q": 0.0}
        for w in split(t):
            if w in counts[0]["p"] or w in counts[0]["q"]:
                used = [(0, w, 1)]
            else:
                used, padded, free = [], f"^{w}$", set(range(len(w) + 2))
                for kind, n in enumerate((4, 3, 2, 1), 1):
                    for i, g in enumerate(pieces(padded, n)):
                        if free & set(range(i, i + n)) and (g in counts[kind]["p"] or g in counts[kind]["q"]):
                            used.append((kind, g, n))
                            free -= set(range(i, i + n))
            for x in total:
                total[x] += sum(value(kind, key, x, n) for kind, key, n in used)
        best = max("pq", key=lambda x: total[x])
        return ("und", 0.0) if not split(t) else (best, 1 / sum(math.exp(v - total[best]) for v in total.values()))

    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), sample=10**6)
    for r in langid.predict(docs(ask).select("doc_id", "text"), model).collect():
        lang, score = expected(ask[r["doc_id"]])
        assert r["score"] == pytest.approx(score, abs=1e-9) and (r["lang_pred"] == lang or abs(score - 0.5) < 1e-9)


def test_language_cover():
    counts = [{"x": {"known": 5}}, {"x": {"^abc": 2}}, {"x": {"cd$": 1}}, {"x": {"de": 1}}, {"x": {"d": 3}}]
    m = langid.Model(["x"], counts)
    value = lambda i, n: math.log((list(counts[i]["x"].values())[0] + 0.5) / (list(counts[i]["x"].values())[0] + 1)) / n
    assert m.total(list(m.of_word("known")), [1])[0] == pytest.approx(value(0, 1), abs=1e-6)
    assert m.total(list(m.of_word("abcd")), [1, 1])[0] == pytest.approx(value(1, 4) + value(2, 3), abs=1e-6)
    assert m.of_word("zzz") == ()


def test_toxicity_accuracy(spark):
    rows = queries.op8_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang").collect()}
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    share = lambda of: sum(r["predicted"] for r in of) / len(of)
    toxic = [r for r in rows if r["toxic"]]
    assert right > 0.96 and share(toxic) > 0.7 and share([r for r in rows if not r["toxic"]]) < 0.01
    assert all(share([r for r in toxic if langs[r["doc_id"]] == x]) > 0.45 for x in ("en", "de", "fr", "es")) and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_edges(spark, docs):
    rng = np.random.default_rng(5)
    plain = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"], 40))
    rows = [(i, plain() + (" dreadful " + plain() + " horrible" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows] + [(7, None), (None, 1)], "doc_id long, toxic int"))
    out = toxicity.score(docs(EDGES + [(8, plain() + " horrible " + plain()), (9, plain())]).select("doc_id", "text"), model).collect()
    by = {r["doc_id"]: r["predicted"] for r in out}
    assert by[8] == 1 and by[9] == 0 and by[1] == by[2] == 0 and len(out) == len(EDGES) + 2
    none = toxicity.fit(docs([]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs(EDGES).select("doc_id", "text"), none).collect()} == {0.0}
    assert toxicity.score(docs([]).select("doc_id", "text"), model).count() == 0


def test_toxicity_finds_stems_of_each_language(spark, docs):
    """Marks of a language with few rows, whose whole forms hardly recur."""
    rng = np.random.default_rng(7)
    ends = ["al", "be", "ci", "do", "eu", "fa", "gi", "ho", "iu", "ka", "lo", "mi"]
    plain = {x: [f"{x}{a}{b}" for a in ends for b in ends] for x in ("p", "q")}
    forms = [f"zorvik{a}{b}{c}" for a in ends for b in ends for c in ends]
    rows = []
    for i in range(1200):
        x, toxic = ("q" if i % 6 == 0 else "p"), int(i % 4 == 0)
        w = list(rng.choice(plain[x], 90))
        if toxic:
            for at in (80, 50, 20):
                w[at] = rng.choice(forms) if x == "q" else "dreadful"
        rows.append((i, " ".join(w), x, toxic))
    train, test = rows[:900], rows[900:]
    model = toxicity.fit(spark.createDataFrame([r[:3] for r in train], "doc_id long, text string, lang string"), spark.createDataFrame([(r[0], r[3]) for r in train], "doc_id long, toxic int"))
    by = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs([(i, t) for i, t, _, _ in test]).select("doc_id", "text"), model).collect()}
    for x in ("p", "q"):
        caught = [by[i] for i, _, lang, toxic in test if lang == x and toxic]
        clean = [by[i] for i, _, lang, toxic in test if lang == x and not toxic]
        assert sum(caught) / len(caught) > 0.9 and sum(clean) / max(1, len(clean)) < 0.05


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney over byte tuples, straight from its formulas."""
    pads = [bytes(order - 1) + bytes(0x20 if 9 <= b <= 13 else b for b in t.encode()) for t in texts]
    counts = {order: Counter(p[i - order + 1 : i + 1] for p in pads for i in range(order - 1, len(p)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        cut[k] = [min(float(i), max(0.01, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] and n[i] else 0.5 * i for i in (1, 2, 3)]
    of = {k: defaultdict(dict) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            of[k][g[:-1]][g[-1:]] = v

    def p(k, h, w):
        below = p(k - 1, h[1:], w) if k > 1 else 1 / 256
        here = of[k].get(h)
        if not here:
            return below
        less = lambda v: cut[k][min(v, 3) - 1]
        v, total = here.get(w, 0), sum(here.values())
        return (max(0.0, v - less(v)) if v else 0) / total + sum(less(x) for x in here.values()) / total * below

    def logs(text):
        s = bytes(order - 1) + bytes(0x20 if 9 <= b <= 13 else b for b in text.encode())
        return [math.log(p(order, s[i - order + 1 : i], s[i : i + 1])) for i in range(order - 1, len(s))]

    return logs


@pytest.mark.parametrize("shard", [4_000_000, 300, 20])
def test_kneser_ney_equals_its_formulas(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(kneser_ney, "SHARD", shard)
    texts = ["the cat sat on the mat\nand the dog ran", "a cat and a dog sat", "é là ça été", "the the the the"]
    model = kneser_ney.fit(docs(texts))
    assert (model.shards > 1) == (shard <= 300)
    ask = ["the dog sat on a mat", "zzz qqq", "été", "x"]
    got = {r["doc_id"]: r["perplexity"] for r in kneser_ney.perplexities(docs(ask).select("doc_id", "text"), model).collect()}
    logs = brute_model(texts, kneser_ney.ORDER)
    for i, t in enumerate(ask):
        assert got[i] == pytest.approx(math.exp(-np.mean(logs(t))), rel=1e-4)


def test_thresholds_equal_brute_force(spark, docs, monkeypatch):
    """Perplexities, thresholds and decisions of a small table, from the formulas: each half of the trusted under the other half's model."""
    monkeypatch.setattr(kneser_ney, "ENOUGH", 10)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat", "été"], k=rng.randint(1, 12))), rng.choice(["en", "fr", None])) for i in range(60)]
    rows += [(60 + i, "".join(rng.choices("xqz#", k=rng.randint(5, 30))), "en") for i in range(8)] + [(70, None, "en"), (71, "", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = {i for i in range(60) if i % 3}
    got = {r["doc_id"]: r for r in kneser_ney.classify(df, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), quantile=0.9).collect()}
    part = {r["doc_id"]: r["p"] for r in df.selectExpr("doc_id", "pmod(xxhash64(text), 2) AS p").collect()}
    logs = [brute_model([t for i, t, _ in rows if i in trusted and (k == 2 or part[i] == k)], kneser_ney.ORDER) for k in (0, 1, 2)]
    own = {i: logs[1 - part[i]](t) for i, t, _ in rows if i in trusted}
    usual = -sum(map(sum, own.values())) / sum(map(len, own.values()))
    smooth = lambda x: math.exp((-sum(x) + kneser_ney.PRIOR * usual) / (len(x) + kneser_ney.PRIOR))
    rank = lambda v: sorted(v)[max(0, math.ceil(0.9 * len(v)) - 1)]
    by = defaultdict(list)
    for i, _, lang in rows:
        if i in trusted:
            by[lang].append(smooth(own[i]))
    every = rank([v for x in by.values() for v in x])
    for i, t, lang in rows:
        limit = rank(by[lang]) if lang and len(by[lang]) >= 10 else every
        assert got[i]["threshold"] == pytest.approx(limit, rel=1e-3)
        if not t:
            assert got[i]["perplexity"] is None and not got[i]["kept"]
        else:
            value = smooth(logs[2](t))
            assert got[i]["perplexity"] == pytest.approx(value, rel=1e-3) and (got[i]["kept"] == (value <= limit) or abs(value / limit - 1) < 1e-3)
    assert not any(got[60 + i]["kept"] for i in range(8))


def test_quality_keeps_the_trusted(spark):
    rows = queries.op3_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.15


def test_quality_edges(spark, docs):
    trusted = spark.createDataFrame([(i,) for i in range(100, 160)] + [(None,), (100,)], "doc_id long")
    df = docs([(i, f"the of and with number {i} in it") for i in range(100, 160)] + EDGES + [(9, "%%% ### $$$ &&& *** ~~~ ^^^ @@@")])
    rows = kneser_ney.classify(df, trusted).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == df.count() and by[1]["perplexity"] is None and not by[1]["kept"] and not by[2]["kept"] and by[5]["kept"] and not by[9]["kept"]
    assert all(r["kept"] for r in kneser_ney.classify(docs([(1, "x")]), trusted.limit(0)).collect()) and kneser_ney.classify(docs([]), trusted).count() == 0
