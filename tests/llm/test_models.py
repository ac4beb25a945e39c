"""Held-out accuracy of the trained models; search against brute force; the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.llm import langid, queries, topk, toxicity

from .helpers import docs, rows

SF = "/root/testdata/sf0.01"


def test_language(spark):
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows(queries.op6_langid(spark, SF))
    held = [i for i in want if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == len(want) and {i for i, r in got.items() if r["held_out"]} == set(held)
    assert np.mean([got[i]["lang_pred"] == want[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_sample(spark):
    """Copies do not use up the bound, and a rare language is in the sample whatever its hashes."""
    copies = [(f"copy {i % 3}", "en") for i in range(600)]
    many = [(f"text {i}", "en") for i in range(300)]
    rare = [(f"rare {i}", "xx") for i in range(3)]
    d = spark.createDataFrame(copies + many + rare, "text string, lang string")
    texts, langs = langid.sample(d, "text", "lang", 100)
    assert len(set(texts)) == len(texts) == 100 and langs.count("xx") == 3
    assert (texts, langs) == langid.sample(d.repartition(7), "text", "lang", 100)


def test_language_edges(spark):
    d = docs(spark, [(1, None), (2, ""), (3, "123 ... !!"), (None, "the words"), (5, "the words " * 30000), (5, "²ⅷ")]).selectExpr("*", "1 AS held_out", "2 AS score")
    got = langid.identify(d).collect()
    assert len(got) == 6 and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    none = langid.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}  # nothing to learn from
    assert langid.identify(d.limit(0)).count() == 0


def test_rejection_is_calibrated():
    rng = np.random.default_rng(0)
    sounds = {"a": "ka ri to mu ne", "b": "stra blen gorf tul wix"}
    make = lambda lang, n: " ".join("".join(rng.choice(sounds[lang].split(), 2)) for _ in range(n))
    langs = ["a", "b"] * 100
    model = langid.train([make(x, 20) for x in langs], langs)
    import pyarrow as pa

    p = langid.probabilities(model, pa.array([make("a", 20), make("b", 20), "qqqq zzzz"]))
    assert p[0].argmax() == 0 and p[1].argmax() == 1 and p[2].max() < p[0].max()


def test_toxicity(spark):
    """Trained on half of the labels, held against the other half."""
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.chain_for(d, labels.where("doc_id % 2 = 0"))
    got = rows(toxicity.score(d.join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id"), chain))
    want = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 2 = 1").collect()}
    hit = sum(got[i]["rejected"] for i, t in want.items() if t)
    wrong = sum(got[i]["rejected"] for i, t in want.items() if not t)
    assert hit >= 0.85 * sum(want.values()) and wrong <= 0.01 * len(want)
    assert all(0 <= r["p_toxic"] <= 1 and 0 <= r["p_low_quality"] <= 1 for r in got.values())


def test_chain_feeds_on_earlier_odds():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 2, 400)
    two = np.where(rng.random(400) < 0.95, one, 1 - one)
    texts = [f"marker{'yes' if a else 'no'} filler{k % 7} id{k}" for k, a in enumerate(one)]
    chain = toxicity.train(texts, list(zip(one.tolist(), two.tolist(), strict=True)), ["one", "two"])
    assert chain[1].earlier[0] > 0.1 and toxicity.predict_one(chain, "markeryes")[1] > 0.7 > 0.3 > toxicity.predict_one(chain, "markerno")[1]


def test_toxicity_edges(spark):
    d = docs(spark, [(1, None), (2, ""), (None, "words"), (4, "words"), (4, "words")]).selectExpr("*", "1 AS p_toxic", "2 AS rejected")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.chain_for(d, labels)
    assert toxicity.score(d, chain).count() == 5 and toxicity.clean(d, chain).count() == 5 and toxicity.clean(d, chain).columns == d.columns
    some = spark.createDataFrame([(1, 1, None), (2, None, 1), (4, 1, 0), (None, 0, 1)], labels.schema)
    assert toxicity.clean(d, toxicity.chain_for(d, some)).count() == 5
    assert toxicity.score(d.limit(0), chain).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("blocks", [(8192, 512), (16, 3)])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "PART", blocks[1])
    rng = np.random.default_rng(4)
    v = [[float(x) for x in rng.integers(-3, 4, 8) / 8] for _ in range(120)]
    v[3] = v[50] = v[100]  # ties
    data = [(i, x, 0) for i, x in enumerate(v)] + [(200, None, 0), (250, [None] * 8, 0), (300, [float("nan")] * 8, 0), (350, [float("inf")] * 8, 0), (None, v[0], 0), (50, v[7], 1), (400, [0.5], 0), (450, [], 0)]
    d = spark.createDataFrame(data, VECTORS)
    got = {}
    for r in topk.top_k(d, d.where("vec_id % 50 = 0"), block=blocks[0]).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.floor(256 * np.array(x)).astype(int)) for i, x, _ in data if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)]
    for q in {i for i, _ in good if i % 50 == 0} - {50}:
        mine = next(x for i, x in good if i == q)
        want = sorted((-int(mine[: min(len(mine), len(x))] @ x[: min(len(mine), len(x))]), i) for i, x in good if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)], q
    assert topk.top_k(d.limit(0), d.limit(0)).count() == 0


def test_near_duplicates_row_by_row(spark):
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near = a + " end"
    texts = [(1, a), (2, near), (2, b), (2, b), (None, near), (None, "c d e f g h"), (None, "c d e f g h"), (5, None), (5, None), (6, "")]
    d = docs(spark, texts).selectExpr("*", "1 AS cls", "2 AS sig", "3 AS label", "4 AS node")
    kept = corpus_pipeline.drop_near_duplicates(spark, d, SF)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == sorted([(1, a), (2, b), (-1, "c d e f g h"), (5, ""), (5, ""), (6, "")])
    assert corpus_pipeline.drop_near_duplicates(spark, d.limit(0), SF).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "secrets", "packing"]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = [d.count()], d.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.written(stage(spark, d, SF), "stage")
        if k < 4:
            assert out.columns == columns and out.where("n_chars <> length(text)").count() == 0
        d = out
        seen.append(d.count())
    assert seen[0] > seen[1] > seen[2] == seen[3] == seen[4]
    assert d.select("doc_id").distinct().count() == seen[4]
