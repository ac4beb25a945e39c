"""Edited texts against plain Python; equal texts, graded likeness, ties and edges."""

import collections
import hashlib
import math

import regex
import xxhash
from pyspark.sql import functions as F

from tallyward.llm import imatch, queries

from .helpers import docs, rows


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        k = len(t) // 2
        out.append(hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest())
    return out


def test_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = queries.op5_imatch(spark, sf).orderBy("doc_id").collect()
    texts = [r["text"] or "" for r in d]
    assert [r["edited_sha256"] for r in got] == edited(texts) and [r["n_chars"] for r in got] == [len(t) for t in texts]
    by_text = {}
    for t, r in zip(texts, got, strict=True):
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert sum(r["near_edited"] for r in got) > sum(r["near_next"] for r in got)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 3)
    ids = [5, 900, 901, 7, 8, -40, 10**12, 6, 33, 34, 35, 36, 37]
    texts = {i: f"text {i} " * (k + 1) for k, i in enumerate(ids)}
    got = rows(imatch.fingerprints(docs(spark, [(i, texts[i]) for i in ids])))
    order = sorted(ids)
    assert [got[i]["edited_sha256"] for i in order] == edited([texts[i] for i in order])


def test_edges(spark):
    one = imatch.fingerprints(docs(spark, ["alone in the table"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert imatch.fingerprints(docs(spark, ["x"]).limit(0)).count() == 0
    d = docs(spark, [(None, None), (1, ""), (1, "same"), (2, "😀é" * 5), (2, "😀é" * 5), (3, "... !!")]).selectExpr("*", "1 AS fp", "2 AS n")
    got = imatch.fingerprints(d).collect()
    assert len(got) == 6 and {r["n_chars"] for r in got if r["doc_id"] == 2} == {10}


def test_against_plain_python(spark, sf):
    def h64(data, seed=42):
        return xxhash.xxh64(data, seed).intdigest()

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def terms(text):
        return {signed(h64(w.encode())) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}

    def le(x, n=8):
        return int(x).to_bytes(n, "little", signed=True)

    d = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    texts = [r["text"] or "" for r in d]
    n = collections.Counter(t for x in texts for t in terms(x))
    low, high = imatch.BAND
    cells = {t % imatch.CELLS for t, c in n.items() if low <= math.log(len(texts) / c) <= high}
    assert 0 < len(cells) < len(n)
    masks = imatch._masks()
    assert len(masks) == 24 and all(not (a[1] & b[1]) for i, a in enumerate(masks) for b in masks[:i] if a[0] == b[0])

    def fingerprint(text):
        every = terms(text)
        used = sorted([t for t in every if t % imatch.CELLS in cells] or every)
        out = []
        for name, mask in masks:
            seed, some = 42, False
            for t in used:
                if not h64(le(imatch.SALTS[int(name[1])], 4), h64(le(t))) & mask:
                    seed, some = h64(le(t), seed), True
            out.append(f"{seed:016X}"[-8:] if some else "-")
        return out

    def likeness(a, b):
        if a == b:
            return 1.0
        some = sum(x != "-" or y != "-" for x, y in zip(a, b, strict=True))
        return sum(x == y != "-" for x, y in zip(a, b, strict=True)) / some if some else 0.0

    got = rows(queries.op5_imatch(spark, sf))
    for i, r in enumerate(d[:60]):
        nxt = texts[(i + 1) % len(texts)]
        k = len(texts[i]) // 2
        own, other, mine = fingerprint(texts[i]), fingerprint(nxt), got[r["doc_id"]]
        edit = fingerprint(texts[i][: len(texts[i]) - k] + nxt[:k])
        assert mine["fingerprint"] == ".".join(own) and mine["edited_fingerprint"] == ".".join(edit)
        assert abs(mine["near_edited"] - likeness(own, edit)) < 1e-12 and abs(mine["near_next"] - likeness(own, other)) < 1e-12


def test_outlying_ids(spark, monkeypatch):
    # one id far from all others: the others still spread over ranges
    monkeypatch.setattr(imatch, "RANGE_ROWS", 10)
    d = docs(spark, [(i, f"t {i}") for i in [*range(300), 1 << 60]]).withColumn("tie", F.lit(0))
    plan = imatch.with_next(d, "doc_id", "tie", ["text"])
    got = {r["doc_id"]: r["next_text"] for r in plan.collect()}
    assert got[7] == "t 8" and got[299] == f"t {1 << 60}" and got[1 << 60] == "t 0"
    assert plan.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200
