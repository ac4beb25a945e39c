"""Near-duplicates and repeated passages against brute force; the index; components."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyward.llm import components, minhash, queries, substring
from tallyward.llm.fmindex import FmIndex

from .helpers import docs, rows


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_copies(seed, groups=12, copies=12, words=80):
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
        for _ in range(copies):
            texts.append(" ".join(base))
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(words)] = f"v{rng.randint(0, 5000)}"
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates(spark, block):
    texts = near_copies(1) + [None, "", "  \n", "One two", "one TWO", "one  two\tthree", "É a b c d", "é a b c d"]
    got = rows(minhash.near_duplicates(docs(spark, texts), block=block))
    want = brute_groups(dict(enumerate(texts)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_many_equal_and_deep_regions(spark, monkeypatch):
    # a chain of copies in regions of many blocks
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(60):
        base[i] = f"x{i}"
        texts.append(" ".join(base))
    got = rows(minhash.near_duplicates(docs(spark, texts * 2), block=4))
    want = brute_groups(dict(enumerate(texts * 2)))
    assert {i: r["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in want.items()}


def test_star_of_many_variants(spark):
    # far more variants than a class has partners or a block holds, 0.86 or 0.90 alike to the base, less to each other
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for k in range(1200):
        variant = list(base)
        for at in rng.sample(range(5, 195, 10), 2 + k % 2):
            variant[at + rng.randrange(5)] = f"v{k}_{at}"
        texts.append(" ".join(variant))
    got = minhash.near_duplicates(docs(spark, texts), block=64).groupBy("component_id").count().collect()
    assert [(r["component_id"], r["count"]) for r in got] == [(0, len(texts))]


def test_dense_template(spark):
    # documents of one template, likeness about 0.7 to 0.95: most pairs are over the estimate, many are no links
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(400):
        own = list(base)
        for at in rng.sample(range(0, 300, 6), rng.choice([2, 3, 5, 7])):
            own[at] = f"v{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
    d = docs(spark, texts)
    got = rows(minhash.near_duplicates(d, block=64))
    want = brute_groups(dict(enumerate(texts)))
    assert {i: r["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in want.items()}
    assert 1 < len({c for _, c in want.values()}) < 399
    classes = minhash.written(minhash._sets(d.select("doc_id", "text")).withColumnRenamed("doc_id", "node"), "classes")
    pairs = minhash.candidates(classes)
    assert pairs.count() <= minhash.PARTNERS * len(texts)
    # each class goes to a region an order, once for every other block
    labelled = classes.select("node", "sig", F.col("node").alias("label"))
    most = minhash.regions(labelled, 64).groupBy("node").count().agg(F.max("count")).first()[0]
    assert most <= minhash.ORDERS * 8


def test_windows_of_an_order():
    key = np.array([[1, 1, 1, 1, 9], [1, 1, 1, 1, 9], [1, 1, 1, 2, 0], [1, 1, 1, 2, 3], [1, 1, 1, 2, 3]], np.uint8)
    rows_ = [(0, bytes(k), i) for i, k in enumerate(key)] + [(1, bytes(key[-1]), 5)]
    t = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_, strict=True)], ["order", "key", "node"])
    for size in (1, 2, 6):
        batches = [t.slice(i, size) for i in range(0, 6, size)]
        got = {tuple(r.values()) for b in minhash.neighbours(iter(batches), window=2, depth=4) for r in b.to_pylist()}
        assert got == {(0, 1, 5), (2, 3, 4), (2, 4, 4), (3, 4, 5)}


def test_blocks_of_a_region_all_meet(spark):
    # one region in every order: each pair of it shares a bucket, and buckets stay small
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 256, minhash.PLACES).astype(np.uint8).tobytes()
    ids = rng.integers(-(2**62), 2**62, 100).tolist()
    reps = spark.createDataFrame([(i, i, bytearray(sig)) for i in ids], "node long, label long, sig binary")
    buckets = {}
    for r in minhash.regions(reps, 2).collect():
        buckets.setdefault((r["order"], r["bucket"]), set()).add(r["node"])
    for order in range(minhash.ORDERS):
        mine = [b for (o, _), b in buckets.items() if o == order]
        assert {(a, b) for m in mine for a in m for b in m} == {(a, b) for a in ids for b in ids}
        assert max(map(len, mine)) < len(ids) / 2


def test_near_duplicate_edges(spark):
    d = docs(spark, [(7, "a b c d e f"), (7, "a b c d e f"), (7, "other words of this id here"), (None, "a b c d e f"), (3, "A B C D E F")]).selectExpr("*", "1 AS cls", "2 AS sig", "3 AS bucket")
    got = minhash.near_duplicates(d).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in got) == [(-1, 2, -1, True), (3, 2, 3, True), (7, 2, 3, False), (7, 2, 3, False), (7, 2, 7, True)]
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def brute_substring(texts, window=50):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def passages(seed, n=60):
    rng = random.Random(seed)
    shared = [[f"p{k}_{rng.randint(0, 40)}" for _ in range(rng.choice([40, 49, 50, 51, 70, 200]))] for k in range(8)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += rng.choice(shared) if rng.random() < 0.6 else [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 60))]
        texts.append("  ".join(parts) if rng.random() < 0.5 else "\n".join(parts))
    return texts + ["a " * 500, "a " * 60, "b " + "a " * 55, None, "", "short text"]


def test_documents_by_sql(spark, sf):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name in ("op1_minhash", "op4_substring"):
        want = duckdb.sql(queries.oracle_sql()[name])
        got = queries.queries()[name](spark, sf).select(want.columns).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall())


@pytest.mark.parametrize(("hot", "shard"), [(16384, 300_000), (2, 300_000), (16384, 200)])
def test_substring(spark, hot, shard):
    texts = passages(3)
    got = rows(substring.substring_dedup(docs(spark, texts), digest=True, split=hot, shard_words=shard))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == brute_substring(dict(enumerate(texts)))


def test_substring_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    d = docs(spark, [(-5, long), (2, long), (2, long), (None, long), (3, "x " + long + " y")]).selectExpr("*", "1 AS rid", "2 AS lost", "3 AS anchor")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 99, r["n_removed"], r["kept"]) for r in substring.substring_dedup(d).collect())
    assert got == [(-5, 0, long), (2, 60, ""), (2, 60, ""), (3, 60, "x y"), (99, 0, long)]
    stripped = substring.strip(d)
    assert stripped.columns == d.columns and {r["text"] for r in stripped.collect()} == {long, "", "x y"}
    assert substring.substring_dedup(d.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=5), st.lists(st.integers(1, 4), max_size=40), st.integers(1, 8))
def test_matching_statistics(texts, query, longest):
    index = FmIndex([np.array(t, np.int64) for t in texts], np.arange(len(texts)), longest)
    stats, owners = index.matching_statistics([np.array(query, np.int64)])
    for i in range(len(query)):
        best, least = 0, -1
        for o, t in enumerate(texts):
            for p in range(len(t)):
                k = 0
                while k < longest and i + k < len(query) and p + k < len(t) and query[i + k] == t[p + k]:
                    k += 1
                best = max(best, k)
                if k == longest and least < 0:
                    least = o
        assert (stats[0][i], owners[0][i]) == (best, least)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200) if i % 40] + [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(40)] + [(500, i) for i in range(501, 700)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_components_end_at_stars(spark, monkeypatch):
    # no round, and no table, only to see that nothing changes
    tables = []
    def noted(df, name, own=components.written):
        tables.append(name)
        return own(df, name)
    monkeypatch.setattr(components, "written", noted)
    for edges, rounds in (([], 0), ([(0, i) for i in range(1, 9)] + [(12, 11)], 0), ([(1, 0), (2, 1)], 1), ([(2, 0), (2, 1)], 1)):
        tables.clear()
        got = {r["node"]: r["label"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {n: (0 if n < 11 else 11) for e in edges for n in e}
        assert tables == ["edges"] + ["stars"] * rounds
