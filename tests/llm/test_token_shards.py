"""Round trips of shards; the permutation; edges."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tallyward.llm import token_shards
from tallyward.llm.common import fresh_path

from .helpers import docs

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_feistel(n):
    a, b = token_shards.feistel(np.arange(n), n, 1), token_shards.feistel(np.arange(n), n, 2)
    assert sorted(a.tolist()) == list(range(n)) == sorted(b.tolist())
    assert n < 100 or (a != b).mean() > 0.9 and (a != np.arange(n)).mean() > 0.9


TEXTS = [(i, t) for i, t in enumerate(["", None, "one", "a b c " * 700, "same text", "same text", "Ünïcode 😀 <|endoftext|>"] + [f"number {i} " * (i % 37) for i in range(300)])] + [(None, "no id"), (5, "same text")]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_shards, "BLOCK", 50)
    out = fresh_path(spark, "shards")
    rows = token_shards.write_shards(docs(spark, TEXTS).selectExpr("*", "1 AS slot", "2 AS shard").repartition(5), out, PATH, stride=64, records=100).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and len(rows) > 300
    model = Tokenizer.from_file(PATH)
    want = {}
    for i, t in TEXTS:
        want.setdefault(i, []).append(model.encode(t or "", add_special_tokens=False).ids + [0])
    read = list(token_shards.read_slots(out, 0, len(rows), stride=64, records=100))
    got = {}
    for r in rows:
        ids = read[r["slot"]]
        assert r["shard"] == r["slot"] // 100 and r["position"] == r["slot"] % 100 * 132 and len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        got.setdefault((r["doc_id"], r["start"]), []).append(ids.tolist())
    for i, lists in want.items():
        pieces = sorted(x[k : k + 64] for x in lists for k in range(0, len(x), 64))
        assert pieces == sorted(x for (d, _), xs in got.items() if d == i for x in xs)
    tail = list(token_shards.read_slots(out, 150, 75, stride=64, records=100))
    assert [x.tolist() for x in tail] == [x.tolist() for x in read[150:225]]


def test_empty(spark):
    assert token_shards.write_shards(docs(spark, ["x"]).limit(0), fresh_path(spark, "shards"), PATH).count() == 0
