"""BPE against tiktoken, chunked ids against tokenizers, packing against its bounds."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyward.llm import bpe, packing, queries
from tallyward.llm.tokens import ChunkTokenizer

from .helpers import docs, rows

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
MODEL = Tokenizer.from_file(WORDS)
OWN, CHUNKS = bpe.load(RANKS, P.PATTERN), ChunkTokenizer(WORDS)

PIECES = ["a", "the", "ing", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "é", "ß", "Σ", "ς", "中文", "1", "23", "!", "...", ",", "\u0301", "😀", "\x1c", "\x85", "\xa0", "\u2028", "İ", "K", "A.", "क\u094d", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "\x00", "Ünder", "naïve.", "x,", "Thorinsh."]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), st.text(max_size=60)))
def test_same_ids(text):
    ids = OWN.encode(text)
    assert ids == REFERENCE.encode_ordinary(text) and OWN.decode(ids) == text.encode()
    assert next(CHUNKS.encode(pa.array([text], pa.large_string()))) == np.array(MODEL.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_long_pieces_stay_linear():
    for text in ("a" * 30000, "ab" * 10000, " " * 20000, "=-" * 10000, "中" * 10000):
        assert OWN.encode(text) == REFERENCE.encode_ordinary(text)


def test_bpe_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for i, r in rows(queries.op9_bpe(spark, sf)).items():
        ids = REFERENCE.encode_ordinary(texts[i])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


def test_bpe_edges(spark):
    d = docs(spark, [(None, "x"), (1, None), (1, ""), (2, "a  b\n\n c"), (2, "a  b\n\n c")]).selectExpr("*", "1 AS id", "2 AS n_tokens")
    tokens = bpe.encode(d, RANKS, P.PATTERN)
    assert sorted(r["decoded"].decode() for r in bpe.decode(tokens, RANKS, P.PATTERN).collect()) == ["", "", "a  b\n\n c", "a  b\n\n c", "x"]
    assert bpe.digests(d.limit(0), RANKS, P.PATTERN).count() == 0


def check_packed(got, texts, capacity=2048):
    """All pieces are there, sequences are gapless and full at most; returns sequences and their lower bound."""
    ids = [MODEL.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    want = sorted((len(x[k : k + capacity]), zlib.crc32(np.array(x[k : k + capacity], "<u4").tobytes())) for x in ids for k in range(0, len(x), capacity))
    assert sorted((r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    return len(by), -(-sum(n for n, _ in want) // capacity)


def test_packing_documents(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = check_packed(queries.op10_packing(spark, sf).collect(), texts)
    assert used <= least + 3


def test_packing_edges(spark):
    texts = [None, "", "word " * 5000, "same", "same"] + [f"w{i} " * (i % 90) for i in range(400)]
    d = docs(spark, texts).selectExpr("*", "1 AS piece", "2 AS length", "3 AS packer")
    items = packing.pieces(d, WORDS, 64, 0)
    got = packing.pack(items, 64, packer_pieces=100).collect()  # several packers
    used, least = check_packed(got, texts, 64)
    assert used <= least * 1.05 + 8
    assert {tuple(r) for r in packing.pack(items.repartition(7), 64, packer_pieces=100).collect()} == {tuple(r) for r in got}
    assert packing.best_fit(d.limit(0), WORDS).count() == 0


def test_sum_of_squares():
    rng = random.Random(5)
    lengths = np.array(sorted((rng.randint(1, 100) for _ in range(3000)), reverse=True))
    seq, off = packing.sum_of_squares(lengths, 100)
    assert np.bincount(seq, lengths).max() <= 100 and seq.max() + 1 <= -(-lengths.sum() // 100) * 1.02 + 2
    # against the rule, written plainly
    gaps, want = [], []
    for s in lengths[:400].tolist():
        fits = [g for g in set(gaps) if g >= s]
        if fits:
            def total(g, s=s):
                after = list(gaps)
                after.remove(g)
                after += [g - s] if g > s else []
                return sum(after.count(x) ** 2 for x in set(after))
            g = min(fits, key=lambda g: (total(g), g))
            gaps.remove(g)
        else:
            g = 100
        want.append(100 - g)
        gaps += [g - s] if g > s else []
    assert packing.sum_of_squares(lengths[:400], 100)[1].tolist() == want
