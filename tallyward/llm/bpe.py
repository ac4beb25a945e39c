"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Vocabulary bytes are mapped to Latin-1 characters, so pyahocorasick can hold them.
Each piece of the split pattern is encoded alone: at every position the longest
vocabulary entry is tried first; an entry is kept only if it is compatible with the
one before it, that is if the merges would not have chosen a token across their
border. Where nothing fits, the last entry is taken back and a shorter one tried;
positions found dead are remembered, so each is left once and time stays linear.
Compatibility of two adjacent ids is memoised.

Arrow cuts a group of texts at blanks and numbers the distinct chunks; only those are
encoded, and their ids gathered. Ids are decoded the same way: their bytes are gathered.

Edge cases: null or empty text gives no ids (digests of the empty string); a null id
column is passed through; rows are independent, so ties, repeats and extra columns
change nothing; lone surrogates cannot occur in Spark strings. Memory beside the
vocabulary: three memos of bounded bytes, of which long chunks take no part, and one
group of texts with its ids.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Memo, as_bytes, chunks, gathered, spans

#: Pairs of ids whose compatibility is kept, before they are forgotten.
PAIRS = 250_000
#: Bytes of text whose chunks are numbered together.
GROUP = 8 << 20
#: A blank inside a run of Unicode white space.
_INNER = r" [\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class _Pairs(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= PAIRS:
            self.clear()
        out = self[key] = self.make(key)
        return out


class Bpe:
    """Encoder and decoder for a file of merge ranks (base64 bytes, rank)."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.length = [len(t) for t in self.bytes]
        # tiktoken's white space is the Unicode property
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.pair: dict[tuple[int, int], int] = {}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(self.size)]
        self._fits = _Pairs(self._compatible)
        self.pieces = Memo(lambda missing: [array("i", self.encode_piece(p.encode())).tobytes() for p in missing], 48 << 20)
        self.chunks = Memo(self._chunks, 48 << 20)
        self.decoded = pa.array(self.bytes, pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in range(self.size)], pa.large_binary())
        automaton = ahocorasick.Automaton()
        for rank, token in enumerate(self.bytes):
            if token and (len(token) == 1 or self._learn(rank, token)):
                automaton.add_word(token.decode("latin-1"), rank)
        automaton.make_automaton()
        self.matches = automaton.iter
        self.longest = automaton.iter_long

    def _learn(self, rank: int, token: bytes) -> bool:
        """Find the merge that makes this token; without one the merges never produce it."""
        for cut in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if a is not None and b is not None and a < rank and b < rank and self._compatible((a, b)):
                self.pair[a, b] = rank
                self.split[rank] = (a, b)
                return True
        return False

    def _compatible(self, both: tuple[int, int]) -> bool:
        """Whether merging leaves the border between two tokens alone."""
        left, right = both
        limit = self.size
        pair, split = self.pair, self.split
        while True:
            joined = pair.get((left, right))
            if joined is not None and joined < limit:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    limit, inner = left, split[left][1]
                    if inner != left:
                        left = inner
                        break
                else:
                    limit, inner = right + 1, split[right][0]
                    if inner != right:
                        right = inner
                        break
                undo_left = not undo_left
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of the split pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        chars, fits = piece.decode("latin-1"), self._fits
        greedy = [rank for _, rank in self.longest(chars)]
        if all(map(fits.__getitem__, pairwise(greedy))):
            return greedy  # compatible throughout: the only such cut is the one that the merges make
        n = len(piece)
        at: list[list[int]] = [[] for _ in range(n)]
        length = self.length
        for end, rank in self.matches(chars):
            at[end - length[rank] + 1].append(rank)  # shorter ones come first: they end earlier
        live = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        tried: list[int] = []  # for each id kept: how many candidates of its place are left
        pos, left = 0, len(at[0])
        while pos < n:
            options, last = at[pos], out[-1] if out else -1
            while left:
                left -= 1
                rank = options[left]
                end = pos + length[rank]
                if live[end] and (last < 0 or fits[last, rank]):
                    out.append(rank)
                    tried.append(left)
                    pos = end
                    left = len(at[pos]) if pos < n else 0
                    break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                live[pos] = 0
                pos -= length[out.pop()]
                left = tried.pop()
        return out

    def _split(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each cut by the pattern as a whole."""
        cut = list(map(self.find, texts))
        names = list(dict.fromkeys(chain.from_iterable(cut)))
        ids = dict(zip(names, self.pieces.many(names), strict=True))
        return [b"".join(map(ids.__getitem__, c)) for c in cut]

    def _chunks(self, missing: list[str]) -> list[bytes]:
        # most chunks are a blank and more: in a row, the pattern cuts them before each blank
        row = [c for c in missing if len(c) > 1 and c[0] == " "]
        cut = self.find("".join(row))
        names = list(dict.fromkeys(cut))
        ids = dict(zip(names, self.pieces.many(names), strict=True))
        starts = [i for i, p in enumerate(cut) if p[0] == " "]
        parts = list(map(ids.__getitem__, cut))
        done = dict(zip(row, (parts[a] if z == a + 1 else b"".join(parts[a:z]) for a, z in pairwise([*starts, len(cut)])), strict=True))
        rest = [c for c in missing if c not in done]
        done.update(zip(rest, self._split(rest), strict=True))
        return [done[c] for c in missing]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their end after each text with a zero in front) of a large_string array without nulls."""
        inner = pc.match_substring_regex(texts, _INNER)
        whole = pc.indices_nonzero(inner).to_numpy().astype(np.int64)
        split = pc.split_pattern(pc.if_else(inner, pa.scalar("", texts.type), texts), " ")
        bounds = split.offsets.to_numpy()
        # the first chunk of a text has no blank in front, all others have
        head = np.zeros(len(split.values), bool)
        head[bounds[:-1]] = True
        rest = split.values.filter(pa.array(~head)).dictionary_encode()
        first = split.values.filter(pa.array(head)).dictionary_encode()
        found = self.chunks.many([" " + x for x in rest.dictionary.to_pylist()])
        found += self.chunks.many(first.dictionary.to_pylist())
        found += self._split(texts.take(pa.array(whole)).to_pylist())
        number = np.empty(len(head), np.int64)
        number[~head] = rest.indices.to_numpy()
        number[head] = first.indices.to_numpy() + len(rest.dictionary)
        number[bounds[whole]] = np.arange(len(found) - len(whole), len(found))
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        got = pa.LargeListArray.from_arrays(pa.array(begin), pa.array(np.frombuffer(b"".join(found), np.int32))).take(pa.array(number))
        return got.values.to_numpy(), got.offsets.to_numpy()[bounds]

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text."""
        return self.encode_column(pa.array([text or ""], pa.large_string()))[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_loaded: dict[tuple[str, str], Bpe] = {}


def load(path: str, pattern: str) -> Bpe:
    """One encoder per Python worker and vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(path, pattern)
    return _loaded[path, pattern]


def _groups(bpe: Bpe, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(first column, ids, ends) of the texts in the second column, in groups of bounded size."""
    for rows in gathered(batches, 1, GROUP):
        texts = as_bytes(rows.column(1))
        for lo, hi in chunks(spans(texts)[0], GROUP):
            yield rows.column(0).slice(lo, hi - lo), *bpe.encode_column(texts.slice(lo, hi - lo).cast(pa.large_string()))


def _joined(of: pa.Array, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """(ends, bytes) of what ``of`` has for each id."""
    offsets, data = spans(of.take(pa.array(ids)))
    return offsets[ends], memoryview(data)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, ends in _groups(load(path, pattern), batches):
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([keys, lists], ["id", "token_ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, token_ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, decoded binary) of every list of ids; null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            lists = b.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            ends, raw = _joined(bpe.decoded, pc.list_flatten(lists).to_numpy(), np.concatenate([[0], np.cumsum(sizes)]))
            out = [bytes(raw[a:z]) for a, z in pairwise(ends.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass, so that ids never cross into the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        sha = hashlib.sha256
        for keys, ids, ends in _groups(bpe, batches):
            at, raw = _joined(bpe.decimal, ids, ends)
            listed = [sha(raw[a : max(a, z - 1)]).hexdigest() for a, z in pairwise(at.tolist())]  # without the last comma
            at, raw = _joined(bpe.decoded, ids, ends)
            decoded = [sha(raw[a:z]).hexdigest() for a, z in pairwise(at.tolist())]
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(ends)), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
