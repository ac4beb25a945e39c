"""Whole-text ids of a ``tokenizers`` file whose pieces never cross ASCII white space.

For such a vocabulary (white space is dropped, every piece ends inside one run of
other characters) a text's ids are the ids of its white-space separated chunks put
together. Arrow splits a group of texts and numbers its distinct chunks; only those are
encoded, and their ids are gathered into one buffer. A chunk of lower-case Latin-1
letters is one piece that normalising leaves alone: all of those are merged at once.
The library encodes the others, but for those that a memo of bounded size has. Texts
that hold the string of a special token go to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Memo, as_bytes, chunks, gathered, spans
from .merges import Merges

#: Bytes of text whose chunks are numbered together.
GROUP = 4 << 20
#: One piece without a change by normalising; longer ones are few and take many steps.
PLAIN = "^[a-zß-öø-ÿ]{1,32}$"
#: A full stop or comma right after an ASCII letter or digit, and last in its chunk, is a piece of its own.
STOPPED, APART = r"([a-z0-9])([.,])([\x09-\x0d\x20]|$)", r"\1 \2\3"
#: How byte-level vocabularies show each byte: printable ones as they are, the others from U+0100 on.
_OWN = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
_SHOWN = {b: chr(b) for b in _OWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_OWN)))}


def _merges(path: str) -> Merges:
    """Merges of a byte-level vocabulary with word ends."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    inner, last = (np.array([vocab[_SHOWN[b] + s] for b in range(256)]) for s in ("", suffix))
    return Merges(inner, last, np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]))


class ChunkTokenizer:
    """Little-endian unsigned 32-bit ids of texts, as ``tokenizers`` gives them without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.merges = _merges(path)
        self.memo = Memo(self._learn, 16 << 20)

    def _learn(self, missing: list[str]) -> list[bytes]:
        ids = [x.ids for x in self.model.encode_batch_fast(missing, add_special_tokens=False)]
        joined = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        return [joined[a:z] for a, z in pairwise([0, *np.cumsum([4 * len(x) for x in ids]).tolist()])]

    def _distinct(self, words: pa.Array) -> tuple[pa.LargeListArray, np.ndarray]:
        """Lists of ids, and the number of the list of each word."""
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        known, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, begin = self.merges.encode(*spans(words.take(pa.array(known)).cast(pa.large_binary())))
        found = self.memo.many(words.take(pa.array(others)).to_pylist())
        ends = begin[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(begin, ends)), pa.array(np.append(ids, np.frombuffer(b"".join(found), "<u4"))))
        number = np.empty(len(words), np.int64)
        number[known], number[others] = np.arange(len(known)), len(known) + np.arange(len(others))
        return lists, number

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their end after each text with a zero in front) of texts without strings of special tokens."""
        # the tokenizer lower-cases, so ASCII capitals are folded first
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), STOPPED, APART))
        words = split.values.dictionary_encode()
        lists, number = self._distinct(words.dictionary)
        got = lists.take(pa.array(number[words.indices.to_numpy()]))
        return got.values.to_numpy(), got.offsets.to_numpy()[split.offsets.to_numpy()]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a large_string array without nulls."""
        special = pa.array(np.zeros(len(texts), bool))
        for s in self.special:
            special = pc.or_(special, pc.match_substring(texts, s, ignore_case=True))  # folding would make one
        whole = set(pc.indices_nonzero(special).to_pylist())
        ids, ends = self._group(pc.if_else(special, pa.scalar("", texts.type), texts) if whole else texts)
        raw = memoryview(ids.tobytes())
        for i, (a, z) in enumerate(pairwise((4 * ends).tolist())):
            yield np.array(self.model.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes() if i in whole else bytes(raw[a:z])


_loaded: dict[str, ChunkTokenizer] = {}


def load(path: str) -> ChunkTokenizer:
    """One tokenizer per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = ChunkTokenizer(path)
    return _loaded[path]


def encode_rows(batches: Iterator[pa.RecordBatch], path: str, most: int = GROUP) -> Iterator[tuple[pa.Array, Iterator[bytes]]]:
    """(first column, ids of the texts in the second) of rows, in groups of about ``most`` bytes of text."""
    model = load(path)
    for rows in gathered(batches, 1, most):
        texts = as_bytes(rows.column(1))
        offsets, _ = spans(texts)
        for lo, hi in chunks(offsets, most):
            yield rows.column(0).slice(lo, hi - lo), model.encode(texts.slice(lo, hi - lo).cast(pa.large_string()))
