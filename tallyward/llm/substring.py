"""Substring dedup with a compressed FM-index per shard.

A window is ``window`` consecutive words. Words covered by a window that also starts in
a document with a smaller id are removed; windows are judged on the input alone.

1. Every window names one of its short word runs, the one with the smallest hash, as
   its anchor. Equal windows have equal anchors, so they can be looked for anchor by
   anchor. Consecutive windows with one anchor form a stretch.
2. Anchors met in one document only are left: their windows are nowhere else. Stretches
   of an anchor that very many stretches have are cut again, by further anchors of every
   window (the smallest of other hashes of its runs), which equal windows share as well;
   there are the more of them, the more stretches an anchor has.
3. A stretch whose words another one has, too, is lost as a whole unless its document is
   the smallest of them: that takes a digest of each stretch and partial aggregation.
4. The words of the first ones go to shards by anchor. A shard builds an FM-index (see
   :mod:`fmindex`) over its distinct stretches and streams them through it by backward
   search: the matching statistics give the places where a whole window matches, and the
   suffix interval its smallest document.
5. Intervals above the threshold come back to their documents, which drop the words.

Nothing is compared in pairs: a shard's work is linear in its distinct words, and shards
are cut at a bounded number of words; copies of a stretch never meet in one task.

Edge cases: null or empty text has no words and is kept as it is; texts shorter than a
window lose nothing; rows with a null id take no part and lose nothing; rows that share
an id are judged alike and never remove each other's words; repeats inside one document
stay; columns named like those made here do not clash, as only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, as_bytes, chunks, mix, runs, slices, spans, words, written
from .fmindex import FmIndex

#: Words of a window, and of the run that serves as anchor.
WINDOW, ANCHOR = 50, 8
#: Words of a shard, about.
SHARD_WORDS = 300_000
#: Stretches of one anchor beyond which they are cut by a second one, and how many times as many for each further one.
SPLIT, STEP = 256, 32


def _least(h: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The smallest hash of the short runs in each window."""
    n = len(h) - window + 1
    low = runs(h, anchor)
    span, need = 1, window - anchor + 1
    while span * 2 <= need:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:n], low[need - span : need - span + n])


def stretches(h: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, anchor hash) of each stretch; ``first``: each text's first word."""
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, U64)
    low = _least(h, window, anchor)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    valid = np.arange(n) + window <= first[text + 1]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, np.zeros(0, U64)
    low, text = low[at], text[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    return text[begin], at[begin], np.diff(np.append(begin, len(at))), low[begin]


def _flagged(windows: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word intervals [start, end) covered by the flagged windows, in order."""
    at = np.flatnonzero(windows)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > window)
    begin, end = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + window
    return list(zip(begin.tolist(), end.tolist(), strict=True))


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            offsets, data = spans(as_bytes(b.column("text")))
            for lo, hi in chunks(offsets):
                h, first, *_ = words(offsets[lo : hi + 1], data, lower=False)
                text, _, _, low = stretches(h, first, window, anchor)
                if len(text):
                    at = pa.array(text + lo)
                    no = np.arange(len(text)) - np.searchsorted(text, text)
                    yield pa.RecordBatch.from_arrays([b.column("rid").take(at), b.column("doc_id").take(at), pa.array(low.view(np.int64)), pa.array(no.astype(np.int32))], ["rid", "doc_id", "anchor", "no"])

    return docs.mapInArrow(run, "rid binary, doc_id long, anchor long, no int")


def _segments(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """The wanted stretches with their digest. Of equal ones in a batch, those of the smallest document carry their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            b = b.filter(b.column("wanted").is_valid())
            wanted, levels, docs_ = (b.column(c).to_pylist() for c in ("wanted", "levels", "doc_id"))
            offsets, data = spans(as_bytes(b.column("text")))
            for lo, hi in chunks(offsets):
                h, first, s, e, raw = words(offsets[lo : hi + 1], data, lower=False)
                text, begin, count, low = stretches(h, first, window, anchor)
                if not len(text):
                    continue
                view, row, pos, size, mine, keys, bodies = memoryview(raw), [], [], [], [], [], []
                least: dict[tuple[int, bytes], int] = {}
                bounds = np.searchsorted(text, np.arange(hi - lo + 1))
                further: list[np.ndarray] = []
                for d in range(hi - lo):
                    a, z = int(bounds[d]), int(bounds[d + 1])
                    for no, level in zip(wanted[lo + d], levels[lo + d], strict=True):
                        k = a + no
                        w0, n, anchor_hash = int(begin[k]), int(count[k]), low[k]
                        parts = [(w0, n, int(anchor_hash))]
                        if level:
                            while len(further) < level:
                                seed = U64(0xA5A5A5A5A5A5A5A5 + len(further))
                                further.append(_least(mix(h ^ seed), window, anchor))
                            name = mix(np.full(n, anchor_hash))
                            for other in further[:level]:
                                name = mix(other[w0 : w0 + n] ^ name)
                            cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), n]
                            parts = [(w0 + x, y - x, int(name[x])) for x, y in pairwise(cuts)]
                        for at, many, name in parts:
                            body = bytes(view[s[at] : e[at + many + window - 2]])
                            # words stand apart by any white space: the digest knows only one
                            key = hashlib.blake2b(b" ".join(body.split()), digest_size=16).digest()
                            row.append(lo + d)
                            pos.append(at - int(first[d]))
                            size.append(many + window - 1)
                            mine.append(name)
                            keys.append(key)
                            bodies.append(body)
                            same = (name, key)
                            least[same] = min(least.get(same, docs_[lo + d]), docs_[lo + d])
                if row:
                    body = [x if docs_[i] == least[name, key] else None for x, i, name, key in zip(bodies, row, mine, keys, strict=True)]
                    at = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column("rid").take(at), b.column("doc_id").take(at), pa.array(np.array(mine, U64).view(np.int64)), pa.array(pos, pa.int32()), pa.array(size, pa.int32()), pa.array(keys, pa.binary()), pa.array(body, pa.binary())],
                        ["rid", "doc_id", "anchor", "pos", "size", "key", "body"],
                    )

    return docs.mapInArrow(run, "rid binary, doc_id long, anchor long, pos int, size int, key binary, body binary")


def _search(rows: list[tuple[bytes, int, int, bytes]], window: int) -> Iterator[tuple[bytes, int, int]]:
    """(rid, start, end) of what each row of a shard (rid, doc_id, pos, bytes) loses."""
    rank = {doc: i for i, doc in enumerate(sorted({doc for _, doc, _, _ in rows}))}
    owner: dict[bytes, int] = {}
    for _, doc, _, body in rows:
        owner[body] = min(rank[doc], owner.get(body, len(rank)))
    bodies = list(owner)
    ids: dict[bytes, int] = {}
    texts = [np.array([ids.setdefault(w, len(ids) + 1) for w in x.split()], np.int64) for x in bodies]
    index = FmIndex(texts, np.array([owner[x] for x in bodies], np.int64), window)
    _, least = index.matching_statistics(texts)
    by_body = dict(zip(bodies, least, strict=True))
    for rid, doc, pos, body in rows:
        smallest = by_body[body]
        for a, z in _flagged((smallest >= 0) & (smallest < rank[doc]), window):
            yield rid, pos + a, pos + z


def _loss(segments: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Shards: partitions by anchor, each cut at bounds of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int, int, bytes]] = []
        mine: list[tuple[bytes, int, int, bytes]] = []  # of the anchor at hand
        size, last, of = 0, None, (None, None)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            out = list(_search(rows, window)) if rows else []
            rows.clear()
            size = 0
            if out:
                rid, a, z = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.binary()), pa.array(a, pa.int32()), pa.array(z, pa.int32())], ["rid", "start", "end"])

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if len({doc for _, doc, _, _ in mine}) > 1:  # what one document alone has is nowhere else
                more = sum(body.count(b" ") + 2 for *_, body in mine)
                if size + more > shard_words:
                    yield from flush()
                rows.extend(mine)
                size += more
            mine.clear()

        for b in slices(batches):
            for rid, doc, anchor, pos, key, body in zip(*(b.column(c).to_pylist() for c in ("rid", "doc_id", "anchor", "pos", "key", "body")), strict=True):
                if anchor != last:
                    yield from settle()
                    last, of = anchor, (None, None)
                if key != of[0]:
                    of = (key, doc)  # the smallest document of equal stretches comes first
                if doc == of[1]:
                    mine.append((rid, doc, pos, body))
        yield from settle()
        yield from flush()

    shards = segments.where("body is not null").repartition("anchor").sortWithinPartitions("anchor", "key", "doc_id", "pos")
    return shards.mapInArrow(run, "rid binary, start int, end int")


def _whole_loss(segments: DataFrame) -> DataFrame:
    """What is lost because the same stretch is in a smaller document."""
    least = segments.groupBy("anchor", "key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    lost = segments.select("rid", "doc_id", "anchor", "key", "pos", "size").join(least.drop("most"), ["anchor", "key"]).where("least < doc_id")
    return lost.select("rid", F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end"))


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text: rows that agree on them lose the same words."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.col(text_col))))


def intervals(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, split: int = SPLIT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(rid, lost array of (start, end)) for the documents (rid, doc_id, text) that lose words."""
    seen = written(_anchors(docs.where("doc_id is not null"), window, anchor), "anchors")
    shared = seen.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z")
    # one further anchor, and one more for each further STEP times as many stretches
    level = F.when(F.col("n") > split, F.floor(F.log(F.col("n") / F.lit(split)) / math.log(STEP)).cast("int") + 1).otherwise(0)
    hits = seen.join(shared.select("anchor", level.alias("level")), "anchor")
    wanted = hits.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("no", "level"))).alias("w"))
    wanted = wanted.select("rid", F.col("w.no").alias("wanted"), F.col("w.level").alias("levels"))
    segments = _segments(docs.join(wanted, "rid", "left").where("doc_id is not null"), window, anchor)
    segments = written(segments, "stretches")
    lost = _loss(segments, window, shard_words).unionByName(_whole_loss(segments))
    return lost.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("lost"))


def _kept(words_: list[bytes], lost: list[dict] | None) -> list[bytes]:
    if not lost:
        return words_
    gone = np.zeros(len(words_) + 1, np.int32)
    for x in lost:
        gone[x["start"]] += 1
        gone[x["end"]] -= 1
    keep = np.cumsum(gone)[:-1] <= 0
    return [w for w, k in zip(words_, keep.tolist(), strict=True) if k]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document; ``digest``: kept_sha256 instead of the kept text.

    The kept text is the words that stay, joined by single spaces (null stays null).
    """
    own = docs.select(row_key(id_col, text_col).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lost = written(intervals(own, **options), "lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, removed, kept = [], [], []
            for text, gone in zip(b.column("text").cast(pa.binary()), b.column("lost"), strict=True):
                text = text.as_py()
                all_ = (text or b"").split()
                stay = _kept(all_, gone.as_py())
                n.append(len(all_))
                removed.append(len(all_) - len(stay))
                body = b" ".join(stay)
                kept.append(hashlib.sha256(body).hexdigest() if digest else None if text is None else body.decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    out = own.join(lost, "rid", "left").select("doc_id", "text", "lost").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without the words they lose, all columns as they are; other texts stay untouched."""
    rid = row_key(id_col, text_col)
    own = docs.select(rid.alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lost = written(intervals(own, **options), "lost").select(F.col("rid").alias("_rid"), F.col("lost").alias("_lost"))
    joined = docs.withColumn("_rid", rid).join(lost, "_rid", "left").select(*docs.columns, "_lost")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            body = []
            for text, gone in zip(b.column(at), b.column("_lost"), strict=True):
                gone = gone.as_py()
                body.append(b" ".join(_kept(text.as_py().encode().split(), gone)).decode() if gone else text.as_py())
            columns = b.columns[:-1]
            columns[at] = pa.array(body, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, docs.schema)
