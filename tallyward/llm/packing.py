"""Best-fit packing of token sequences by the sum-of-squares rule.

A document's ids (with an end id) become pieces of at most ``capacity`` tokens; only
longer documents are cut. Pieces are dealt by a hash of their key to packers of a
bounded number of pieces, and each packer handles its own in order of falling length:
a piece goes into the open sequence for which the sum, over residual gaps, of the
squared number of open sequences with that gap becomes smallest (equal sums: the
smallest gap); a sequence is begun only when no open one has room. Order and choices depend on the data alone, so a packer
that is run again after a loss gives the same sequences.

Edge cases: null or empty text is the end id alone, one piece of length 1; texts of
any length are cut; equal lengths are ordered by id and piece, so ties and repeated
rows are settled; rows with a null id are packed as any other; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import encode_rows

#: Pieces that one packer handles, about; more pieces mean more packers.
PACKER_PIECES = 25_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, placed in the given order; sequences count from 0."""
    n = len(lengths)
    seq, off = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_ = np.zeros(capacity + 1, np.int64)  # sequences by gap; gap 0 and empty ones do not count
    bins: list[list[int]] = [[] for _ in range(capacity)]
    used = 0
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            seq[i] = used
            used += 1
            continue
        fits = open_[s:capacity]
        if fits.any():
            # half the change of the sum when gap g becomes g - s, without what all choices share; a perfect fit leaves the count
            gain = open_[: capacity - s] - fits
            gain[0] = -open_[s] - 1
            gap = s + int(np.where(fits > 0, gain, n + 1).argmin())
            b = bins[gap].pop()
            open_[gap] -= 1
        else:
            gap, b = capacity, used
            used += 1
        seq[i], off[i] = b, capacity - gap
        if gap > s:
            bins[gap - s].append(b)
            open_[gap - s] += 1
    return seq, off


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for keys, texts in encode_rows(batches, tokenizer):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(texts):
                ids += tail
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    row.append(i)
                    piece.append(k // step)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: int, packer_pieces: int = PACKER_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...)."""
    packers = max(1, math.ceil(items.count() / packer_pieces))
    names = items.columns
    lengths, ids, parts = names.index("length"), names.index("doc_id"), names.index("piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        # one task may hold several packers: they are packed apart, whatever the number of tasks
        rows = rows.sort_by([("packer", "ascending"), (names[lengths], "descending"), (names[ids], "ascending"), (names[parts], "ascending")])
        packer = rows.column("packer").to_numpy()
        length = rows.column(lengths).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(packer)) + 1).tolist(), len(packer)]
        seq, off = np.zeros(len(packer), np.int64), np.zeros(len(packer), np.int64)
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            s, o = sum_of_squares(length[a:z], capacity)
            seq[a:z], off[a:z] = s + (int(packer[a]) << 40), o
        out = rows.drop_columns(["packer"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
        yield from out.combine_chunks().to_batches(max_chunksize=20_000)

    dealt = items.withColumn("packer", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(packers))).repartition(packers, "packer")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Cut and pack every document of ``docs``."""
    return pack(written(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
