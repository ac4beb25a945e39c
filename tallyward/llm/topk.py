"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are quantised to integers, floor(scale * x). Candidates are dealt once, to blocks
of a bounded number of rows, and each block goes to one task, which holds it as postings:
for each dimension (a term) the rows and their integer weights. The queries stream past
it: each query's non-zero terms scatter ``query weight * posting weight`` into a dense
array of scores, from which partition selection takes the best k, ties to the smaller
id; the partial lists of a query are then merged. Candidates cross the network once and
queries once for each block; neither side is broadcast or collected.

Edge cases: vectors that are null, or hold null or non-finite components, take no
part, nor do rows with a null id. Vectors of different length share their common
leading dimensions (a missing component counts as 0). Rows that repeat an id are
candidates of their own, but not for the query of that id. A query gets fewer than k
rows where there are fewer candidates; an empty table gives none. Integer scores use
64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Candidates of a block, which one task holds, and of a part of it that is scored at once.
CANDIDATES, PART = 32_768, 8192


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, w array<long>) of the vectors that take part."""
    v = F.col(vector_col)
    # a double is finite unless it is NaN or beyond the largest one
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= F.lit(1.7976931348623157e308)))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & good)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale))).alias("w"))


def _dense(rows: pa.ListArray) -> np.ndarray:
    """Rows as a matrix, short ones filled up with zeros."""
    width = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(width), int(width.max(initial=0))), np.int64)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(width)), width), np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)] = flat
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Postings:
    """Candidates by term."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.terms = ids, []
        for t in range(weights.shape[1]):
            at = np.flatnonzero(weights[:, t])
            self.terms.append((slice(None) if len(at) == len(ids) else at, np.ascontiguousarray(weights[at, t])))
        self.scores = np.zeros(len(ids), np.int64)

    def best(self, own: int, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k for a query, term at a time, without rows of its own id."""
        scores = self.scores
        scores[:] = 0
        for t in np.flatnonzero(row[: len(self.terms)]).tolist():
            at, weight = self.terms[t]
            scores[at] += row[t] * weight
        ids, found = self.ids, scores
        if (ids == own).any():
            other = np.flatnonzero(ids != own)
            ids, found = ids[other], scores[other]
        at = _best(found, ids, k)
        return ids[at], found[at]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row of ``queries`` against all of ``vectors``."""
    c = written(quantised(vectors, id_col, vector_col, scale), "candidates")
    q = quantised(queries, id_col, vector_col, scale)
    blocks = max(1, math.ceil(c.count() / block))
    # numbers of the rows of a written table stay the same when a task runs again; they deal rows that repeat an id evenly
    dealt = c.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    sent = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = dealt.withColumn("query", F.lit(False)).unionByName(sent.withColumn("query", F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, parts = -1, [], []
        for b in batches:
            number = b.column("block").to_numpy()
            asks = b.column("query").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(number) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if number[lo] != now:
                    now, held, parts = number[lo], [], []
                ids, w = b.column("vec_id").slice(lo, hi - lo).to_numpy(), _dense(b.column("w").slice(lo, hi - lo))
                if not asks[lo]:
                    held.append((ids, w))
                    continue
                for c_ids, c_w in held:  # all candidates of a block come before its queries
                    parts += [Postings(c_ids[i : i + PART], c_w[i : i + PART]) for i in range(0, len(c_ids), PART)]
                held = []
                out: list[list[np.ndarray]] = [[], [], []]
                for own, row in zip(ids.tolist(), w, strict=True):
                    found = [p.best(own, row, k) for p in parts]
                    if not found:
                        continue
                    c_ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                    at = _best(scores, c_ids, k)
                    for to, x in zip(out, (np.full(len(at), own, np.int64), c_ids[at], scores[at]), strict=True):
                        to.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    met = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "query")
    partial = met.select("block", "query", "vec_id", "w").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
