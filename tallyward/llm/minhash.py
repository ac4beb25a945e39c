"""Near-duplicate groups by MinHash and an LSH forest.

A document's set: distinct runs of five words (A-Z in lower case); with fewer words, the
whole sequence as one. Documents are linked where 100 * intersection >= 85 * union.

1. Each text gives its set's size, a 128-bit digest of the set and a signature of 256
   minima. Equal sets are one class from here on.
2. The forest: 16 orders of the signature's places. Each order is sorted as a whole (by
   ranges, so a large region is many tasks), and every class is paired with those that
   follow next, down to a common prefix of ``DEPTH`` places. Where classes are few the
   prefix is short; in a dense region the ``WINDOW`` nearest share long ones: so the depth
   adapts to the region and candidates stay in proportion to classes. Of its candidates a
   class keeps the ``PARTNERS`` that share the longest prefixes over all orders.
3. Pairs are confirmed on the full sets, and the links give components.
4. What the windows left out: regions, classes that agree on the first ``DEPTH`` places of
   an order, whose classes are not all in one component. All pairs across components there
   are compared by signature, in blocks that meet in pairs, and those over the threshold
   on their full sets, inside the block. Only links that join components are put out, and
   the components are contracted by them. So no pair of a region goes without a verdict
   unless it is in one component already, and no window is a cap.

Work of step 4 grows with the square of a region of many components only (documents of
one template that are no copies of each other); shuffled rows stay in proportion to
classes times blocks. The threshold on estimated likeness lies 4.4 standard deviations
below 0.85, and two classes of likeness 0.85 have no region in common with probability
(1 - 0.85^4)^16 = 7e-6.

Edge cases: null or empty texts and texts without words have an empty set, are linked
with nothing and are kept; a row with a null id is kept and has no component id; rows
that share an id are judged each on its own text; ties go to the smallest id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, as_bytes, chunks, mix, runs, slices, spans, words, written
from .components import connected

#: Words of a shingle; minima of a signature; orders of the forest; places of a sorted key; places that a region agrees on.
SHINGLE, PLACES, ORDERS, KEY, DEPTH = 5, 256, 16, 16, 4
#: Classes that follow in an order and are candidates; candidates that a class keeps.
WINDOW, PARTNERS = 3, 4
#: Classes of a block.
BLOCK = 1024
#: Places (of 256) on which two signatures agree at least, to be confirmed.
AGREE = 193
#: A link: NUMERATOR * union <= 100 * intersection.
NUMERATOR = 85

_rng = np.random.Generator(np.random.PCG64(7))
_FLIP = _rng.integers(0, 2**63, PLACES, dtype=np.uint64)
_TIMES = _rng.integers(1, 2**62, PLACES, dtype=np.uint64) * U64(2) + U64(1)
# the first 16 places of the orders are all different ones
_SHUFFLED = _rng.permutation(PLACES)
_ORDER = [[*_SHUFFLED[16 * t : 16 * t + 16].tolist(), *_rng.permutation(np.delete(_SHUFFLED, slice(16 * t, 16 * t + 16)))[:16].tolist()] for t in range(ORDERS)]


def shingle_sets(offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of adjacent texts."""
    h, first, *_ = words(offsets, data, lower=True)
    wide = runs(h, SHINGLE)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= SHINGLE:
            out.append(np.unique(wide[a : z - SHINGLE + 1]))
        elif z > a:
            out.append(mix(runs(h[a:z], z - a) + U64(z - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One byte of each minimum, for sets that are not empty."""
    out = np.zeros((len(sets), PLACES), np.uint8)
    if not sets:
        return out
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    work = np.empty_like(flat)
    for k in range(PLACES):
        np.bitwise_xor(flat, _FLIP[k], out=work)
        np.multiply(work, _TIMES[k], out=work)
        out[:, k] = mix(np.minimum.reduceat(work, at)).astype(np.uint8)
    return out


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, cls, sig) of every row (doc_id, text), and its other columns."""
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    names = ["doc_id", "n_shingles", "cls", "sig", *(f.name for f in others)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            offsets, data = spans(as_bytes(b.column("text")))
            for lo, hi in chunks(offsets):
                sets = shingle_sets(offsets[lo : hi + 1], data)
                some = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in some])
                cls: list[bytes | None] = [None] * len(sets)
                sigs: list[bytes | None] = [None] * len(sets)
                for i, x in zip(some, sig, strict=True):
                    cls[i], sigs[i] = class_of(sets[i]), x.tobytes()
                more = [b.column(f.name).slice(lo, hi - lo) for f in others]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(sigs, pa.binary()), *more], names)

    return docs.mapInArrow(run, ", ".join(["doc_id long, n_shingles long, cls binary, sig binary", *(f"`{f.name}` {f.dataType.simpleString()}" for f in others)]))


def _key(order: int, places: int) -> Column:
    return F.concat(*[F.substring("sig", p + 1, 1) for p in _ORDER[order][:places]])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long binaries as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def neighbours(batches: Iterator[pa.RecordBatch], window: int = WINDOW, depth: int = DEPTH) -> Iterator[pa.RecordBatch]:
    """(a, b, prefix) of classes and those that follow next in a sorted order (order, key, node)."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        t = batch if held is None else pa.concat_batches([held, batch])
        order, node, key = t.column(0).to_numpy(), t.column(2).to_numpy(), _matrix(t.column(1))
        new = 0 if held is None else len(held)
        out: list[list[np.ndarray]] = [[], [], []]
        for step in range(1, min(window, len(t) - 1) + 1):
            at = np.arange(max(new - step, 0), len(t) - step)  # the later of the two is a new row
            at = at[(order[at] == order[at + step]) & (key[at, :depth] == key[at + step, :depth]).all(axis=1)]
            differ = key[at] != key[at + step]
            prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), key.shape[1])
            x, y = node[at], node[at + step]
            for to, v in zip(out, (np.minimum(x, y), np.maximum(x, y), prefix), strict=True):
                to.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], ["a", "b", "prefix"])
        held = t.slice(max(len(t) - window, 0))


def candidates(classes: DataFrame, window: int = WINDOW, partners: int = PARTNERS) -> DataFrame:
    """(a, b): for each class the partners of the longest prefixes over all orders."""
    keys = F.array(*[_key(t, KEY) for t in range(ORDERS)])
    rows = classes.select(F.posexplode(keys).alias("order", "key"), "node")
    ranged = rows.repartitionByRange("order", "key", "node").sortWithinPartitions("order", "key", "node")
    pairs = ranged.mapInArrow(partial(neighbours, window=window), "a long, b long, prefix long").groupBy("a", "b").agg(F.sum("prefix").alias("s"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"), "s")
    # 2 * window * orders of them at most
    best = both.groupBy("e.node").agg(F.sort_array(F.collect_list(F.struct("s", "e.other")), asc=False).alias("best"))
    kept = best.select("node", F.explode(F.slice("best", 1, partners)).alias("x")).select("node", F.col("x.other").alias("other"))
    return kept.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def regions(labelled: DataFrame, block: int = BLOCK) -> DataFrame:
    """(bucket, node, order, label): regions of several components, large ones in pairs of blocks."""
    keys = F.array(*[_key(t, DEPTH) for t in range(ORDERS)])
    rows = labelled.select("node", "label", F.posexplode(keys).alias("order", "key"))
    mixed = rows.groupBy("order", "key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    blocks = F.ceil(F.col("n") / block).cast("int")
    cut = rows.join(mixed, ["order", "key"]).select("node", "label", "order", "key", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"))
    # the other block of each bucket; a region of one block is a bucket by itself
    others = F.when(F.col("blocks") == 1, F.array("own")).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))
    met = cut.withColumn("other", F.explode(others))
    return met.select(F.xxhash64("order", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "node", "order", "label")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket; input sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        bucket = b.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(b)]
        for lo, hi in pairwise(cuts):
            if held and held[0].column("bucket")[0].as_py() != bucket[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _apart(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a bucket with those after it that are over the threshold and of another label, in the first order in which both share a region."""
    label, order, sig = t.column("label").to_numpy(), t.column("order").to_numpy(), _matrix(t.column("sig"))
    if (label == label[0]).all():
        return
    for i in range(len(t) - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if len(other):
            other = other[np.count_nonzero(sig[other] == sig[i], axis=1) >= AGREE]
        for earlier in range(order[i]):
            if not len(other):
                break
            places = _ORDER[earlier][:DEPTH]
            other = other[(sig[other][:, places] != sig[i, places]).any(axis=1)]
        if len(other):
            yield i, other


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node) of the classes with a pair to confirm."""
    for t in _buckets(batches):
        some = np.zeros(len(t), bool)
        for i, other in _apart(t):
            some[i] = some[other] = True
        if some.any():
            yield t.select(["bucket", "node"]).filter(pa.array(some)).combine_chunks().to_batches()[0]


def linked(p: np.ndarray, q: np.ndarray) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= NUMERATOR * (len(p) + len(q) - both)


def _set_of(text: bytes) -> np.ndarray:
    return shingle_sets(np.array([0, len(text)]), np.frombuffer(text, np.uint8))[0]


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): labels that a confirmed pair of a bucket joins."""
    for t in _buckets(batches):
        bodies, label = t.column("body"), t.column("label").to_pylist()
        sets: dict[int, np.ndarray] = {}
        leader = {x: x for x in label}
        a, b = [], []

        def top(x: int, leader: dict[int, int] = leader) -> int:
            while leader[x] != x:
                leader[x] = x = leader[leader[x]]
            return x

        for i, other in _apart(t):
            for j in other.tolist():
                x, y = top(label[i]), top(label[j])
                if x == y:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = _set_of(bodies[k].as_py())
                if linked(sets[i], sets[j]):
                    leader[x] = y
                    a.append(label[i])
                    b.append(label[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, np.ndarray] = {}
    for batch in slices(batches):
        keep = []
        for x, y, tx, ty in zip(*(batch.column(i) for i in range(4)), strict=True):
            both = []
            for node, text in ((x.as_py(), tx), (y.as_py(), ty)):
                if node not in known:
                    if len(known) > 64:
                        known.clear()
                    known[node] = _set_of(text.as_buffer().to_pybytes())
                both.append(known[node])
            keep.append(linked(*both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in range(2)], ["a", "b"])


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, body) of the classes' first documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            column = as_bytes(b.column("text"))
            offsets, data = spans(column)
            want, keep = b.column("cls").to_pylist(), []
            for lo, hi in chunks(offsets):
                keep += [class_of(s) == w for s, w in zip(shingle_sets(offsets[lo : hi + 1], data), want[lo:hi], strict=True)]
            mask = pa.array(keep, pa.bool_())  # another row may have the id, but not the set
            yield pa.RecordBatch.from_arrays([b.column("node").filter(mask), column.cast(pa.binary()).filter(mask)], ["node", "body"])

    found = docs.join(wanted, "doc_id").select("node", "cls", "text").mapInArrow(run, "node long, body binary")
    return written(found.dropDuplicates(["node"]), "bodies")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, partners: int = PARTNERS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return groups(own, window, partners, block).drop("label")


def groups(own: DataFrame, window: int = WINDOW, partners: int = PARTNERS, block: int = BLOCK) -> DataFrame:
    """The same for rows (doc_id, text), with their other columns, and the label of the component (null: empty set, or no id)."""
    sets = written(_sets(own), "sets")
    distinct = sets.where("cls is not null").groupBy("cls", "sig").agg(F.min("doc_id").alias("doc_id"))
    classes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "classes")
    pairs = written(candidates(classes.where("doc_id is not null"), window, partners), "pairs", 5000)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _bodies(own, ends.join(classes.select("node", "cls", "doc_id"), "node"))
    ta, tb = (texts.select(F.col("node").alias(x), F.col("body").alias(f"t{x}")) for x in "ab")
    links = written(pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_confirm, "a long, b long"), "links")
    label = connected(links).withColumnRenamed("node", "n")
    known = classes.where("doc_id is not null").join(label, F.col("node") == F.col("n"), "left").drop("n")
    labelled = written(known.withColumn("label", F.coalesce("label", "node")), "labels")
    # pairs that the windows left out, between components
    buckets = written(regions(labelled.select("node", "label", "sig"), block), "regions")
    signed = buckets.join(labelled.select("node", "sig"), "node")
    dealt = signed.repartition("bucket").sortWithinPartitions("bucket", "node")
    left = written(dealt.mapInArrow(_open, "bucket long, node long"), "left", 5000)
    if not left.isEmpty():
        more = written(left.select("node").distinct().join(labelled.select("node", "cls", "doc_id"), "node"), "more")
        bodies = _bodies(own, more)
        full = signed.join(left, ["bucket", "node"]).join(bodies, "node").repartition("bucket").sortWithinPartitions("bucket", "node")
        found = written(full.select("bucket", "order", "label", "sig", "body").mapInArrow(_joining, "a long, b long"), "joins")
        if not found.isEmpty():
            new = connected(found).select(F.col("node").alias("label"), F.col("label").alias("to"))
            labelled = labelled.join(new, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = labelled.join(least, "label").select("cls", "component_id", "label")
    out = sets.join(named, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    more = [c for c in sets.columns if c not in ("doc_id", "n_shingles", "cls", "sig")]
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "label", *more)
