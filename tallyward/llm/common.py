"""Shared plumbing: durable intermediate tables, Arrow access, word hashing.

Nothing here depends on a machine-local folder: intermediate tables go to the
folder the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that may hold texts. Spark bounds batches at 64 MB by itself, but keeps several copies.
BATCH_ROWS = 400
#: Bytes of text that one vectorised step handles.
CHUNK_BYTES = 1 << 20

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A session without one gets a local folder, but only where all of it runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows while something runs; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def written(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with batch_rows(spark, rows):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files behind a table made by :func:`written`, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- Arrow


def as_bytes(column: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column, null as empty, with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, data) of a large_binary array without nulls."""
    n, at = len(column), column.offset
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (or of one row, where that is longer)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``most`` bytes in one column, but for the last; Spark bounds its own at 64 MB."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
    # workers live on, and Arrow keeps what it had
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """The same rows a few at a time, for steps that make objects or copies of all they are given."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


class Memo:
    """What ``learn`` gives for keys, kept in two generations of at most ``most`` bytes each.

    When the young generation is full it becomes the old one, which goes; what is asked
    for again moves to the young one. Entries of more than ``LONG`` bytes are not kept.
    The bound is checked after each call, so a generation holds one call's keys above it.
    """

    #: Bytes that an entry takes beside its key and value.
    ENTRY, LONG = 170, 4096

    def __init__(self, learn: Callable[[list[str]], list[bytes]], most: int = 80 << 20):
        self.learn, self.most, self.size = learn, most, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def many(self, keys: list[str]) -> list[bytes]:
        """Values of distinct keys."""
        out = list(map(self.young.get, keys))
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in missing:
            if (x := self.old.get(keys[i])) is None:
                new.append(i)
            else:
                out[i] = x
        for i, x in zip(new, self.learn([keys[i] for i in new]) if new else (), strict=True):
            out[i] = x
        if missing:
            names, values = [keys[i] for i in missing], [out[i] for i in missing]
            sizes = [len(k) + len(v) for k, v in zip(names, values, strict=True)]
            if max(sizes) > self.LONG:
                short = [n <= self.LONG for n in sizes]
                names, values, sizes = ([x for x, y in zip(xs, short, strict=True) if y] for xs in (names, values, sizes))
            self.young.update(zip(names, values, strict=True))
            self.size += sum(sizes) + self.ENTRY * len(names)
            if self.size > self.most:
                self.old, self.young, self.size = self.young, {}, 0
        return out


# ---------------------------------------------------------------- hashing

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        _tables[:] = [np.cumprod(np.concatenate([[U64(1)], np.full(size, U64(p))])) for p in (_P, _PINV)]
    return _tables[0], _tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def words(offsets: np.ndarray, data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of adjacent texts.

    Returns their 64-bit hashes, the first word of each text (one more entry at the
    end), starts and ends within the returned bytes, and these bytes.
    """
    raw = data[offsets[0] : offsets[-1]]
    if lower:
        raw = _LOWER[raw]
    cuts = offsets - offsets[0]
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), np.zeros(len(cuts), np.int64), none, none, raw
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
    h = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
    return h, np.searchsorted(s, cuts), s, e, raw


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries (across texts; the caller masks those)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    c = U64(0xD6E8FEB86659FD93)
    for j in range(k):
        out = out * c + h[j : j + m]
    return mix(out)
