"""Token ids in training order, as binary shards of fixed-stride records.

1. Texts become ids (with an end id), cut in sequences of at most ``stride`` ids, and
   are written as a table of compressed blocks. A sequence's index is its place in that
   table: the sequences of the files before its own, and those before it in its file.
   The table does not change once written, so the index does not either, whatever is run
   again.
2. A keyed Feistel network permutes the indices. It works on the smallest even number of
   bits that holds them; results beyond the last index go through it again
   (cycle-walking), which keeps it a permutation. The result is the global slot.
3. Sequences go, in compressed runs, to the range of slots of their shard, and each range
   writes one file.
   A record is a little-endian unsigned 32-bit length and ``stride`` unsigned 16- or
   32-bit ids, the rest zeros; record k of shard s holds slot s * records + k. So a
   reader seeks to any slot and goes on from there. Files get their name only when
   complete, so a task that is run again replaces its own file by an equal one.

Edge cases: null or empty text is one sequence of the end id; long texts give many
sequences; equal texts have different indices, so different slots; rows with a null id
are written, with id null in the listing; an empty table writes no shard. Other columns
are not read.
"""

from __future__ import annotations

import math
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, fresh_path, mix, written
from .tokens import encode_rows

#: Ids of a record; records of a shard.
STRIDE, RECORDS = 512, 16_384
ROUNDS = 4
HEADER = 4
#: Sequences of a block, bytes that one run of blocks is dealt from, and how hard both are compressed.
BLOCK, RUN_BYTES, LEVEL = 4096, 64 << 20, 5


def feistel(index: np.ndarray, count: int, key: int) -> np.ndarray:
    """The slot of each index: a permutation of 0 .. count - 1."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)
    rounds = mix(np.arange(1, ROUNDS + 1).astype(U64) * U64(0x9E3779B97F4A7C15) + U64(key & (2**64 - 1)))
    out = np.asarray(index).astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> U64(half), out[todo] & mask
        for k in rounds:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = (left << U64(half)) | right
        todo = todo[out[todo] >= U64(count)]
    return out.astype(np.int64)


def _narrow(ids: bytes, width: int) -> bytes:
    """32-bit ids in ``width`` bytes each."""
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and int(wide.max()) >> (8 * width):
        raise ValueError(f"an id of {int(wide.max())} needs more than {width} bytes")
    return wide.astype(f"<u{width}").tobytes()


_META = "doc_id array<{kind}>, seq array<int>, start array<long>, length array<int>"


def sequences(docs: DataFrame, tokenizer: str, stride: int, end_id: int, id_col: str, text_col: str, width: int, block: int = BLOCK) -> DataFrame:
    """Blocks of sequences (first: the place of the block's first one in its file; body: their ids, compressed)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        first = 0
        ids_of: list[pa.Array] = []
        seq: list[int] = []
        start: list[int] = []
        body: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal first
            lists = [pa.concat_arrays(ids_of), pa.array(seq, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // width for x in body], pa.int32())]
            ends = pa.array([0, len(seq)], pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *(pa.ListArray.from_arrays(ends, x) for x in lists), pa.array([press(b"".join(body))], pa.binary())], ["first", "doc_id", "seq", "start", "length", "body"])
            first += len(seq)
            for x in (ids_of, seq, start, body):
                x.clear()
            return out

        tail, step = np.array([end_id], f"<u{width}").tobytes(), stride * width
        for keys, texts in encode_rows(batches, tokenizer):
            row = []
            for i, ids in enumerate(texts):
                raw = _narrow(ids, width) + tail
                for k in range(0, len(raw), step):
                    row.append(i)
                    seq.append(k // step)
                    start.append(k // width)
                    body.append(raw[k : k + step])
            ids_of.append(keys.take(pa.array(row, pa.int64())))
            if len(seq) >= block:
                yield flush()
        if seq:
            yield flush()

    return docs.select(id_col, text_col).mapInArrow(run, f"first long, {_META.format(kind=kind)}, body binary")


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def shard_path(out: str, shard: int) -> str:
    return f"{out}/shard-{shard:08d}.bin"


def slotted(blocks: DataFrame, key: int, records: int, width: int) -> tuple[DataFrame, int]:
    """Runs of sequences by shard, each in order of slot, from a written table of blocks; and the number of sequences."""
    file = F.col("_metadata.file_path")
    counts = sorted((r["f"], r["n"]) for r in blocks.groupBy(file.alias("f")).agg(F.sum(F.size("seq")).alias("n")).collect())  # a row a file
    ends = np.cumsum([0, *(n for _, n in counts)])
    total = int(ends[-1])
    base = dict(zip((f for f, _ in counts), ends[:-1].tolist(), strict=True))
    kind = blocks.schema["doc_id"].dataType.elementType.simpleString()
    names = ["doc_id", "seq", "start", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, open_ = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
        held: list[pa.Table] = []
        body: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.concat_tables(held)
            slot = rows.column("slot").to_numpy()
            order = np.argsort(slot)
            rows, slot = rows.take(pa.array(order)), slot[order]
            cuts = [0, *(np.flatnonzero(np.diff(slot // records)) + 1).tolist(), len(slot)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                part = rows.slice(a, z - a).combine_chunks()
                ends = pa.array([0, z - a], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, part.column(c).combine_chunks()) for c in (*names, "slot")]
                yield pa.RecordBatch.from_arrays([pa.array([int(slot[a]) // records], pa.int64()), *lists, pa.array([press(b"".join(body[i] for i in order[a:z].tolist()))], pa.binary())], ["shard", *names, "slot", "body"])
            held.clear()
            body.clear()

        for b in batches:
            for k in range(len(b)):
                lists = {c: b.column(c)[k].values for c in names}
                raw = open_(b.column("body")[k].as_py())
                at = np.concatenate([[0], np.cumsum(lists["length"].to_numpy().astype(np.int64) * width)]).tolist()
                body += [raw[x:y] for x, y in pairwise(at)]
                index = base[b.column("f")[k].as_py()] + b.column("first")[k].as_py() + np.arange(len(at) - 1)
                held.append(pa.table(lists | {"slot": pa.array(feistel(index, total, key))}))
                size += len(raw)
                if size >= RUN_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    rows = blocks.select("first", *names, "body", file.alias("f"))
    return rows.mapInArrow(run, f"shard long, {_META.format(kind=kind)}, slot array<long>, body binary"), total


def write_shards(docs: DataFrame, out: str, tokenizer: str, stride: int = STRIDE, records: int = RECORDS, key: int = 2024, end_id: int = 0, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards under ``out``, a folder all machines share, and list their records:
    (doc_id, seq, start, length, slot, shard, position, ids_crc32), position in bytes."""
    spark = docs.sparkSession
    table = written(sequences(docs, tokenizer, stride, end_id, id_col, text_col, width), "sequences")
    runs, total = slotted(table, key, records, width)
    size = HEADER + stride * width
    shards = max(1, math.ceil(total / records))
    stored, root = _filesystem(out)
    stored.create_dir(root, recursive=True)
    names = ["doc_id", "seq", "start", "length", "slot"]

    def write(shard: int, parts: list[dict]) -> pa.RecordBatch:
        fs, top = _filesystem(out)
        open_ = zstandard.ZstdDecompressor().decompress
        rows = pa.concat_tables([pa.table({c: p[c] for c in names}) for p in parts])
        raw = b"".join(open_(p["body"]) for p in parts)
        length = rows.column("length").to_numpy().astype(np.int64) * width
        end = np.cumsum(length)
        slot = rows.column("slot").to_numpy()
        order = np.argsort(slot)
        temporary = f"{top}/.{shard}-{uuid.uuid4().hex}"
        crc = []
        with fs.open_output_stream(temporary) as sink:
            for i in order.tolist():
                ids = raw[end[i] - length[i] : end[i]]
                crc.append(zlib.crc32(ids))
                sink.write((len(ids) // width).to_bytes(HEADER, "little") + ids.ljust(size - HEADER, b"\0"))
        fs.move(temporary, shard_path(top, shard))
        rows, slot = rows.take(pa.array(order)).combine_chunks(), slot[order]
        return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in names), pa.array(np.full(len(slot), shard)), pa.array(slot % records * size), pa.array(crc, pa.int64())], [*names, "shard", "position", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = -1, []
        for b in batches:
            for k in range(len(b)):
                if (now := b.column("shard")[k].as_py()) != shard:  # rows come shard by shard
                    if parts:
                        yield write(shard, parts)
                    shard, parts = now, []
                parts.append({c: b.column(c)[k].values for c in names} | {"body": b.column("body")[k].as_py()})
        if parts:
            yield write(shard, parts)

    kind = docs.schema[id_col].dataType.simpleString()
    dealt = runs.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
    return written(dealt.mapInArrow(run, f"doc_id {kind}, seq int, start long, length int, slot long, shard long, position long, ids_crc32 long"), "listing")


def read_slots(out: str, first: int, count: int, stride: int = STRIDE, records: int = RECORDS, width: int = 2) -> Iterator[np.ndarray]:
    """The ids of ``count`` slots from ``first`` on, shard after shard."""
    fs, root = _filesystem(out)
    size = HEADER + stride * width
    while count > 0:
        shard, at = divmod(first, records)
        with fs.open_input_file(shard_path(root, shard)) as f:
            here = min(count, f.size() // size - at)
            if here <= 0:
                return
            f.seek(at * size)
            for _ in range(here):
                record = f.read(size)
                n = int.from_bytes(record[:HEADER], "little")
                yield np.frombuffer(record, f"<u{width}", n, HEADER)
        first, count = first + here, count - here


def output_path(spark: SparkSession) -> str:
    return fresh_path(spark, "shards")
