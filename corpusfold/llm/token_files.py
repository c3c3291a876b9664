"""Operator 2 - token ids in patched frame-of-reference files.

A file is a sequence of segments of whole documents, in ascending doc_id order.
A segment is one self-contained byte string (all numbers little-endian):

    magic "PFR1", u32 block length, u32 documents, u32 blocks, u64 ids
    i64 doc_id of each document, u8 null flag of each, u32 ids of each document
    u32 start of each block, counted from the first block's first byte
    blocks: u32 minimum, u8 width, u16 exceptions,
            the low ``width`` bits of (id - minimum) of every id, packed,
            u16 position and u32 (id - minimum) of each exception

The width of a block is that of the ``PERCENTILE``-th of its differences, so a few
large ones don't widen the others: those become exceptions. The last block is
filled up with its minimum. A document longer than a segment is a segment alone.

The texts are range-partitioned and sorted by doc_id once and encoded after that,
so ids are never shuffled. Segments are written by Spark's own writer as rows of a
binary column: its commit makes retried and lost tasks harmless and it reaches any
store that Spark reaches. Each segment carries the ids before it in its partition;
a running sum over one total a partition makes global starts.

Cases. Null or blank text: only the end id. A null doc_id comes first. Rows with
the same doc_id stand beside each other in the order of their texts. Very long
texts are encoded whole. Other columns are ignored; an empty table writes no
segment and reads back as no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusfold.llm.common import on_workers, partitions, read_table, released, text_chunks
from corpusfold.llm.word_codec import CHUNK, WordCodec, vocabulary
from corpusfold.session import scratch_path

END_ID = 2
BLOCK = 1024
PERCENTILE = 90
SEGMENT_IDS = 1 << 18
_MAGIC = b"PFR1"


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(start of each block, blocks) of an array of unsigned 32-bit ids."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint32), b""
    rows = np.full(n * BLOCK, ids[(n - 1) * BLOCK:].min(), np.uint32)
    rows[:len(ids)] = ids
    rows = rows.reshape(n, BLOCK)
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    bits = _bits(diff)
    width = np.partition(bits, (BLOCK - 1) * PERCENTILE // 100, axis=1)[:, (BLOCK - 1) * PERCENTILE // 100]
    odd = bits > width[:, None]
    many = odd.sum(axis=1)
    body: list[bytes] = [b""] * n
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        plane = np.unpackbits(diff[at].astype("<u4").view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, bitorder="little", count=int(w))
        packed = np.packbits(plane.reshape(len(at), -1), axis=1, bitorder="little")
        for i, row in zip(at, packed):
            body[i] = row.tobytes()
    out = []
    for i in range(n):
        head = int(low[i]).to_bytes(4, "little") + bytes([width[i]]) + int(many[i]).to_bytes(2, "little")
        tail = b""
        if many[i]:
            where = np.flatnonzero(odd[i])
            tail = where.astype("<u2").tobytes() + diff[i, where].astype("<u4").tobytes()
        out.append(head + body[i] + tail)
    size = np.fromiter(map(len, out), np.int64, n)
    return (np.cumsum(size) - size).astype(np.uint32), b"".join(out)


def unpack_blocks(starts: np.ndarray, raw: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` ids of the blocks that begin at ``starts`` of the bytes ``raw``."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    s = starts.astype(np.int64)
    out = np.empty((len(s), BLOCK), np.uint32)
    low = raw[s[:, None] + np.arange(4)].view("<u4").ravel()
    width = raw[s + 4]
    many = raw[s[:, None] + np.arange(5, 7)].view("<u2").ravel().astype(np.int64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        size = BLOCK * int(w) // 8
        bits = np.unpackbits(raw[s[at][:, None] + np.arange(7, 7 + size)], axis=1, bitorder="little").reshape(len(at), BLOCK, int(w))
        wide = 16 if w <= 16 else 32
        full = np.zeros((len(at), BLOCK, wide), np.uint8)
        full[:, :, :int(w)] = bits
        out[at] = np.packbits(full, axis=2, bitorder="little").view(f"<u{wide // 8}").reshape(len(at), BLOCK)
    for i in np.flatnonzero(many):
        p = s[i] + 7 + BLOCK * int(width[i]) // 8
        k = many[i]
        out[i, raw[p:p + 2 * k].view("<u2")] = np.ascontiguousarray(raw[p + 2 * k:p + 6 * k]).view("<u4")
    return (out + low[:, None]).ravel()[:count]


def write_segment(doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    starts, blocks = pack_blocks(ids)
    head = np.array([BLOCK, len(doc_ids), len(starts)], "<u4").tobytes() + len(ids).to_bytes(8, "little")
    return b"".join([_MAGIC, head, doc_ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(),
                     lengths.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), blocks])


def read_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, null flags, lengths, ids) of a segment."""
    raw = np.frombuffer(payload, np.uint8)
    if payload[:4] != _MAGIC:
        raise ValueError("not a segment")
    block, docs, blocks = (int(x) for x in np.frombuffer(payload, "<u4", 3, 4))
    if block != BLOCK:
        raise ValueError(f"block length {block}")
    count = int.from_bytes(payload[16:24], "little")
    at = 24
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    null = np.frombuffer(payload, np.uint8, docs, at + 8 * docs).astype(bool)
    lengths = np.frombuffer(payload, "<u4", docs, at + 9 * docs)
    starts = np.frombuffer(payload, "<u4", blocks, at + 13 * docs)
    return doc_ids, null, lengths, unpack_blocks(starts, raw[at + 13 * docs + 4 * blocks:], count)


_SEGMENT = "part int, seq int, before long, n_docs int, n_ids long, payload binary"


def _segments(path: str, end_id: int):
    def run(batches):
        codec = WordCodec.of(path)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        held_ids = 0

        def flush():
            nonlocal seq, before, held_ids
            ids, null, n, tokens = (np.concatenate(x) for x in zip(*held))
            held.clear()
            row = [part, seq, before, len(ids), len(tokens), write_segment(ids, null, n, tokens)]
            seq, before, held_ids = seq + 1, before + len(tokens), 0
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                names=["part", "seq", "before", "n_docs", "n_ids", "payload"])

        for batch in batches:
            doc = batch.column("doc_id")
            null, doc = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_chunks(batch, limit=CHUNK):
                tokens, n = codec.encode(data, offsets)
                tokens = np.insert(tokens, np.cumsum(n), end_id).astype(np.uint32)
                held.append((doc[lo:hi], null[lo:hi], n + 1, tokens))
                held_ids += len(tokens)
                if held_ids >= SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()
    return released(run, remembers=True)


def write_token_files(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) with the vocabulary file ``path`` into token files under ``out``."""
    spark = docs.sparkSession
    on_workers(spark)
    (docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text"))
     .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
     .mapInArrow(_segments(path or vocabulary(), end_id), _SEGMENT).write.parquet(out))


def _documents(digest: bool):
    def run(batches):
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload")):
                doc, null, n, ids = read_segment(payload.as_py())
                ends = np.cumsum(n.astype(np.int64))
                cols = [pa.array(doc, pa.int64(), mask=null), pa.array(start + ends - n), pa.array(n.astype(np.int64))]
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    cols.append(pa.array([zlib.crc32(raw[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), n.tolist())], pa.int64()))
                else:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
    return released(run)


def read_token_files(spark: SparkSession, out: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or their ids_crc32) of every document of the files under ``out``."""
    on_workers(spark)
    segments = spark.read.schema(_SEGMENT).parquet(out)
    # one total per write partition: the number of partitions bounds what is broadcast
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    placed = segments.join(F.broadcast(first), "part").select((F.col("first") + F.col("before")).alias("start"), "payload")
    return placed.mapInArrow(_documents(digest), "doc_id long, start long, n_tokens long, "
                             + ("ids_crc32 long" if digest else "ids array<long>"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over all `documents`: written, read back, and digested per document."""
    out = scratch_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), out)
    return read_token_files(spark, out, digest=True)
