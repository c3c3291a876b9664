"""Helpers shared by the text operators: Arrow text chunks, word hashes, deterministic buckets.

A *word* is a maximal run of bytes other than space and the control bytes 9-13
(``[^\\x20\\x09-\\x0D]+``). All hashing is vectorised over chunks of whole
documents; a chunk holds about ``CHUNK_BYTES`` of text (one longer document is a
chunk of its own), so a task's memory follows the chunk, not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.ones(256, bool)      # all but ASCII letters and digits and bytes beyond ASCII
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_CODE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_R = U64(0x9E3779B97F4A7C15)
_R_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = U64(0xD6E8FEB86659FD93)
_STEP2 = U64(0xA0761D6478BD642F)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[str, np.ndarray] = {}


def _pow_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "r" not in _POW or len(_POW["r"]) < n:
        _POW["r"], _POW["i"] = _powers(_R, n), _powers(_R_INV, n)
    return _POW["r"], _POW["i"]


HASH_BLOCK = 1 << 16            # bytes hashed at once: their powers and sums take 40 times as much


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; starts and ends ascend. A hash does not depend on the span's place."""
    out = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + HASH_BLOCK, side="right")))      # a longer span is a block alone
        first, end = starts[lo:hi] - base, ends[lo:hi] - base
        n = int(end[-1])
        r, r_inv = _pow_table(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_CODE[buf[base:base + n]] * r[:n], out=total[1:])
        out[lo:hi] = mix((total[end] - total[first]) * r_inv[first] ^ ((end - first).astype(U64) << U64(48)))
        lo = hi
    return out


# 1: letters of scripts without spaces (Thai, Lao, Tibetan, Myanmar, Khmer, Chinese, Japanese); 2: their punctuation
_UNSPACED = np.zeros(1 << 16, np.uint8)
for _lo, _hi in ((0x0E01, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035),
                 (0x3038, 0x303C), (0x3041, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
                 (0xF900, 0xFAFF), (0xFF66, 0xFF9F)):
    _UNSPACED[_lo:_hi + 1] = 1
for _lo, _hi in ((0x0E4F, 0x0E4F), (0x0E5A, 0x0E5B), (0x104A, 0x104F), (0x17D4, 0x17DA), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F),
                 (0x30A0, 0x30A0), (0x30FB, 0x30FB), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20),
                 (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)):
    _UNSPACED[_lo:_hi + 1] = 2


def _unspaced(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, bytes, kind in _UNSPACED) of the code points of three and four bytes."""
    three, four = np.flatnonzero((buf & 0xF0) == 0xE0), np.flatnonzero(buf >= 0xF0)
    code = [buf[three + i].astype(np.int32) & 0x3F for i in range(3)]
    kind = _UNSPACED[(code[0] & 15) << 12 | code[1] << 6 | code[2]]
    plane = (buf[four].astype(np.int32) & 7) << 2 | (buf[four + 1].astype(np.int32) & 0x30) >> 4
    wide = np.where((plane == 2) | (plane == 3), 1, 0).astype(np.uint8)     # the supplementary ideographic planes
    return np.r_[three, four], np.r_[np.full(len(three), 3), np.full(len(four), 4)], np.r_[kind, wide]


class Words:
    """The words of a chunk of documents: byte spans, 64-bit hashes, owning document.

    With ``units``, the code points of scripts without spaces are words of their own, and the
    full-width punctuation is space; ``unit`` tells which words those are.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE, units: bool = False):
        base = int(offsets[0])
        self.data = data[base:int(offsets[-1])]
        self.doc_offsets = offsets - base
        buf = LOWER[self.data] if lower else self.data
        n = len(buf)
        word = ~space[buf]
        edge = np.zeros(n + 1, bool)
        edge[self.doc_offsets] = True
        own = np.zeros(n + 1 if units else 0, bool)
        if units and n and buf.max() >= 0xE0:
            at, size, kind = _unspaced(buf)
            gap = at[kind == 2]
            word[gap] = word[gap + 1] = word[gap + 2] = False
            at, size = at[kind == 1], size[kind == 1]
            own[at] = edge[at] = edge[at + size] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = ~word[:-1]
            after[-1] = True
            after[:-1] = ~word[1:]
        self.starts = np.flatnonzero(word & (before | edge[:-1]))
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1
        self.unit = own[self.starts] if units else None
        # words of document d are first[d] .. first[d + 1] - 1
        self.first = np.searchsorted(self.starts, self.doc_offsets)
        self.counts = np.diff(self.first)
        self.text = buf

    def hashes(self) -> np.ndarray:
        return span_hashes(self.text, self.starts, self.ends)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def position(self) -> np.ndarray:
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)


def sequence_hash(words: np.ndarray, at: np.ndarray, length: int, wide: bool = False):
    """Hash of the ``length`` words from each index in ``at``; ``wide`` adds an independent second half."""
    acc = np.zeros(len(at), U64)
    acc2 = np.zeros(len(at), U64) if wide else None
    for j in range(length):
        w = words[at + j]
        acc = acc * _STEP + w
        if wide:
            acc2 = acc2 * _STEP2 + (w ^ (w >> U64(29)))
    return (mix(acc), mix(acc2)) if wide else mix(acc)


def text_chunks(batch: pa.RecordBatch, column: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) over whole documents; a null text has no bytes."""
    arr = batch.column(column)
    if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return
    _valid, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset:arr.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data, offsets[lo:hi + 1]
        lo = hi


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate the ranges ``starts[i] .. starts[i] + lengths[i] - 1``."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def release_memory() -> None:
    """Give freed memory back to the system: workers are reused, and what a task frees counts until then."""
    import ctypes

    _POW.clear()                # as long as the longest chunk
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):       # another C library
        pass


HELD: list[dict] = []           # what operators remember between tasks


def drop_held() -> None:
    """Forget what other operators remember: reused workers would hold it through the stages of this one."""
    held = [d for d in HELD if d]
    for d in held:
        d.clear()
    if held:
        release_memory()


def released(run, remembers: bool = False):
    """A batch function that gives its memory back when its input ends; unless it ``remembers`` things
    itself, it drops first what earlier operators left in the worker."""
    def outer(batches):
        if not remembers:
            drop_held()
        yield from run(batches)
        release_memory()
    return outer


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of text in the whole table (one narrow pass)."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BATCH_ROWS = 1000               # documents of an Arrow batch


def on_workers(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a cluster, and their batches of documents small.

    A batch is held by the JVM and by the worker at once, so 10,000 documents (the
    default) would cost every core several copies of tens of megabytes.
    """
    from corpusfold.session import ship_package

    ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def pack(columns: list[np.ndarray]) -> bytes:
    """Byte planes of equally long columns, compressed (ids and positions have many equal high bytes)."""
    n = len(columns[0])
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns]
    return n.to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(payload: bytes, dtypes: list) -> list[np.ndarray]:
    n = int.from_bytes(payload[:4], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[4:]), np.uint8)
    out, at = [], 0
    for t in map(np.dtype, dtypes):
        size = n * t.itemsize
        out.append(np.ascontiguousarray(raw[at:at + size].reshape(t.itemsize, n).T).view(t).ravel())
        at += size
    return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)


def bucket_slices(bucket: np.ndarray, order: np.ndarray):
    """(bucket, indexes) for each bucket, the indexes in the given order."""
    if len(bucket):
        b = bucket[order]
        cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(b)]):
            yield int(b[lo]), order[lo:hi]


BROADCAST_IDS = 500_000         # counted rows up to which a written table of keys is broadcast


def by_keys(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """``rows`` in (or not in) a written key table: broadcast if its counted size is small, else a shuffled join."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, on, how)
