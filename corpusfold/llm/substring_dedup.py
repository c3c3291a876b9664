"""Operator 1 - substring dedup with difference-cover anchors.

A window is ``WINDOW`` = 20 consecutive words of one document. A word goes if a
window that covers it also starts earlier in the corpus (smaller document id, or
the same document at an earlier word).

Method. ``COVER`` = {0, 1, 3, 9} is a difference cover modulo ``PERIOD`` = 13:
for any two starts i, j some shift below 13 takes both to positions in the cover.
So two equal windows share an aligned *anchor*: the 8 words (20 - 13 + 1) from a
cover position. Hence

1. every document emits the hashes of its anchors only (4 of 13 positions);
2. anchors that occur twice anywhere come back to their documents;
3. there they are extended: each window that holds a repeated anchor emits its
   own hash (80 bits beside the bucket's); the earliest occurrence of a hash stays, the rest are marked;
4. marked windows come back to their documents, which drop the covered words.

Scale. Hashes travel in packed blocks, one per (chunk of documents, bucket).
Before the shuffle each chunk keeps one record a hash: repeats inside the chunk
are settled on the spot and only their positions travel, dealt by document. A hot
passage therefore meets as one record a chunk, never as all its occurrences. A
message keeps a table of its documents, so a record costs its hash and about two
bytes. The number of buckets follows the bytes of text, so a bucket's memory does
not grow.
The texts are shuffled once; the second use reads the same exchange again.

Cases. Null text: no words. A text of fewer than 20 words is never changed. Rows
with the same doc_id and the same text tie: neither is earlier, both get the same
result, and their places travel once a task and come back once. Rows with the same doc_id and other texts (told apart by a 32-bit hash) are
separate documents of that rank. A null doc_id ranks last. Other columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.llm.common import (U64, Words, bucket_of, bucket_slices, column, mix, on_workers, pack, partitions,
                                   read_table, sequence_hash, text_bytes, text_chunks, unpack)

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
BUCKET_BYTES = 16 << 20         # text bytes a bucket stands for, and that are packed together
LAST = np.iinfo(np.int64).max   # rank of a null doc_id

_MESSAGE = "bucket int, settled boolean, payload binary"
_MESSAGE_ARROW = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("payload", pa.binary())])
_FOUND = "dk long, th int, pos int"
_FOUND_ARROW = pa.schema([("dk", pa.int64()), ("th", pa.int32()), ("pos", pa.int32())])


_DOC = [np.int64, np.int32]                # rank and text hash of a document
_PLACE = [np.uint32, np.int32]             # document in the message's table, word position


def _grouped(keys: list[np.ndarray], refs: list[np.ndarray]):
    """Keys and references sorted by (key, rank, position, text), and which rows begin a new key.

    A place that comes twice under one key - of a row that is repeated - is one.
    """
    order = np.lexsort((refs[1], refs[2], refs[0], *keys[::-1]))
    keys, refs = [k[order] for k in keys], [r[order] for r in refs]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        once = new.copy()
        once[1:] |= np.logical_or.reduce([r[1:] != r[:-1] for r in refs])
        if not once.all():
            keys, refs, new = [k[once] for k in keys], [r[once] for r in refs], new[once]
    return keys, refs, new


def _emit(bucket: np.ndarray, settled: bool, refs: list[np.ndarray], keys: list[np.ndarray] = ()):
    """One message a bucket: a table of its documents, then the records in document order."""
    for b, at in bucket_slices(bucket, np.lexsort((refs[2], refs[1], refs[0], bucket))):
        dk, th, pos = (r[at] for r in refs)
        new = np.r_[True, (dk[1:] != dk[:-1]) | (th[1:] != th[:-1])]
        table, places = pack([dk[new], th[new]]), pack([(np.cumsum(new) - 1).astype(np.uint32), pos, *[k[at] for k in keys]])
        yield b, settled, len(table).to_bytes(4, "little") + table + places


def _unpacked(payload: bytes, dtypes: list) -> list[np.ndarray]:
    cut = 4 + int.from_bytes(payload[:4], "little")
    dk, th = unpack(payload[4:cut], _DOC)
    doc, pos, *keys = unpack(payload[cut:], _PLACE + dtypes)
    return [*keys, dk[doc], th[doc], pos]


def _batches(rows: list[tuple[int, bool, bytes]]):
    if rows:
        b, s, p = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(s, pa.bool_()), pa.array(p, pa.binary())],
                                         schema=_MESSAGE_ARROW)


def _refs(batch: pa.RecordBatch, lo: int, hi: int, words: Words, at: np.ndarray) -> list[np.ndarray]:
    doc = np.searchsorted(words.first, at, side="right") - 1
    return [column(batch, "dk")[lo:hi][doc], column(batch, "th")[lo:hi][doc], (at - words.first[doc]).astype(np.int32)]


def _packed_together(batches, collect, send):
    """Gather what ``collect`` finds in the chunks of about BUCKET_BYTES of text, then ``send`` it as messages."""
    parts, held = [], 0

    def flush():
        if parts:
            keys, refs = ([np.concatenate(x) for x in zip(*side)] for side in zip(*parts))
            yield from _batches(list(send(keys, refs)))
            parts.clear()

    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch):
            words = Words(data, offsets)
            at, keys = collect(batch, lo, hi, words)
            if len(at):
                parts.append((keys(at), _refs(batch, lo, hi, words, at)))
            held += int(offsets[-1] - offsets[0])
            if held >= BUCKET_BYTES:
                yield from flush()
                held = 0
    yield from flush()


def _anchor_messages(buckets: int):
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def collect(batch, lo, hi, words):
        pos = words.position()
        size = np.repeat(words.counts, words.counts)
        at = np.flatnonzero(cover[pos % PERIOD] & (size >= WINDOW) & (pos + ANCHOR <= size))
        return at, lambda at: [sequence_hash(words.hashes(), at, ANCHOR)]

    def send(keys, refs):
        (h,), refs, new = _grouped(keys, refs)
        # one record a hash competes, with a flag if it is repeated here; its other places are settled
        again = np.r_[~new[1:], False]
        yield from _emit(bucket_of(h[new], buckets), False, [r[new] for r in refs], [h[new].astype(np.uint32), again[new]])
        yield from _emit(bucket_of(mix(refs[0][~new].view(U64)), buckets), True, [r[~new] for r in refs])

    return lambda batches: _packed_together(batches, collect, send)


def _found(refs: list[np.ndarray]) -> pa.Table:
    """The distinct places: rows that are repeated in several tasks send theirs from each."""
    order = np.lexsort(refs)
    once = np.ones(len(order), bool)
    if len(order):
        once[1:] = np.logical_or.reduce([r[order][1:] != r[order][:-1] for r in refs])
    return pa.Table.from_arrays([pa.array(r[order][once]) for r in refs], schema=_FOUND_ARROW)


def _read(table: pa.Table, dtypes: list):
    """(records that compete, settled places) of one bucket."""
    sides = ([np.zeros(0, t) for t in (*dtypes, *_DOC, np.int32)],), ([np.zeros(0, t) for t in (*_DOC, np.int32)],)
    sides = tuple(map(list, sides))
    for settled, payload in zip(table.column("settled").to_pylist(), table.column("payload")):
        sides[settled].append(_unpacked(payload.as_py(), [] if settled else dtypes))
    return ([np.concatenate(c) for c in zip(*side)] for side in sides)


def _repeated_anchors(table: pa.Table) -> pa.Table:
    """Anchors of one bucket that occur at least twice (equal 32-bit rests may bring a few more; step 3 is exact)."""
    (rest, local, dk, th, pos), settled = _read(table, [np.uint32, bool])
    _u, inverse, counts = np.unique(rest, return_inverse=True, return_counts=True)
    keep = (counts[inverse] > 1) | local
    return _found([np.concatenate([a[keep], b]) for a, b in zip((dk, th, pos), settled)])


def _places(batch: pa.RecordBatch, words: Words, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(document of the chunk, word position) of all positions in ``found``."""
    found = batch.column("found")[lo:hi]
    counts = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(hi - lo), counts), found.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n words lie in one of the ranges [start, end)."""
    mark = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(mark[:n]) > 0


def _window_messages(buckets: int):
    def collect(batch, lo, hi, words):
        doc, anchor = _places(batch, words, lo, hi)
        start = np.maximum(anchor - (WINDOW - ANCHOR), 0)
        end = np.minimum(anchor, words.counts[doc] - WINDOW) + 1
        ok = end > start
        base = words.first[doc[ok]]
        at = np.flatnonzero(_covered(len(words.starts), base + start[ok], base + end[ok]))
        return at, lambda at: list(sequence_hash(words.hashes(), at, WINDOW, wide=True))

    def send(keys, refs):
        keys, refs, new = _grouped(keys, refs)
        # later than the first one here; ties with the first compete beside it
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (refs[0] != refs[0][first]) | (refs[2] != refs[2][first])
        a, b = (k[~later] for k in keys)
        yield from _emit(bucket_of(a, buckets), False, [r[~later] for r in refs], [a.astype(np.uint16), b])
        yield from _emit(bucket_of(mix(refs[0][later].view(U64)), buckets), True, [r[later] for r in refs])

    return lambda batches: _packed_together(batches, collect, send)


def _later_windows(table: pa.Table) -> pa.Table:
    """Windows of one bucket whose hash has an earlier place."""
    (a, b, dk, th, pos), settled = _read(table, [np.uint16, U64])
    (a, b), (dk, th, pos), new = _grouped([a, b], [dk, th, pos])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(a) else np.zeros(0, np.int64)
    later = (dk != dk[first]) | (pos != pos[first])
    return _found([np.concatenate([x[later], s]) for x, s in zip((dk, th, pos), settled)])


def _kept(keep_text: bool):
    def run(batches):
        for batch in batches:
            n_words, n_removed, digest, kept = [], [], [], []
            for lo, hi, data, offsets in text_chunks(batch):
                words = Words(data, offsets)
                doc, at = _places(batch, words, lo, hi)
                base = words.first[doc]
                cut = _covered(len(words.starts), base + at, base + at + WINDOW)
                gone = np.add.reduceat(np.r_[cut, False], words.first[:-1]) * (words.counts > 0)
                for d in range(hi - lo):
                    left = words.data[words.doc_offsets[d]:words.doc_offsets[d + 1]].tobytes().split()
                    if gone[d]:
                        stay = ~cut[words.first[d]:words.first[d + 1]]
                        left = [left[i] for i in np.flatnonzero(stay)]
                    text = b" ".join(left)
                    digest.append(hashlib.sha256(text).hexdigest())
                    if keep_text:
                        kept.append(text.decode("utf-8", "replace"))
                n_words.append(words.counts)
                n_removed.append(gone)
            if not n_words:
                continue
            cols = {"doc_id": batch.column("doc_id"), "n_words": pa.array(np.concatenate(n_words), pa.int64()),
                    "n_removed": pa.array(np.concatenate(n_removed), pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            yield pa.RecordBatch.from_pydict(cols | ({"kept": pa.array(kept, pa.string())} if keep_text else {}))
    return run


def remove_repeated_windows(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (the words that stay, joined by one space)."""
    spark = docs.sparkSession
    on_workers(spark)
    buckets = max(partitions(spark), text_bytes(docs) // BUCKET_BYTES)
    docs = docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("dk"),
                       F.hash("text").alias("th"), "doc_id", "text")

    def gathered(messages: DataFrame, settle) -> DataFrame:
        places = messages.groupBy("bucket").applyInArrow(settle, _FOUND)
        return places.groupBy("dk", "th").agg(F.collect_list("pos").alias("found"))

    anchors = gathered(docs.select("dk", "th", "text").mapInArrow(_anchor_messages(buckets), _MESSAGE), _repeated_anchors)
    # both joins read the texts from one exchange, so they have the same form
    extended = (docs.join(anchors, ["dk", "th"], "left").where("found is not null")
                .mapInArrow(_window_messages(buckets), _MESSAGE))
    marked = gathered(extended, _later_windows)
    return (docs.join(marked, ["dk", "th"], "left")
            .mapInArrow(_kept(keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string"
                        + ", kept string" * keep_text))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over all `documents`: what is left of each text, as a digest."""
    return remove_repeated_windows(read_table(spark, sf_dir, "documents"), keep_text=False)
