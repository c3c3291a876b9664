"""Operator 13 - documents packed into training sequences of balanced attention cost.

A document's ids (and its end id) are cut into full sequences and a rest. A piece
of n tokens is estimated to cost ``LINEAR * n + QUADRATIC * n * n``; a sequence costs
the sum of its pieces, since attention stays inside a document. The rests are
taken in descending order, each going to the sequence of the lowest cost that has
room for it. As lengths descend, a sequence without room for the present length
waits, filed by its room, until the lengths have come down to that; so a placement
costs O(log n). Where no sequence has room for a whole rest, the one with the most
room is filled and what is left over goes back among the rests.

There are as many sequences as the tokens fill, so none is padded. The tokens
beyond the last full sequence form sequences of powers of two.

Scale. One pass over the texts and no shuffle: a task encodes its rows and packs
them group by group (``GROUP_TOKENS`` tokens or ``GROUP_DOCUMENTS`` documents; the ids of a
group are held).
A group's tokens beyond its full sequences go over to the next group, so only the
last group of a task has shorter sequences: at most log2(length) of them. Sequence
ids hold the task's partition and a counter: reruns over the same splits agree.

Cases. Null or blank text: only the end id (blank text: its ids and the end id).
Null and repeated doc_ids are documents like any other, each row one; their pieces
are told apart by their sequences. Very long texts are encoded whole and cut. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.llm.byte_codec import ByteCodec, byte_vocabulary
from corpusfold.llm.common import on_workers, ragged_index, read_table, released, text_chunks
from corpusfold.llm.word_codec import CHUNK

LENGTH = 2048
END_ID = 1
LINEAR = 1.0
QUADRATIC = 1 / 1024            # attention costs as much as all that is linear at half the length
GROUP_TOKENS = 1 << 20
GROUP_DOCUMENTS = 1 << 16
_TASK_SHIFT = 40                # sequences of a task: 2 ** 40


def piece_cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(rests: list[int], rooms: list[int], whole: bool) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Place rests of the given lengths into sequences with the given rooms.

    Returns pieces (rest, first token in it, tokens, sequence) and, as (rest, first
    token, tokens), what found no room. With ``whole`` the rooms take all of it.
    """
    items = [(-n, i, 0) for i, n in enumerate(rests) if n]
    heapq.heapify(items)
    room, cost = list(rooms), [0.0] * len(rooms)
    open_: list[tuple[float, int]] = []
    waiting: dict[int, list[int]] = {}
    sizes: list[int] = []                       # rooms of waiting sequences, largest first (negative)
    placed, left = [], []

    def wait(s: int) -> None:
        if room[s] not in waiting:
            waiting[room[s]] = []
            heapq.heappush(sizes, -room[s])
        waiting[room[s]].append(s)

    def most_room() -> int:
        same = waiting[-sizes[0]]
        s = same.pop()
        if not same:
            del waiting[-heapq.heappop(sizes)]
        return s

    for s, r in enumerate(room):
        if r:
            wait(s)
    while items:
        n, i, at = items[0]
        n = -n
        while sizes and -sizes[0] >= n:         # room enough from now on
            for s in waiting.pop(-heapq.heappop(sizes)):
                heapq.heappush(open_, (cost[s], s))
        if open_:
            _, s = heapq.heappop(open_)
        elif sizes:
            s = most_room()
        else:
            left += [(i, at, -n) for n, i, at in items]
            break
        take = min(n, room[s])
        heapq.heappop(items)
        placed.append((i, at, take, s))
        room[s] -= take
        cost[s] += piece_cost(take)
        if room[s] >= n:
            heapq.heappush(open_, (cost[s], s))
        elif room[s]:
            wait(s)
        if take < n:
            heapq.heappush(items, (take - n, i, at + take))
    if whole and left:
        raise AssertionError("tokens without room")
    return placed, left


def powers_of_two(n: int) -> list[int]:
    """The powers of two that sum to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Group:
    """Documents of a task that wait to be packed: ids, and for each (key, first id held, ids of the document before it)."""

    def __init__(self, length: int):
        self.length = length
        self.keys: list = []
        self.totals: list[int] = []
        self.befores: list[int] = []
        self.ids: list[np.ndarray] = []
        self.tokens = 0

    def add(self, key, total: int, before: int, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.totals.append(total)
        self.befores.append(before)
        self.ids.append(ids)
        self.tokens += len(ids)

    def pack(self, last: bool) -> tuple[list[tuple], "_Group", int]:
        """(pieces as (document, first id in what is held, tokens, sequence, offset), what goes over, sequences made)."""
        size = self.length
        pieces, rests, rest_of = [], [], []
        made = 0
        for d, ids in enumerate(self.ids):
            full = len(ids) // size
            pieces += [(d, k * size, size, made + k, 0) for k in range(full)]
            made += full
            if len(ids) > full * size:
                rests.append(len(ids) - full * size)
                rest_of.append((d, full * size))
        total = sum(rests)
        rooms = [size] * (total // size) + (powers_of_two(total % size) if last else [])
        placed, left = assign(rests, rooms, last)
        used = [0] * len(rooms)
        for i, at, take, s in placed:
            d, first = rest_of[i]
            pieces.append((d, first + at, take, made + s, used[s]))
            used[s] += take
        over = _Group(size)
        for i, at, n in left:
            d, first = rest_of[i]
            over.add(self.keys[d], self.totals[d], self.befores[d] + first + at, self.ids[d][first + at:first + at + n].copy())
        return pieces, over, made + len(rooms)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, end_id: int, length: int, group_tokens: int, with_ids: bool):
    def run(batches):
        codec = ByteCodec.of(path)
        first_sequence = TaskContext.get().partitionId() << _TASK_SHIFT
        group = _Group(length)

        def flush(last: bool):
            nonlocal group, first_sequence
            pieces, over, made = group.pack(last)
            if pieces:
                d, at, n, s, offset = (np.array(x, np.int64) for x in zip(*pieces))
                before, totals = np.array(group.befores, np.int64), np.array(group.totals, np.int64)
                keys = pa.array([group.keys[i] for i in d], pa.int64())
                raw = [group.ids[i][a:a + k] for i, a, k in zip(d.tolist(), at.tolist(), n.tolist())]
                cols = [keys, pa.array(before[d] + at), pa.array(n), pa.array([zlib.crc32(r.tobytes()) for r in raw], pa.int64()),
                        pa.array(totals[d]), pa.array(first_sequence + s), pa.array(offset)]
                names = [c.split()[0] for c in _PIECES.split(", ")]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()),
                                                         pa.array(np.concatenate(raw).astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
            first_sequence += made
            group = over

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for lo, hi, data, offsets in text_chunks(batch, limit=CHUNK):
                ids, n = codec.encode(data, offsets)
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                ends = np.cumsum(n + 1)
                for key, a, b in zip(keys[lo:hi], (ends - n - 1).tolist(), ends.tolist()):
                    group.add(key, b - a, 0, ids[a:b])
                if group.tokens >= group_tokens or len(group.keys) >= GROUP_DOCUMENTS:
                    yield from flush(False)
        if group.tokens:
            yield from flush(True)
    return released(run, remembers=True)


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID, length: int = LENGTH,
                   group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) in sequences of ``length`` tokens; ``with_ids`` adds each piece's ids."""
    on_workers(docs.sparkSession)
    schema = _PIECES + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _pack(path or byte_vocabulary(), end_id, length, group_tokens, with_ids), schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids and the lengths of the pieces (the borders of attention) of pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))        # a sequence's pieces: its length bounds them
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.length").alias("lengths"))


def op13_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over all `documents`: the pieces of sequences of 2048 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
