"""Operator 4 - benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Finds the places of documents that are within ``MAX_EDIT`` of a benchmark item's
words in edit distance (words: runs of ASCII letters and digits and of bytes
beyond ASCII, A-Z lower-cased; each code point of a script without spaces is a word).

Method. The CGK random walk reads a window from its start: at step t it puts out
the word under its pointer and moves on by the random bit r(t, word). Windows at a
small edit distance give walks at a small Hamming distance. Each of ``repeats``
walks (own random bits) samples ``SAMPLED`` of its first T outputs, spread over them;
equal samples make a candidate. An item is entered from each of its words from which
T steps rarely leave it, so that its windows lie along the whole item and edits in one
part leave those of the others.
The number of repeats of a band is measured (``repeats``): the fewest that find ``RECALL``
of passages at exactly ``MAX_EDIT`` with evenly spread substitutions. Each candidate is verified: the item against the document around
the aligned place, by the edit distance of words, over the whole item.

``BANDS`` gives T and the words between the windows of a document by the length of the
item: a longer item meets several windows anyway, a short one needs them at every word.
Candidates of an item at overlapping places of a document are verified together.

Scale. Documents are read once per block of items, without a shuffle before the
matches. The signatures of a block of items are broadcast; a block holds at most
``BLOCK_BYTES`` of item text (12 bytes a word and repeat in the index), and a larger
benchmark is taken in several blocks, each with a pass over the documents.

Cases. Null or blank documents match nothing, nor do items that are null or have no
word. Items of fewer than ``MIN_WORDS`` words, for which the distance allows no edit, are
looked for exactly, from every word. A document shorter than an item can
match only within the distance. Rows that share a doc_id are one document in the
result. Repeated items match each for itself; of equal places the first counts.
Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.llm.common import NOT_ALNUM, U64, Words, on_workers, ragged_index, read_table, released, sequence_hash, text_chunks

MAX_EDIT = 0.2
RECALL = 0.95
TRIALS = 1000                   # passages that measure the number of repeats
MOST_REPEATS = 64
SAMPLED = 4
MIN_WORDS = 4
BANDS = ((MIN_WORDS, 8, 1), (12, 12, 3), (24, 16, 6))   # from words of an item, steps of a walk, words between windows
MOST_STEPS = max(t for _, t, _ in BANDS)
STEPS_PER_WORD = 1.6            # a walk moves on at every second step; this many rarely leave the window
BLOCK_BYTES = 2 << 20
PAIRS = 1 << 16                 # candidates held at once before equal ones are dropped
_PAD = U64(0)

class Walk:
    """The random bits and sampled steps of one repeat, alike on all workers."""

    def __init__(self, repeat: int, steps: int):
        rng = np.random.default_rng([7919 + repeat, steps])
        self.bits = rng.integers(1, 2**63, steps, dtype=np.uint64) * U64(2) + U64(1)
        # one step of each quarter, so that the samples are of different words
        self.sampled = {int(steps * (q + rng.random()) / SAMPLED) for q in range(SAMPLED)}
        self.salt = U64(rng.integers(1, 2**63)) * U64(2) + U64(1)

    def signatures(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The signature of the window at each start. ``words`` is padded."""
        at, acc = starts.copy(), np.full(len(starts), self.salt, U64)
        for step in range(max(self.sampled) + 1):
            w = words[at]
            if step in self.sampled:
                acc += w
                acc *= U64(0x9E3779B97F4A7C15)
                acc ^= acc >> U64(29)
            at += ((w * self.bits[step]) >> U64(63)).astype(at.dtype)
        return acc


class Exact:
    """In place of a walk: windows of as many words as a short item has."""

    def __init__(self, length: int):
        self.length = length

    def signatures(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return sequence_hash(words, starts, self.length)


def _padded(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with room for a walk after each document, and where each document begins."""
    begin = np.cumsum(counts + MOST_STEPS) - (counts + MOST_STEPS)
    out = np.full(int((counts + MOST_STEPS).sum()), _PAD, U64)
    src = np.cumsum(counts) - counts
    out[np.arange(len(hashes)) + np.repeat(begin - src, counts)] = hashes
    return out, begin


def band_of(n_words: np.ndarray) -> np.ndarray:
    return np.searchsorted([lo for lo, _, _ in BANDS], n_words, "right") - 1


def entries(n_words: np.ndarray, steps: int) -> np.ndarray:
    """Number of words of each item from which it is entered: those before which a walk has room, at least the first."""
    return np.maximum(n_words - math.ceil(steps / STEPS_PER_WORD) + 1, 1)


def _positions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, 0 .. count - 1) of each position."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


@functools.lru_cache
def repeats(band: int, recall: float = RECALL) -> int:
    """The fewest walks that find ``recall`` of the passages at MAX_EDIT, at each of the lengths at which a band begins.

    Longer items of a band have more windows. Two standard errors are left for chance.
    """
    lo, steps, stride = BANDS[band]
    goal = min(recall + 2 * math.sqrt(recall * (1 - recall) / TRIALS), 1.0)
    walks = [Walk(r, steps) for r in range(MOST_REPEATS)]
    most = 1
    for n in range(lo, lo + 4):
        rng = np.random.default_rng([20240611, n])
        new = lambda size: rng.integers(1, 2**63, size, dtype=np.uint64)
        items = new((TRIALS, n))
        texts = new((TRIALS, stride + n + MOST_STEPS))
        # a passage begins anywhere between two windows
        place = rng.integers(0, stride, TRIALS)[:, None] + np.arange(n)
        kept = rng.random((TRIALS, n)).argsort(1) >= int(MAX_EDIT * n)
        np.put_along_axis(texts, place, np.where(kept, items, np.take_along_axis(texts, place, 1)), 1)
        padded, begin = _padded(items.ravel(), np.full(TRIALS, n))
        at = begin[:, None] + np.arange(int(entries(np.array(n), steps)))
        windows = np.arange(0, stride + n, stride) + np.arange(TRIALS)[:, None] * texts.shape[1]
        found = np.zeros(TRIALS, bool)
        for r, walk in enumerate(walks, 1):
            own = walk.signatures(padded, at.ravel()).reshape(at.shape)
            other = walk.signatures(texts.ravel(), windows.ravel()).reshape(windows.shape)
            found |= (own[:, :, None] == other[:, None, :]).any((1, 2))
            if found.mean() >= goal:
                break
        most = max(most, r)
    return most


def edit_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the part of ``text`` nearest to ``item``; the first of equals."""
    n, m = len(item), len(text)
    cost = list(range(n + 1))
    from_ = [0] * (n + 1)
    best = (n, 0, 0)
    it = item.tolist()
    for j, c in enumerate(text.tolist(), 1):
        diag, diag_from = cost[0], from_[0]
        cost[0], from_[0] = 0, j
        for i in range(1, n + 1):
            sub, sub_from = diag + (it[i - 1] != c), diag_from
            diag, diag_from = cost[i], from_[i]
            drop, skip = cost[i] + 1, cost[i - 1] + 1
            if sub <= drop and sub <= skip:
                cost[i], from_[i] = sub, sub_from
            elif skip <= drop:
                cost[i], from_[i] = skip, from_[i - 1]
            else:
                cost[i] = drop
        if cost[n] < best[0]:
            best = (cost[n], from_[n], j)
    return best


class Index:
    """Signatures of a block of items, by words between windows: of each walk, the entered words, over all items' words."""

    def __init__(self, items: list[tuple], recall: float = RECALL):
        data = "\n".join(t for _, t in items).encode() if items else b""
        offsets = np.r_[0, np.cumsum([len(t.encode()) + 1 for _, t in items])] if items else np.zeros(1, np.int64)
        raw = np.frombuffer(data + b"\n", np.uint8)
        words = Words(raw, offsets.astype(np.int64), lower=True, space=NOT_ALNUM, units=True)
        h = words.hashes()
        self.ids, self.words = [], []
        for (key, _), lo, hi in zip(items, words.first[:-1], words.first[1:]):
            if hi > lo:
                self.ids.append(key)
                self.words.append(h[lo:hi])
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.first = np.cumsum(lengths) - lengths
        self.tables: dict[int, list[tuple]] = {}
        # 512 bits an item: those of its words are set
        self.member = np.zeros((len(self.words), 8), U64)
        if not self.words:
            return
        bit = np.concatenate(self.words) >> U64(55)
        np.bitwise_or.at(self.member, (np.repeat(np.arange(len(lengths)), lengths), (bit >> U64(6)).astype(np.int64)), U64(1) << (bit & U64(63)))
        padded, begin = _padded(np.concatenate(self.words), lengths)
        for band, (_, steps, stride) in enumerate(BANDS):
            own = np.flatnonzero(band_of(lengths) == band)
            for r in range(repeats(band, recall) if len(own) else 0):
                self._add(stride, Walk(r, steps), padded, begin, own, entries(lengths[own], steps))
        for n in range(1, MIN_WORDS):
            own = np.flatnonzero(lengths == n)
            if len(own):
                self._add(1, Exact(n), padded, begin, own, np.ones(len(own), np.int64))

    def _add(self, stride: int, walk: Walk | Exact, padded: np.ndarray, begin: np.ndarray, own: np.ndarray, n_entries: np.ndarray) -> None:
        k, shift = _positions(n_entries)
        item = own[k]
        # a mask of some 16 places an entry keeps most windows from the search
        top = U64(64 - min(max(int(16 * len(item)).bit_length(), 12), 20))
        sig = walk.signatures(padded, begin[item] + shift)
        order = np.argsort(sig, kind="stable")
        seen = np.zeros(1 << int(U64(64) - top), bool)
        seen[(sig >> top).astype(np.int64)] = True
        self.tables.setdefault(stride, []).append((walk, sig[order], (self.first[item] + shift)[order].astype(np.int32), top, seen))

    def candidates(self, padded: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distinct (document, item, first word of the item's place) of windows whose signature equals an item's, in order."""
        out = [np.zeros((0, 3), np.int64)]
        for stride, tables in self.tables.items():
            doc, pos = _positions(-(-counts // stride))
            pos *= stride
            for walk, sig, entry, top, seen in tables:
                found = walk.signatures(padded, begin[doc] + pos)
                hit = np.flatnonzero(seen[(found >> top).astype(np.int64)])
                lo, hi = np.searchsorted(sig, found[hit], "left"), np.searchsorted(sig, found[hit], "right")
                hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
                part = np.cumsum(n) // PAIRS
                for p in np.unique(part):
                    h, m = hit[part == p], n[part == p]
                    e = entry[ragged_index(lo[part == p], m)].astype(np.int64)
                    item = np.searchsorted(self.first, e, "right") - 1
                    at = np.repeat(pos[h], m) - (e - self.first[item])
                    out.append(np.unique(np.stack([np.repeat(doc[h], m), item, at], 1), axis=0))
                    if sum(map(len, out)) > PAIRS:
                        out = [np.unique(np.concatenate(out), axis=0)]
        return np.unique(np.concatenate(out), axis=0)

    def places(self, found: np.ndarray, text: np.ndarray, first: np.ndarray):
        """(document, item, places, left, right) of ordered candidates; places whose surroundings overlap come together.

        Only where the part from left to right has enough words of the item: each that an alignment keeps is one.
        """
        doc, item, at = found.T
        n = np.fromiter(map(len, self.words), np.int64, len(self.words))[item]
        most = (MAX_EDIT * n).astype(np.int64)
        apart = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(at) > (n + 2 * most)[1:])
        cuts = np.flatnonzero(np.r_[len(doc) > 0, apart])
        ends = np.r_[cuts[1:], len(doc)][:len(cuts)]
        doc, item, n, most = doc[cuts], item[cuts], n[cuts], most[cuts]
        right = np.clip(at[ends - 1] + n + most, 0, np.diff(first)[doc])
        left = np.clip(at[cuts] - most, 0, right)
        part = np.cumsum(right - left) // PAIRS
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            size = (right - left)[own]
            owner = np.repeat(own, size)
            bit = text[ragged_index((first[doc] + left)[own], size)] >> U64(55)
            there = (self.member[item[owner], (bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1) == 1
            kept = np.bincount(owner[there] - own[0], minlength=len(own))
            for g in own[kept >= (n - most)[own]]:
                yield int(doc[g]), int(item[g]), at[cuts[g]:ends[g]], int(left[g]), int(right[g])


_MATCH = "doc_id long, item_id long, distance int, start int, n_words int"


def _matches(index: Index):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                words = Words(data, offsets, lower=True, space=NOT_ALNUM, units=True)
                h = words.hashes()
                padded, begin = _padded(h, words.counts)
                rows = []
                for d, i, at, left, right in index.places(index.candidates(padded, begin, words.counts), h, words.first):
                    item = index.words[i]
                    most = int(MAX_EDIT * len(item))
                    text = h[words.first[d]:words.first[d + 1]]
                    same = next((int(x) for x in at if x >= 0 and np.array_equal(text[x:x + len(item)], item)), None)
                    if same is not None:
                        rows.append((d, i, 0, same, len(item)))
                        continue
                    part = text[left:right]
                    if np.isin(item, part).sum() < len(item) - most:        # each word that is not there is an edit
                        continue
                    dist, s, e = edit_place(item, part)
                    if dist <= most:
                        rows.append((d, i, dist, left + s, e - s))
                if rows:
                    d, i, dist, s, n = zip(*dict.fromkeys(rows))
                    ids = batch.column("doc_id")[lo:hi].take(pa.array(d))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([index.ids[x] for x in i], pa.int64()), *(pa.array(x, pa.int32()) for x in (dist, s, n))],
                        names=["doc_id", "item_id", "distance", "start", "n_words"])
    return released(run)


def find_leaks(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id and the nearest place of each item that each document holds: distance, start, n_words (in words)."""
    spark = docs.sparkSession
    on_workers(spark)
    docs = docs.select("doc_id", "text")
    items = benchmark.where("text is not null").select("item_id", "text")
    blocks = -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    out = None
    for b in range(max(blocks, 1)):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1))) == b).collect()
        index = Index(sorted((tuple(r) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1])), recall)
        found = docs.mapInArrow(_matches(index), _MATCH)
        out = found if out is None else out.union(found)
    place = F.min(F.struct("distance", "start", "n_words")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(place).select("doc_id", "item_id", "m.distance", "m.start", "m.n_words")


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over all `documents` and `benchmark`: each document that holds an item, and where."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
