"""Operator 11 - product codes of vectors, entries found by a GNAT over each codebook.

Components become floor(1024 x); a vector is cut into ``PARTS`` consecutive parts,
each coded by the index of the nearest entry of its codebook (squared Euclidean
distance in whole numbers, ties to the lower index). Codebooks start as the parts
of the ``ENTRIES`` smallest vec_ids and are moved ``ROUNDS`` times to the floor of
their parts' means; an entry without parts stays.

Assignment searches a geometric near-neighbour access tree over the entries: a node
holds ``DEGREE`` split points, far apart; every other entry is the child of the
nearest one, and for each (split point, child) the node stores the least and the
greatest distance between the point and the child's entries. From a query's
distances to the split points, a child whose range lies *strictly* farther than the
best distance so far is left out with all its subtree. Distances are square roots
of whole numbers, widened by ``SLACK`` on the side that keeps a child; what is left
is compared by (squared distance, index) in whole numbers, so ties are exact.

Scale. Each of the ROUNDS + 1 passes reads the vectors where they are (two columns),
assigns Arrow batches in numpy, and sends (part, entry, position, sum, count) per
task: the sizes of the codebooks, not of the data. Codebooks are the one thing the
driver holds (``PARTS x ENTRIES`` entries) and ships to the tasks. The last pass
writes the narrow coded rows, from which the errors of labels are summed (partial
sums first) and joined back: broadcast if they are counted few, else by a salted
join, so no label's rows meet in one task.

Cases. Rows whose vector is null, or holds a null or non-finite component, are
dropped. Vectors of each length have codebooks of their own; a length that PARTS
does not divide is cut at the floors of its quarters, and parts of an empty vector
are empty. Fewer vectors than entries: as many entries as distinct vec_ids. Of rows
that repeat a vec_id, the smallest vector starts the entry; all are coded. Rows
without a vec_id are coded too; their smallest vector starts an entry after all ids.
Components are held within +-2**24 (x beyond +-16,384), where the sums of squares
are exact. Null labels are one label. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.llm.common import BROADCAST_IDS, on_workers, read_table, released
from corpusfold.session import cut_lineage

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
DEGREE = 16
LEAF = 12                       # entries of a node that are compared one by one
SLACK = 1e-9
MOST = 1 << 24
_ROWS = 4096                    # vectors searched at once
_SALTS = 32
_EXACT = float(1 << 53)


def finite_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows kept, values one after the other, start, length of each kept row) of a list column."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    flat = column.values
    bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False).astype(float)) | flat.is_null().to_numpy(zero_copy_only=False)
    before = np.r_[0, np.cumsum(bad)]
    keep = (before[offsets[1:]] == before[offsets[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(keep)
    return rows, flat.to_numpy(zero_copy_only=False), offsets[:-1][rows], np.diff(offsets)[rows]


def whole_vectors(column: pa.Array, dim: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(rows of this length that are kept, their components as whole numbers)."""
    rows, flat, start, length = finite_vectors(column)
    mine = length == dim
    values = flat[start[mine][:, None] + np.arange(dim)] if dim else np.zeros((int(mine.sum()), 0))
    return rows[mine], np.clip(np.floor(values * scale), -MOST, MOST).astype(np.int64)


def cuts(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    at = [i * dim // parts for i in range(parts + 1)]
    return list(zip(at, at[1:]))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number squared distances of all rows of a and b (as products of doubles where these are exact)."""
    most = max((int(np.abs(x).max()) if x.size else 0) for x in (a, b))
    if 4 * most * most * max(1, a.shape[1]) < _EXACT:
        fa, fb = a.astype(np.float64), b.astype(np.float64)
        return ((fa * fa).sum(axis=1)[:, None] - 2 * (fa @ fb.T) + (fb * fb).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


class Gnat:
    """The tree over some entries of a codebook."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None):
        self.index = np.arange(len(entries)) if index is None else index
        self.points = entries[self.index]
        self.children: list[Gnat] = []
        if len(self.index) <= LEAF:
            return
        d2 = squared_distances(self.points, self.points)
        # split points: each the farthest from those before (equal ones once); the first is the lowest index
        split, far = [0], d2[0].copy()
        while len(split) < DEGREE and far.max() > 0:
            split.append(int(far.argmax()))
            far = np.minimum(far, d2[split[-1]])
        if len(split) == 1:                     # all entries are equal
            return
        rest = np.setdiff1d(np.arange(len(self.index)), split)
        owner = d2[np.ix_(rest, split)].argmin(axis=1)
        low, high = [], []
        for j in range(len(split)):
            mine = rest[owner == j]
            if not len(mine):
                continue
            reach = np.sqrt(d2[np.ix_(split, mine)].astype(np.float64))
            low.append(reach.min(axis=1) * (1 - SLACK))
            high.append(reach.max(axis=1) * (1 + SLACK))
            self.children.append(Gnat(entries, self.index[mine]))
        self.low, self.high = np.array(low), np.array(high)          # child x split point
        self.index, self.points = self.index[split], self.points[split]

    def search(self, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, entry: np.ndarray) -> int:
        """Lower ``best`` (squared distance) and ``entry`` of the given rows of ``queries``; returns the distances computed."""
        d2 = squared_distances(queries[rows], self.points)
        work = d2.size
        near = d2.min(axis=1)
        index = np.where(d2 == near[:, None], self.index, np.iinfo(np.int64).max).min(axis=1)
        better = (near < best[rows]) | ((near == best[rows]) & (index < entry[rows]))
        best[rows[better]], entry[rows[better]] = near[better], index[better]
        if not self.children:
            return work
        reach = np.sqrt(d2.astype(np.float64))
        close, away = reach * (1 - SLACK), reach * (1 + SLACK)
        gaps = [np.maximum(close - high, low - away).max(axis=1) for low, high in zip(self.low, self.high)]
        for j in np.argsort([g.mean() for g in gaps], kind="stable"):
            live = gaps[j] <= np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK)
            if live.any():
                work += self.children[j].search(queries, rows[live], best, entry)
        return work

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row; the lower index of equal distances."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        entry = np.full(len(queries), np.iinfo(np.int64).max)
        for at in range(0, len(queries), _ROWS):
            self.search(queries, np.arange(at, min(len(queries), at + _ROWS)), best, entry)
        return entry, best


Codebooks = list[np.ndarray]            # entries x components of each part


def _smallest(dim: int):
    """The smallest distinct ids of a task's kept vectors."""
    def run(batches):
        least = np.zeros(0, np.int64)
        for batch in batches:
            rows, _, _, length = finite_vectors(batch.column("embedding"))
            ids = batch.column("vec_id").take(pa.array(rows[length == dim])).drop_null().to_numpy()
            least = np.unique(np.r_[least, ids])[:ENTRIES]
        yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64())], names=["vec_id"])
    return run


def _first_entries(vectors: DataFrame, dim: int) -> Codebooks:
    """The parts of the vectors of the smallest vec_ids: a bounded number of rows for the driver."""
    smallest = vectors.select("vec_id", "embedding").mapInArrow(_smallest(dim), "vec_id long")
    ids = [r.vec_id for r in smallest.distinct().sort("vec_id").limit(ENTRIES).collect()]
    chosen = F.col("vec_id").isin(ids) if len(ids) == ENTRIES else F.col("vec_id").isin(ids) | F.col("vec_id").isNull()
    found = (vectors.select("vec_id", "embedding").where(chosen).mapInArrow(_kept(dim), "vec_id long, vector array<long>")
             .groupBy("vec_id").agg(F.min("vector").alias("vector")).sort(F.col("vec_id").asc_nulls_last()).limit(ENTRIES))
    rows = [r.vector for r in found.collect()]
    rows = np.array(rows, np.int64).reshape(len(rows), dim)
    return [rows[:, a:b].copy() for a, b in cuts(dim)]


def _kept(dim: int):
    def run(batches):
        for batch in batches:
            rows, values = whole_vectors(batch.column("embedding"), dim)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dim, pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), lists], names=["vec_id", "vector"])
    return run


def _sums(dim: int, books: Codebooks):
    """Sum and count of the parts of each entry, for the rows of a task."""
    def run(batches):
        trees = [Gnat(b) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            _, values = whole_vectors(batch.column("embedding"), dim)
            for p, (a, b) in enumerate(cuts(dim)):
                entry, _ = trees[p].nearest(values[:, a:b])
                count[p] += np.bincount(entry, minlength=len(books[p]))
                for k in range(a, b):           # sums of doubles are exact below 2**53
                    total[p][:, k - a] += np.bincount(entry, values[:, k], len(books[p])).astype(np.int64)
        for p, (n, sums) in enumerate(zip(count, total)):
            hit = np.flatnonzero(n)
            width = sums.shape[1]
            cols = [np.full(len(hit) * width, p), np.repeat(hit, width), np.tile(np.arange(width), len(hit)), sums[hit].ravel(),
                    np.repeat(n[hit], width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["part", "entry", "pos", "total", "n"])
    return released(run)


def learn_codebooks(vectors: DataFrame, dim: int, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after the given rounds over the vectors (vec_id, embedding) of one length."""
    books = _first_entries(vectors, dim)
    for _ in range(rounds):
        sums = vectors.select("embedding").mapInArrow(_sums(dim, books), "part long, entry long, pos long, total long, n long")
        moved = sums.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in moved.collect():               # one number a component of the codebooks
            books[r.part][r.entry, r.pos] = r.total // r.n
    return books


def books_sha256(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def _codes(dim: int, books: Codebooks):
    digest = books_sha256(books)

    def run(batches):
        trees = [Gnat(b) for b in books]
        for batch in batches:
            rows, values = whole_vectors(batch.column("embedding"), dim)
            code = np.zeros((len(rows), len(books)), np.uint8)
            error = np.zeros(len(rows), np.int64)
            for p, (a, b) in enumerate(cuts(dim)):
                entry, d2 = trees[p].nearest(values[:, a:b])
                code[:, p] = entry
                error += d2
            raw = code.tobytes().hex()
            step = 2 * len(books)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), batch.column("label").take(at), pa.array([raw[i * step:(i + 1) * step] for i in range(len(rows))], pa.string()),
                 pa.array(error), pa.array([digest] * len(rows), pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])
    return released(run)


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of every kept row of ``vectors`` (vec_id, embedding, label)."""
    on_workers(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long"))
    lengths = [r.dim for r in vectors.mapInArrow(_lengths, "dim long").distinct().sort("dim").collect()]
    out = None
    for dim in lengths:
        books = learn_codebooks(vectors, dim, rounds)
        coded = vectors.mapInArrow(_codes(dim, books), "vec_id long, label long, code string, error long, codebooks_sha256 string")
        out = coded if out is None else out.unionByName(coded)
    if out is None:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                              F.lit("").alias("codebooks_sha256")).where("false")
    return out


def _lengths(batches):
    seen: set[int] = set()
    for batch in batches:
        seen.update(np.unique(finite_vectors(batch.column("embedding"))[3]).tolist())
    yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], names=["dim"])


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels (nulls are one label)."""
    sums = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    known, none = F.coalesce("label", F.lit(0)).alias("__label"), F.col("label").isNull().alias("__none")
    keyed, sums = coded.select("*", known, none), sums.select(known, none, "label_error")
    if sums.count() <= BROADCAST_IDS:
        return keyed.join(F.broadcast(sums), ["__label", "__none"]).drop("__label", "__none")
    sums = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    keyed = keyed.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(_SALTS)).cast("int"))
    return keyed.join(sums, ["__label", "__none", "__salt"]).drop("__label", "__none", "__salt")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over all `embeddings`: four-part codes of 256 entries, and the errors of rows and labels."""
    coded = cut_lineage(encode(read_table(spark, sf_dir, "embeddings")))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
