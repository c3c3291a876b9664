"""Operator 12 - hard negatives mined through rotated one-bit codes.

Components become floor(256 x); a score is a whole-number inner product. Every row
gets a code. Its vector is rotated at random (signs and a Walsh-Hadamard transform)
and replaced by the signs u of its components (unit length) and their *alignment*
a, its inner product with u. What is left is rotated again and coded likewise,
``LEVELS`` times in all:

    x = a_1 u_1 + ... + a_L u_L + rest,    |rest| stored

One bit a component and level, and L + 1 numbers a row, stand for the vector. (With
one level the rest is 0.6 of the vector, and its interval covers nearly all scores.)

At each level, an anchor's vector, rotated alike, is rounded to ``PLANES`` bits a
component, so its inner product with u is a sum of popcounts over bit planes,
exactly. With e the rounding errors, Cauchy-Schwarz gives for every row, surely and
not just probably,

    |score - sum a_l <q_l, u_l>|  <=  |q| |rest| + sum a_l |e_l|

widened by ``SLACK`` for the arithmetic of doubles. Of a batch of rows, those whose
interval cannot reach the anchor's best list (the batch's k-th highest lower end, or
the k-th highest score so far), or that lies outside the asked range of scores, are
left out; the scores of all others are computed from the whole numbers.

1. *positives*: the best ``POSITIVES`` other rows of the anchor's label;
2. *negatives*: for each of them, the best ``NEGATIVES`` rows of other labels with
   LOW * positive <= 100 * score <= HIGH * positive.

Scale. The rows are encoded once into the shared folder (the index), and scanned
without a shuffle twice for every block of ``ANCHORS`` anchors: the stated query set
against all rows, in blocks. A block and its positives are what the driver holds and
ships, whatever the number of anchors; blocks follow one another. A task returns the
best lists of its rows only. No group of labels or equal vectors is ever gathered.

Cases. Rows with a null label, vec_id or vector, an empty vector, or a null or
non-finite component take no part. Where vec_id is divisible by ``SHIFTED``, the label
first becomes (label + 1) % ``CLASSES``. Rows meet only rows of the same length.
Repeated rows (equal vec_id, label and vector) count once; rows that repeat a vec_id
otherwise are rows, and anchors, of their own, but an anchor never meets its own
vec_id, and a list names an id with a score once. Ties go to the smaller vec_id. Scores are exact below 2**63, components being
held within +-2**24. An anchor without rows of its label, and a positive without rows
in its range, have no result. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusfold.llm.common import on_workers, read_table, released
from corpusfold.session import scratch_path

SCALE = 256
MOST = 1 << 24
LEVELS = 6
PLANES = 8
SLACK = 1e-9
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90              # hundredths of the positive's score
SHIFTED, CLASSES, EVERY = 7, 10, 100
ANCHORS = 8192                  # anchors of a block
_ANCHOR_ROWS = 128              # anchors met by a batch at once
_BATCH_ROWS = 2048
_SEED = 20250117


# ---------------------------------------------------------------------- codes

def _hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows (a power of two long)."""
    n, width, h = *x.shape, 1
    x = x.copy()
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, width) / np.sqrt(width)


def width_of(dim: int) -> int:
    """Bits of a code: the next power of two, 64 at least."""
    return max(64, 1 << (dim - 1).bit_length())


def rotate(x: np.ndarray, level: int) -> np.ndarray:
    """The rows under the rotation that leads to this level (the first one fills them up with zeros)."""
    width = width_of(x.shape[1])
    out = np.zeros((len(x), width))
    out[:, :x.shape[1]] = x
    for turn in range(2 if level == 0 else 1):
        out = _hadamard(out * np.random.default_rng([_SEED, width, level, turn]).choice([-1.0, 1.0], width))
    return out


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits (rows x width) as rows x width / 64 words."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def encode(vectors: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sign words: rows x levels x words, alignments: rows x levels, length of the rest) of whole-number rows."""
    left, signs, align = vectors, [], []
    for level in range(levels):
        left = rotate(left, level)
        up = left >= 0
        a = np.abs(left).sum(axis=1) / np.sqrt(left.shape[1])
        left = left - np.where(up, 1.0, -1.0) * (a / np.sqrt(left.shape[1]))[:, None]
        signs.append(_words(up))
        align.append(a)
    return np.stack(signs, axis=1), np.stack(align, axis=1), np.sqrt((left * left).sum(axis=1))


class _Planes:
    """Rows rounded to ``low + step * unit``: the bit planes of the units, and the length of the error."""

    def __init__(self, x: np.ndarray, planes: int):
        self.low = x.min(axis=1)
        self.step = np.maximum((x.max(axis=1) - self.low) / ((1 << planes) - 1), 1e-300)
        units = np.rint((x - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        error = x - (self.low[:, None] + self.step[:, None] * units)
        self.error = np.sqrt((error * error).sum(axis=1))
        self.units = units.sum(axis=1)
        self.bits = [_words((units >> b & 1).astype(bool)) for b in range(planes)]


class Questions:
    """Anchors of one length, rotated and rounded to bit planes for each level."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, levels: int = LEVELS, planes: int = PLANES):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.width = width_of(vectors.shape[1])
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.levels, turned = [], vectors
        for level in range(levels):
            turned = rotate(turned, level)
            self.levels.append(_Planes(turned, planes))

    def intervals(self, some: slice, signs: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of the scores of some anchors with the coded rows."""
        score = np.zeros((some.stop - some.start, len(rest)))
        norm = self.norm[some, None]
        half = norm * (rest + SLACK * (align.sum(axis=1) + rest)) + 1e-6
        root = np.sqrt(self.width)
        for level, q in enumerate(self.levels):
            low, step, units = q.low[some, None], q.step[some, None], q.units[some, None]
            ups = np.bitwise_count(signs[:, level]).sum(axis=1, dtype=np.int64)
            both = np.zeros(score.shape, np.int32)
            for b, plane in enumerate(q.bits):
                for w in range(signs.shape[2]):
                    both += np.left_shift(np.bitwise_count(plane[some, w, None] & signs[None, :, level, w]), b, dtype=np.int32)
            # <q_l, u> = sum over components of (low + step * unit) * (2 bit - 1) / sqrt(width)
            score += (low * (2 * ups - self.width) + step * (2 * both - units)) * (align[:, level] / root)
            half += q.error[some, None] * align[:, level]
        return score - half, score + half


# --------------------------------------------------------------------- search

class Best:
    """The best k (score, id) of each list seen so far, ties to the smaller id."""

    def __init__(self, lists: int, k: int):
        self.score = np.full((lists, k), -np.iinfo(np.int64).max)
        self.id = np.full((lists, k), np.iinfo(np.int64).max)

    def kth(self, lists) -> np.ndarray:
        return self.score[lists, -1].astype(np.float64)

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched, at = np.unique(lists, return_inverse=True)
        k = self.score.shape[1]
        who = np.r_[np.repeat(np.arange(len(touched)), k), at]
        s, i = np.r_[self.score[touched].ravel(), score], np.r_[self.id[touched].ravel(), ids]
        order = np.lexsort((i, -s, who))
        who, s, i = who[order], s[order], i[order]
        empty = np.iinfo(np.int64).max
        fresh = np.r_[True, (who[1:] != who[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (i[1:] == empty)][:len(who)]
        who, s, i = who[fresh], s[fresh], i[fresh]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        keep = nth < k
        self.score[touched[who[keep]], nth[keep]] = s[keep]
        self.id[touched[who[keep]], nth[keep]] = i[keep]


def _kth_highest(values: np.ndarray, k: int) -> np.ndarray:
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), -np.inf)


def _scores(q: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    out = np.empty(len(row), np.int64)
    for at in range(0, len(row), 1 << 14):
        s = slice(at, at + (1 << 14))
        out[s] = (q[row[s]] * c[col[s]]).sum(axis=1)
    return out


def _coded(batch: pa.RecordBatch, dim: int):
    """Columns of the coded rows of one length."""
    at = pa.array(np.flatnonzero(batch.column("dim").to_numpy() == dim))
    rows = batch.take(at)
    n = rows.num_rows
    if not n:
        return None
    ids, labels, rest = (rows.column(c).to_numpy() for c in ("vec_id", "label", "rest"))
    vectors = rows.column("vector").flatten().to_numpy().reshape(n, dim)
    signs = rows.column("signs").flatten().to_numpy().view(np.uint64).reshape(n, -1, width_of(dim) // 64)
    return ids, labels, vectors, signs, rows.column("align").flatten().to_numpy().reshape(n, -1), rest


def _slices(batches, dims: list[int]):
    for batch in batches:
        for dim in dims:
            coded = _coded(batch, dim)
            if coded is not None:
                if len(np.unique(coded[0])) < len(coded[0]):         # repeated rows would fill a list's bound
                    whole = np.column_stack([coded[0], coded[1], coded[2]])
                    once = np.sort(np.unique(whole, axis=0, return_index=True)[1])
                    coded = tuple(x[once] for x in coded)
                for at in range(0, len(coded[0]), _BATCH_ROWS):
                    yield dim, tuple(x[at:at + _BATCH_ROWS] for x in coded)


def _lists(numbers: dict[int, np.ndarray], best: dict[int, Best], lists_of: dict[int, np.ndarray]):
    """The lists as rows (anchor number, list of the anchor, id, score)."""
    for dim, b in best.items():
        at, nth = np.nonzero(b.id != np.iinfo(np.int64).max)
        cols = [numbers[dim][at], lists_of[dim][at], b.id[at, nth], b.score[at, nth]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "list", "vec_id", "score"])


def _positives(block, k: int):
    def run(batches):
        asked, numbers = block.value
        best = {d: Best(len(q.ids), k) for d, q in asked.items()}
        for dim, (ids, labels, vectors, signs, align, rest) in _slices(batches, list(asked)):
            q = asked[dim]
            for a in range(0, len(q.ids), _ANCHOR_ROWS):
                some = slice(a, min(len(q.ids), a + _ANCHOR_ROWS))
                at = np.flatnonzero(np.isin(labels, q.labels[some]))          # anchors stand in the order of their labels
                if not len(at):
                    continue
                wanted = (q.labels[some, None] == labels[at]) & (q.ids[some, None] != ids[at])
                low, high = q.intervals(some, signs[at], align[at], rest[at])
                least = np.maximum(_kth_highest(np.where(wanted, low, -np.inf), k), best[dim].kth(some))
                row, col = np.nonzero(wanted & (high >= least[:, None]))
                best[dim].add(row + a, _scores(q.vectors[some], vectors, row, at[col]), ids[at[col]])
        yield from _lists(numbers, best, {d: np.zeros(len(q.ids), np.int64) for d, q in asked.items()})
    return released(run)


def score_range(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole scores s with LOW * positive <= 100 * s <= HIGH * positive."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def _negatives(block, k: int):
    """``block``: as for positives, and for each length the scores of the lists: anchor row x list, and which lists there are."""
    def run(batches):
        asked, numbers, positive, there = block.value
        lists = next(iter(positive.values())).shape[1]
        best = {d: Best(p.size, k) for d, p in positive.items()}
        for dim, (ids, labels, vectors, signs, align, rest) in _slices(batches, list(asked)):
            q = asked[dim]
            floor, cap = score_range(positive[dim])
            for a in range(0, len(q.ids), _ANCHOR_ROWS):
                some = slice(a, min(len(q.ids), a + _ANCHOR_ROWS))
                wanted = (q.labels[some, None] != labels) & (q.ids[some, None] != ids)
                low, high = q.intervals(some, signs, align, rest)
                live = []
                for j in range(lists):
                    f, c = floor[some, j, None], cap[some, j, None]
                    sure = wanted & (low >= f) & (high <= c)
                    at = np.arange(some.start, some.stop) * lists + j
                    least = np.maximum(_kth_highest(np.where(sure, low, -np.inf), k), best[dim].kth(at))
                    live.append(wanted & there[dim][some, j, None] & (high >= np.maximum(f, least[:, None])) & (low <= c))
                row, col = np.nonzero(np.logical_or.reduce(live))
                score = _scores(q.vectors[some], vectors, row, col)
                for j in range(lists):
                    mine = live[j][row, col] & (score >= floor[some, j][row]) & (score <= cap[some, j][row])
                    best[dim].add((row[mine] + a) * lists + j, score[mine], ids[col[mine]])
        rows = {d: np.repeat(n, lists) for d, n in numbers.items()}
        yield from _lists(rows, best, {d: np.tile(np.arange(lists), len(n)) for d, n in numbers.items()})
    return released(run)


# ------------------------------------------------------------------- operator

_CODED = "vec_id long, label long, dim int, vector array<long>, signs array<long>, align array<double>, rest double"


def _encode_rows(levels: int):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
                vectors = rows.column("vector").flatten().to_numpy().reshape(-1, dim)
                signs, align, rest = encode(vectors, levels)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x[0].size, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), rows.column("dim"), rows.column("vector"),
                                                  lists(signs.view(np.int64)), lists(align), pa.array(rest)],
                                                 names=["vec_id", "label", "dim", "vector", "signs", "align", "rest"])
    return released(run)


def coded_rows(vectors: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The index: each row that takes part, with its code."""
    x = F.col("embedding")
    number = lambda v: v.cast("double")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(number(v)) & (F.abs(number(v)) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(number(v) * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("long"))
    label = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    rows = (vectors.where((F.size(x) > 0) & fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
            .select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), whole.alias("vector")))
    return rows.select("vec_id", "label", F.size("vector").alias("dim"), "vector").mapInArrow(_encode_rows(levels), _CODED)


def _block_of(rows: list, levels: int) -> tuple[dict[int, Questions], dict[int, np.ndarray]]:
    """Questions of each length, and the numbers of their anchors in the block."""
    dims = np.array([r.dim for r in rows])
    asked, numbers = {}, {}
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        of = [rows[i] for i in at]
        asked[dim] = Questions(np.array([r.vec_id for r in of]), np.array([r.label for r in of]), np.array([r.vector for r in of], np.int64), levels)
        numbers[dim] = at
    return asked, numbers


_LIST = "anchor long, list long, vec_id long, score long"


def _best_of_all(lists: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "vec_id")
    return lists.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, levels: int = LEVELS,
                   anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors of ``vectors``
    (vec_id, label, embedding), the rows whose vec_id is divisible by ``EVERY``."""
    spark = vectors.sparkSession
    on_workers(spark)
    index, questions, out = (scratch_path(spark, f"negatives-{x}") for x in ("index", "questions", "found"))
    coded_rows(vectors, levels).write.parquet(index)
    coded = spark.read.schema(_CODED).parquet(index)
    own = coded.where(F.col("vec_id") % EVERY == 0).select("vec_id", "label", "dim", "vector").distinct()
    own.withColumn("hash", F.xxhash64("vec_id", "vector")).write.parquet(questions)
    own = spark.read.parquet(questions)
    blocks = -(-own.count() // anchors)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for part in range(blocks):
        rows = own.where(F.pmod("hash", F.lit(blocks)) == part).sort("label", "vec_id", "hash").collect()
        asked, numbers = _block_of(rows, levels)
        block = spark.sparkContext.broadcast((asked, numbers))
        found = _best_of_all(coded.mapInArrow(_positives(block, positives), _LIST), positives)
        best = found.orderBy("anchor", "rank").collect()            # `positives` rows an anchor of the block
        if not best:
            continue
        of = {d: np.zeros((len(n), positives), np.int64) for d, n in numbers.items()}
        there = {d: np.zeros((len(n), positives), bool) for d, n in numbers.items()}
        place = {int(x): (d, i) for d, n in numbers.items() for i, x in enumerate(n)}
        for r in best:
            d, i = place[r.anchor]
            of[d][i, r.rank - 1], there[d][i, r.rank - 1] = r.score, True
        block = spark.sparkContext.broadcast((asked, numbers, of, there))
        mined = _best_of_all(coded.mapInArrow(_negatives(block, negatives), _LIST), negatives)
        names = spark.createDataFrame([(r.anchor, r.rank - 1, rows[r.anchor].vec_id, r.vec_id, r.score) for r in best],
                                      "anchor long, list long, anchor_id long, positive_id long, positive_score long")
        (mined.join(F.broadcast(names), ["anchor", "list"])
         .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                 "positive_score", F.col("score").alias("negative_score"))
         .write.mode("append").parquet(out))
    return spark.read.schema(schema).parquet(out)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over all `embeddings`."""
    return mine_negatives(read_table(spark, sf_dir, "embeddings"))
