"""Operator 8 - toxicity by non-negative positive-unlabelled learning.

Linear classifiers over the presence of hashed words (letters and digits, A-Z
lower-cased) and of their first ``STEM`` bytes are trained with numpy from confirmed toxic texts (P) and unlabelled
texts (U). With logistic loss l, class prior pi and scores g the risk is

    pi * mean_P l(g) + max(0, mean_U l(-g) - pi * mean_P l(-g)),

the class-prior-corrected estimator whose second part is kept from going below
zero: where a step would do so, the step goes up that part instead. The prior is
the toxic share of the labelled training rows.

``MEMBERS`` classifiers share P and take disjoint parts of U; a score is the mean
of their probabilities. P and U are bounded samples (``POSITIVES``, ``UNLABELLED``
rows, those with the smallest hashes of doc_id, less near copies), and only their
hashed words reach the driver; a member keeps words whose share of P is ``LEAST_LIFT`` times
that of the clean texts, which is the share of U without its toxic part, and ``LEAST_Z``
standard errors above the share of U. So it works at any toxic share. The prior counts all labelled training rows. Every whole text is scored in one pass
without a shuffle.

Cases. Null or empty text: the score of no words. Several labels of a document: it
is toxic if one says so. Without toxic training rows, or without labels, all scores
are 0. A null doc_id is never a training row and not held out. Repeated rows score
alike. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.llm.common import NOT_ALNUM, U64, Words, by_keys, mix, on_workers, read_table, span_hashes, text_chunks
from corpusfold.session import cut_lineage

BITS = 20
STEM = 5
POSITIVES = 3000
UNLABELLED = 12000
MEMBERS = 3
LEAST_ROWS = 6
LEAST_Z = 5.5
LEAST_LIFT = 3.0
STEPS = 300
RATE = 0.2
L2 = 1e-5
THRESHOLD = 0.7


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _features(words: Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of the distinct hashed words of a chunk, in order; only features in the mask ``wanted``."""
    long_ = words.ends - words.starts > STEM
    stems = span_hashes(words.text, words.starts[long_], words.starts[long_] + STEM) ^ U64(1 << 63)
    f = (np.concatenate([words.hashes(), stems]) >> U64(64 - BITS)).astype(np.int64)
    doc = words.doc_of_word()
    doc = np.concatenate([doc, doc[long_]])
    if wanted is not None:
        keep = wanted[f]
        f, doc = f[keep], doc[keep]
    both = np.unique((doc << BITS) | f)
    return both >> BITS, both & ((1 << BITS) - 1)


def _hashed(batches):
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch):
            words = Words(data, offsets, lower=True, space=NOT_ALNUM)
            doc, f = _features(words)
            bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("positive")[lo:hi], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(f, pa.int32()))],
                names=["positive", "words"])


class _Sparse:
    """Rows of present features."""

    def __init__(self, rows: list[np.ndarray], index: np.ndarray):
        rows = [r[index[r] >= 0] for r in rows]
        self.n = len(rows)
        self.col = index[np.concatenate(rows)] if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n) + b

    def gradient(self, by_row: np.ndarray, size: int) -> tuple[np.ndarray, float]:
        return np.bincount(self.col, weights=by_row[self.row], minlength=size), float(by_row.sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def nnpu(p: _Sparse, u: _Sparse, prior: float, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk, by Adam over all rows."""
    theta = np.zeros(size + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    softplus = lambda x: np.logaddexp(0.0, x)
    for t in range(1, STEPS + 1):
        gp, gu = p.scores(theta[:-1], theta[-1]), u.scores(theta[:-1], theta[-1])
        negative = softplus(gu).mean() - prior * softplus(gp).mean()
        # derivatives of the three means by the scores
        plus = -_sigmoid(-gp) / p.n * prior
        minus_p, minus_u = -prior * _sigmoid(gp) / p.n, _sigmoid(gu) / u.n
        if negative >= 0:
            by_p, by_u = plus + minus_p, minus_u
        else:
            by_p, by_u = -minus_p, -minus_u
        (wp, bp), (wu, bu) = p.gradient(by_p, size), u.gradient(by_u, size)
        g = np.r_[wp + wu + L2 * theta[:-1], bp + bu]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def without_copies(rows: list[np.ndarray]) -> list[np.ndarray]:
    """The rows without near copies of earlier ones (20 of 32 equal minima of hashed features)."""
    salts = mix(np.arange(1, 33, dtype=U64))
    kept, minima, bands = [], [], {}
    for r in rows:
        if not len(r):
            kept.append(r)
            minima.append(None)
            continue
        least = np.array([mix(r.astype(U64) ^ s).min() for s in salts])
        keys = [(b, least[4 * b:4 * b + 4].tobytes()) for b in range(8)]
        if any((least == minima[i]).sum() >= 20 for k in keys for i in bands.get(k, ())):
            continue
        for k in keys:
            bands.setdefault(k, []).append(len(kept))
        kept.append(r)
        minima.append(least)
    return kept


def informative(pos: list[np.ndarray], part: list[np.ndarray], prior: float) -> np.ndarray:
    """Features whose share of P is LEAST_LIFT times that of clean texts and LEAST_Z standard errors above that of U."""
    a, b = (np.bincount(np.concatenate(x), minlength=1 << BITS) for x in (pos, part))
    both = (a + b) / (len(pos) + len(part))
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / len(pos) + 1 / len(part)))
    a, b = a / len(pos), b / len(part)
    clean = (b - prior * a) / (1 - prior)
    return np.flatnonzero((a - b >= LEAST_Z * error) & (a >= LEAST_LIFT * clean) & (a * len(pos) >= LEAST_ROWS))


def train(docs: DataFrame, labels: DataFrame) -> list[tuple[np.ndarray, float]]:
    """Members (weights over 2**BITS features, bias) from the rows of both tables that are not held out."""
    spark = docs.sparkSession
    on_workers(spark)
    known = (labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    known = cut_lineage(known)
    total, toxic = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    if not toxic:
        return []
    prior = min(max(toxic / total, 1e-4), 1 - 1e-4)
    rank = F.xxhash64("doc_id")
    training = docs.where(~held_out() & F.col("doc_id").isNotNull())
    chosen = known.where("toxic = 1").select("doc_id", F.lit(True).alias("positive")).orderBy(rank, "doc_id").limit(POSITIVES)
    free = training.select("doc_id").distinct().select("doc_id", F.lit(False).alias("positive")).orderBy(
        F.xxhash64("doc_id", F.lit("u")), "doc_id").limit(UNLABELLED)
    sample = by_keys(training.select("doc_id", "text"), cut_lineage(chosen.union(free)), "doc_id", "inner")
    rows = sample.select("positive", "text").mapInArrow(_hashed, "positive boolean, words array<int>").toArrow()
    positive = rows.column("positive").to_numpy().astype(bool)
    words = [np.asarray(x.as_py(), np.int64) for x in rows.column("words")]
    # an order of its own: the result doesn't depend on how tasks finished
    order = sorted(range(len(words)), key=lambda i: (not positive[i], words[i].tolist()))
    # near copies would make the words of one text look telling
    pos = without_copies([words[i] for i in order if positive[i]])
    free_words = without_copies([words[i] for i in order if not positive[i]])
    if not pos or not free_words:
        return []
    mixed = np.random.default_rng(8).permutation(len(free_words))
    members = []
    for k in range(MEMBERS):
        part = [free_words[i] for i in mixed[k::MEMBERS]] or free_words
        used = informative(pos, part, prior)
        index = np.full(1 << BITS, -1)
        index[used] = np.arange(len(used))
        w, b = nnpu(_Sparse(pos, index), _Sparse(part, index), prior, len(used))
        full = np.zeros(1 << BITS, np.float32)
        full[used] = w
        members.append((full, b))
    return members


def _scores(members: list[tuple[np.ndarray, float]]):
    wanted = np.logical_or.reduce([w != 0 for w, _ in members]) if members else np.zeros(1 << BITS, bool)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                doc, f = _features(Words(data, offsets, lower=True, space=NOT_ALNUM), wanted)
                score = np.zeros(hi - lo)
                for w, b in members:
                    score += _sigmoid(np.bincount(doc, weights=w[f], minlength=hi - lo) + b) / len(members)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(np.clip(score, 0.0, 1.0))],
                                                 names=["doc_id", "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= THRESHOLD) of every row of ``docs``."""
    members = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    scored = docs.select("doc_id", "text").mapInArrow(_scores(members), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over all `documents`, learned from `labels`: toxicity score of every document."""
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
