"""Operator 6 - language identification with segmentation-marginalised unigrams.

Each language has probabilities of the pieces of letters of one fixed public
vocabulary (a SentencePiece model). A word w is scored by the *sum over all its segmentations* into
pieces of the product of piece probabilities, by the forward recursion

    f[0] = 1,   f[j] = sum over k of p(w[j-k:j]) f[j-k],

and a text by the sum of log f over its words (letters only, lower-cased, with a
mark in front that stands for the word's beginning). Unknown characters are a
piece of their own with a small fixed probability, alike for all languages. A run of
letters is a word however long it is; beyond ``PLAIN`` characters, where the numbers
would grow too small, the recursion runs on logarithms.

Training is expectation maximisation: expected piece counts under all
segmentations (forward-backward), summed per language with Spark, over at most
``TRAIN_ROWS`` labelled rows a language (the rows with the smallest hashes of
doc_id) and whole texts. All languages are learned, ``LANGS`` at a time: a model of
LANGS languages x vocabulary numbers is what the driver and a task hold. Scoring reads
every whole text once for each such model, without a shuffle, and carries the best
language and the sum over all so far from one to the next.

The recursions run over all distinct words of a chunk of documents at once: the
words lie in a matrix by length and each step is one lookup of hashed substrings.

Cases. A null text, or one without letters, is ``und`` with score 0. The score is
the posterior of the best language under equal priors, from the mean log
likelihood a word scaled by ``SHARPNESS`` words (so long texts do not saturate).
Ties go to the first language by code point. Without any labelled row all texts
are ``und``. Repeated rows get the same result; rows with a null doc_id are scored
and held_out is null-safe (false); other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.llm.common import mix, on_workers, read_table, released, text_chunks
from corpusfold.session import cut_lineage

VOCABULARY = "piece_bpe_32k.model"
PLAIN = 24                      # characters of a word up to which the recursion multiplies
CELLS = 1 << 21                 # substrings looked up at once
TRAIN_ROWS = 2000
LANGS = 128                     # languages of a model
ROUNDS = 3
SMOOTH = 0.1
UNKNOWN = 1e-9
SHARPNESS = 24.0
KNOWN_WORDS = 1 << 18           # scored words that a task remembers
_MARK = "▁"
_RUNS = re.compile(r"[^\W\d_]+")       # letters, and a few number signs that letter_counts drops
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (h + codes.astype(np.uint64)) * _BASE


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of a (rows, length) matrix of code points."""
    h = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        h = _step(h, codes[:, j])
    return mix(h + np.uint64(codes.shape[1]))


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, with and without the word mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = set()
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i).lower()
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and p:
            if p == _MARK or p.lstrip(_MARK).isalpha():
                out.add(p)
    return sorted(out)


class Lattice:
    """Lookup of substrings in the vocabulary; position i of the sorted hashes is row i of the model."""

    def __init__(self, pieces: list[str]):
        h = np.empty(len(pieces), np.uint64)
        self.longest = max(map(len, pieces), default=1)
        for k in range(1, self.longest + 1):
            at = [i for i, p in enumerate(pieces) if len(p) == k]
            if at:
                h[at] = _hash(np.array([[ord(c) for c in pieces[i]] for i in at]))
        self.hashes = np.sort(h)
        slots = 1 << int(len(pieces) * 8).bit_length()
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        # first index at or after each slot: pieces of a slot lie next to each other
        self.first = np.searchsorted(self.hashes, np.arange(slots + 1, dtype=np.uint64) << self.shift) if slots else None
        self.first[-1] = len(h)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of the model for each hash; the row after the last one if it is no piece."""
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), len(self.hashes))
        while True:
            live = np.flatnonzero(at < end)
            if not len(live):
                return out
            hit = self.hashes[at[live]] == h[live]
            out[live[hit]] = at[live[hit]]
            at[live] += 1
            at[live[hit]] = end[live[hit]]

    def edges(self, words: np.ndarray) -> np.ndarray:
        """[k - 1, j - 1, word]: model row of the piece of k characters that ends at j, for a matrix of words of one length."""
        n, length = words.shape
        known = len(self.hashes)
        out = np.full((min(self.longest, length), length, n), known, np.int32)
        h = np.zeros((n, length + 1), np.uint64)
        for k in range(1, len(out) + 1):
            h = _step(h[:, :-1], words[:, k - 1:])
            out[k - 1, k - 1:] = self.find(mix(h + np.uint64(k)).ravel()).reshape(h.shape).T
        # an unknown character is a piece with its own small probability
        out[0][out[0] == known] = known + 1
        return out


def _by_length(words: list[str]):
    """(indexes, matrix of code points with the mark in front) for each word length."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        codes = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), n)
        yield at, np.concatenate([np.full((len(at), 1), ord(_MARK), np.uint32), codes], axis=1)


def _extended(model: np.ndarray) -> np.ndarray:
    """Model rows, then a row of zeros (no piece) and the unknown character's row."""
    return np.vstack([model, np.zeros((1, model.shape[1])), np.full((1, model.shape[1]), UNKNOWN)])


def forward(edges: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    f = [np.ones((edges.shape[2], p.shape[1]))]
    for j in range(1, edges.shape[1] + 1):
        f.append(sum(p[edges[k - 1, j - 1]] * f[j - k] for k in range(1, min(len(edges), j) + 1)))
    return f


def log_forward(edges: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithms of the forward values, [j, word, language], for words of any length."""
    most, length, n = edges.shape
    f = np.zeros((length + 1, n, p.shape[1]))
    for j in range(1, length + 1):
        k = np.arange(1, min(most, j) + 1)
        # relative to the value before; what the last ``most`` characters add is far within the range of doubles
        f[j] = f[j - 1] + np.log((p[edges[k - 1, j - 1]] * np.exp(f[j - k] - f[j - 1])).sum(axis=0))
    return f


def _groups(words: list[str], lattice: Lattice):
    """(indexes, edges) of words of one length, a bounded number of substrings at a time."""
    for at, codes in _by_length(words):
        size = max(1, CELLS // (codes.shape[1] * min(lattice.longest, codes.shape[1])))
        for lo in range(0, len(at), size):
            yield at[lo:lo + size], lattice.edges(codes[lo:lo + size])


def word_scores(words: list[str], lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """log of the probability of each word, summed over its segmentations, a column per language."""
    out = np.zeros((len(words), p.shape[1]))
    for at, edges in _groups(words, lattice):
        out[at] = np.log(forward(edges, p)[-1]) if edges.shape[1] <= PLAIN + 1 else log_forward(edges, p)[-1]
    return out


def expected_counts(words: list[str], weight: np.ndarray, lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words of one language (p: one column), by forward-backward."""
    counts = np.zeros(len(p))
    for at, edges in _groups(words, lattice):
        most, n, _ = edges.shape
        if n > PLAIN + 1:
            counts += _long_counts(edges, weight[at], p)
            continue
        f = forward(edges, p)
        b = [np.zeros_like(f[0]) for _ in range(n)] + [np.ones_like(f[0])]
        for j in range(n, 0, -1):
            for k in range(1, min(most, j) + 1):
                row = edges[k - 1, j - 1]
                step = p[row] * b[j]
                b[j - k] += step
                post = (f[j - k] * step / f[n])[:, 0] * weight[at]
                counts += np.bincount(row, weights=post, minlength=len(p))
    return counts


def _long_counts(edges: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The same on logarithms."""
    most, n, _ = edges.shape
    f = log_forward(edges, p)[:, :, 0]
    with np.errstate(divide="ignore"):
        log_p = np.log(p[:, 0])
    b = np.full_like(f, -np.inf)
    b[n] = 0
    counts = np.zeros(len(p))
    for j in range(n, 0, -1):
        for k in range(1, min(most, j) + 1):
            row = edges[k - 1, j - 1]
            step = log_p[row] + b[j]
            b[j - k] = np.logaddexp(b[j - k], step)
            counts += np.bincount(row, weights=np.exp(f[j - k] + step - f[n]) * weight, minlength=len(p))
    return counts


def letter_counts(text: str | None) -> Counter:
    """Counts of the lower-cased runs of letters."""
    out = Counter(_RUNS.findall(text.lower())) if text else Counter()
    for w in [w for w in out if not w.isalpha()]:
        k = out.pop(w)
        for run in "".join(c if c.isalpha() else " " for c in w).split():
            out[run] += k
    return out


def _counts_of(path: str, langs: list[str], model: np.ndarray | None):
    def run(batches):
        lattice = Lattice(load_pieces(path))
        size = len(lattice.hashes)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                words.setdefault(lang, Counter()).update(letter_counts(text.as_py()))
            for lang, c in words.items():
                start = np.full((size, 1), 1.0 / max(size, 1)) if model is None else model[:, [langs.index(lang)]]
                got = expected_counts(list(c), np.fromiter(c.values(), float, len(c)), lattice, _extended(start))[:size]
                total[lang] = total.get(lang, 0) + got
        for lang, got in total.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at])],
                                             names=["lang", "piece", "expected"])
    return released(run)


def languages(docs: DataFrame) -> list[tuple[str, int]]:
    """(language, labelled rows) of all languages, by code point."""
    rows = docs.where("lang is not null").groupBy("lang").count().collect()
    return sorted(((r["lang"], r["count"]) for r in rows), key=lambda x: x[0].encode())


def train(docs: DataFrame, path: str, langs: list[tuple[str, int]] | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, pieces x languages probabilities) from rows with text, lang and doc_id."""
    spark = docs.sparkSession
    on_workers(spark)
    counted = languages(docs) if langs is None else langs
    langs = [lang for lang, _ in counted]
    if not langs:
        return [], np.zeros((0, 0))
    # the rows with the smallest hashes, by rate and not by a sort: about TRAIN_ROWS of each language
    rates = spark.createDataFrame([(lang, TRAIN_ROWS / n) for lang, n in counted], "lang string, rate double")
    picked = (docs.join(F.broadcast(rates), "lang")
              .where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < F.col("rate")).select("lang", "text"))
    model = None
    place = {lang: i for i, lang in enumerate(langs)}
    size = len(load_pieces(path))
    for _ in range(ROUNDS):
        rows = (picked.mapInArrow(_counts_of(path, langs, model), "lang string, piece int, expected double")
                .groupBy("lang", "piece").agg(F.sum("expected").alias("expected")).toPandas())
        counts = np.zeros((size, len(langs)))
        counts[rows["piece"].to_numpy(), [place[x] for x in rows["lang"]]] = rows["expected"]
        counts += SMOOTH
        model = counts / counts.sum(axis=0)
    return langs, model


_SO_FAR = ("__best", "__top", "__sum")         # best language, its mean log likelihood, log of the sum over languages


def _predict(path: str, langs: list[str], model: np.ndarray, keep: list[str], first: bool):
    """Adds what this model's languages give to the best language and the sum so far."""
    def run(batches):
        lattice, p = Lattice(load_pieces(path)), _extended(model)
        known: dict[str, int] = {}
        scores = np.zeros((0, len(langs)))
        for whole in batches:
            for lo, hi, _data, _offsets in text_chunks(whole):
                batch = whole.slice(lo, hi - lo)
                counts = [letter_counts(t) for t in batch.column("text").to_pylist()]
                new = list({w for c in counts for w in c if w not in known})
                if len(known) + len(new) > KNOWN_WORDS:          # a bounded memory of scored words
                    known, scores, new = {}, scores[:0], list({w for c in counts for w in c})
                new.sort(key=len)                                # long ones last: they are not remembered
                known.update(zip(new, range(len(known), len(known) + len(new))))
                scores = np.vstack([scores, word_scores(new, lattice, p)])
                at = np.fromiter((known[w] for c in counts for w in c), np.int64)
                k = np.fromiter((v for c in counts for v in c.values()), float)
                doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
                total = np.stack([np.bincount(doc, weights=scores[at, i] * k, minlength=len(counts)) for i in range(len(langs))], axis=1)
                long = sum(len(w) > PLAIN for w in new)
                for w in new[len(new) - long:]:
                    del known[w]
                scores = scores[:len(known)]
                words = np.bincount(doc, weights=k, minlength=len(counts))
                mean = total / np.maximum(words, 1)[:, None] * np.minimum(words, SHARPNESS)[:, None]
                top = mean.max(axis=1)
                added = top + np.log(np.exp(mean - top[:, None]).sum(axis=1))
                best = np.array(langs, object)[mean.argmax(axis=1)]
                if not first:
                    names, before, so_far = (batch.column(c).to_numpy(zero_copy_only=False) for c in _SO_FAR)
                    best, top = np.where(top > before, best, names), np.maximum(top, before)     # ties: the earlier language
                    added = np.logaddexp(added, so_far)
                none = words == 0
                best[none] = None
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(best, pa.string()), pa.array(top), pa.array(added)],
                                                 names=[*keep, *_SO_FAR])
    return released(run)


def predict(docs: DataFrame, models, path: str, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of ``docs`` with prediction and score added under ``names`` (which must be free).

    ``models`` yields (languages, model) in the order of the languages; each is used and dropped before the next.
    """
    on_workers(docs.sparkSession)
    carried = list(dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in carried)
    out = None
    for langs, model in models:
        if out is not None:
            out = cut_lineage(out)                  # one model a stage
        out = (docs if out is None else out).mapInArrow(
            _predict(path, langs, model, carried, out is None), f"{schema}, {_SO_FAR[0]} string, {_SO_FAR[1]} double, {_SO_FAR[2]} double")
    kept = [F.col(f"`{c}`") for c in keep]
    if out is None:
        return docs.select(*kept, F.lit("und").alias(names[0]), F.lit(0.0).alias(names[1]))
    best, top, total = (F.col(c) for c in _SO_FAR)
    return out.select(*kept, F.coalesce(best, F.lit("und")).alias(names[0]),
                      F.when(best.isNull(), 0.0).otherwise(F.exp(top - total)).alias(names[1]))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def identify(docs: DataFrame, path: str | None = None, keep: list[str] | None = None,
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Train on the rows of ``docs`` that are not held out, then predict all rows.

    Returns the columns ``keep`` (all by default), the prediction and its score.
    """
    path = path or vocabulary()
    labelled = docs.select("doc_id", "text", "lang").where(~held_out())
    found = languages(labelled)
    models = (train(labelled, path, found[lo:lo + LANGS]) for lo in range(0, len(found), LANGS))
    keep = keep or docs.columns
    return predict(docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"]))), models, path, keep, names)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all `documents`: predicted language and score of every document."""
    found = identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
