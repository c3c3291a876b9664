"""Operator 7 - token counts with the whole-token shortcut.

Offline, once per worker and vocabulary file, every string of the vocabulary that
ends a word is proved or not to be a *whole token*: its text, alone, is cut into
one pre-token and the library encodes it as exactly one token. A pre-token found in
that proved table counts 1 without any merge; only the rest is merged by the
library, once for each distinct pre-token of a worker's bounded memory.

Texts are cut into pre-tokens as the library does (see ``word_codec``): plain text
by byte classes, all else word by word by the library itself, which also applies
its own treatment of special strings.

Scale. One narrow pass without a shuffle; memory is a chunk of documents and the
bounded table. Only the counts leave the task.

Cases. Null or blank text: n_tokens 0 (n_bytes 0 for null and empty). Very long
texts are counted whole. Repeated rows count alike; null ids and other columns do
not matter; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.llm.common import on_workers, read_table, released, text_chunks
from corpusfold.llm.word_codec import CHUNK, WordCodec, pretokens, vocabulary

LIMIT = 2048
_END = "</w>"


def byte_letters() -> dict[str, int]:
    """The visible letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def whole_tokens(codec: WordCodec) -> set[str]:
    """Vocabulary strings proved to be one pre-token that encodes alone as one token."""
    letters = byte_letters()
    strings = []
    for piece in codec.tokenizer.get_vocab(with_added_tokens=False):
        if piece.endswith(_END):
            raw = bytes(letters[c] for c in piece[:-len(_END)] if c in letters)
            try:
                strings.append(raw.decode())
            except UnicodeDecodeError:
                continue                 # half a character is no text
    strings = [s for s in strings if pretokens(s) == [s]]
    return {s for s, ids in zip(strings, codec.library_ids(strings)) if len(ids) == 1}


class WholeTokenCounter(WordCodec):
    """A codec's table that keeps only counts: 1 for proved whole tokens, the library's merges for the rest."""

    def __init__(self, path: str):
        super().__init__(path)
        self.whole = whole_tokens(self)

    def _append(self, strings: list[str], plain: bool = False) -> np.ndarray:
        n0, n1 = self.rows, self.rows + len(strings)
        if n1 > len(self.length):
            self.length = np.concatenate([self.length, np.zeros(max(n1, 2 * len(self.length)) - len(self.length), np.int32)])
        count = np.ones(len(strings), np.int32)
        rest = np.array([i for i, s in enumerate(strings) if s not in self.whole], np.int64)
        count[rest] = [len(ids) for ids in (self.plain_ids if plain else self.library_ids)([strings[i] for i in rest])]
        self.length[n0:n1] = count
        self.rows = n1
        return np.arange(n0, n1, dtype=np.int32)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, counts = self.rows_of(data, offsets)
        total = np.r_[0, np.cumsum(self.length[rows], dtype=np.int64)]
        return np.diff(total[np.r_[0, np.cumsum(counts)]])


def _counts(path: str):
    def run(batches):
        counter = WholeTokenCounter.of(path)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch, limit=CHUNK):
                n = counter.count(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"])
    return released(run, remembers=True)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and whether they are more than ``limit``, of every row."""
    on_workers(docs.sparkSession)
    out = docs.select("doc_id", "text").mapInArrow(_counts(path or vocabulary()), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over all `documents`: bytes and tokens of every document."""
    return token_counts(read_table(spark, sf_dir, "documents"))
