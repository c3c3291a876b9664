"""JSON arrays of any size, cut into elements by many tasks.

A file that is one array has no line ends to split at, so its text is read in pieces
between commas (``lineSep``), which Spark's reader deals out by splits like lines.
Whether a comma separates elements depends on all that comes before it: on whether
it lies in a string, and on how deep in brackets. Both follow from two narrow passes:

1. each split yields its effect for either way it may begin - whether its quotes
   turn "outside a string" into "inside", and how much depth its brackets add if it
   begins outside, and if it begins inside. A quote behind an odd number of
   backslashes is no quote; backslashes never reach across a comma;
2. the effects, one short row a split, are composed in file order, so each split's
   state at its start is known, and a file that does not end outside of all strings
   and brackets is an error;
3. each split is read again from its known state: commas outside of strings at depth
   one separate elements. Whole elements go on from where they are; only the pieces
   at a split's two ends meet those of its neighbours, by the number of elements
   begun before them.

No task holds more of a file than a batch and the element at hand, whatever the file.
An element that does not parse, text around the array and a file that is no array
are errors; an empty file has no elements.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.operators.sequence import running_count
from corpusfold.session import cut_lineage, ship_package

_QUOTE, _BACK, _COMMA = ord('"'), ord("\\"), ord(",")
_DEPTH = np.zeros(256, np.int8)
_DEPTH[[ord("["), ord("{")]] = 1
_DEPTH[[ord("]"), ord("}")]] = -1
_SPACE = b" \t\n\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACE)] = True
SPLIT_BITS = 33                 # an element's id: its split's number above, its place in the split below

_EFFECT = "file string, block long, bytes long, size long, turns boolean, outside long, inside long, first string"
_PIECE = "split long, nth long, left boolean, right boolean, only boolean, text string"


class BrokenArray(ValueError):
    """A file that should hold one JSON array does not."""


def quotes(buf: np.ndarray) -> np.ndarray:
    """Positions of the quotes that open or close a string."""
    at = np.flatnonzero(buf == _QUOTE)
    if not len(at):
        return at
    back = buf == _BACK
    if not back.any():
        return at
    # length of the run of backslashes that ends before each position
    other = np.flatnonzero(~back)
    before = np.searchsorted(other, at) - 1
    run = at - 1 - np.where(before >= 0, other[np.maximum(before, 0)], -1)
    return at[run % 2 == 0]


def in_string(buf: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each byte lies in a string, given whether the first one does (quotes count as inside, closing ones as outside)."""
    turns = np.zeros(len(buf), np.uint8)
    turns[quotes(buf)] = 1
    return (np.cumsum(turns) + inside) % 2 == 1


def _joined(batch: pa.RecordBatch, lo: int, hi: int) -> bytes:
    return b"".join(x + b"," for x in batch.column("value").slice(lo, hi - lo).cast(pa.binary()).to_pylist())


def _runs(batch: pa.RecordBatch):
    """(first row, end row) of the rows of one split that follow one another."""
    file, block = batch.column("file").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
    cuts = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (block[1:] != block[:-1])]) if len(block) else []
    return list(zip(cuts, [*cuts[1:], len(block)]))


def _effects(batches):
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for lo, hi in _runs(batch):
            key = (batch.column("file")[lo].as_py(), batch.column("block")[lo].as_py())
            buf = np.frombuffer(_joined(batch, lo, hi), np.uint8)
            inside = in_string(buf, False)
            depth = _DEPTH[buf].astype(np.int64)
            out, own, turns = int(depth[~inside].sum()), int(depth[inside].sum()), len(quotes(buf)) % 2 == 1
            f = found.setdefault(key, [0, batch.column("size")[lo].as_py(), False, 0, 0, None])
            f[0] += len(buf)
            f[3], f[4] = (f[3] + (own if f[2] else out)), (f[4] + (out if f[2] else own))
            f[2] ^= turns
            if f[5] is None:
                text = buf[~_IS_SPACE[buf]][:1].tobytes()
                f[5] = text.decode("latin-1") if text else None
    rows = [[*k, *v] for k, v in found.items()]
    if rows:
        yield pa.RecordBatch.from_pydict(dict(zip((c.split()[0] for c in _EFFECT.split(", ")), map(list, zip(*rows)))))


@dataclass(frozen=True)
class Start:
    """What is known of a split before it is read again."""
    number: int
    inside: bool                # in a string
    depth: int
    opened: bool                # the array begins before this split
    bytes: int                  # a comma behind every piece included
    last: bool                  # of its file: the comma behind its last piece is not in the file


def compose(effects: list) -> dict[tuple[str, int], Start]:
    """The start of each split, of rows of ``_EFFECT`` composed in file order; checks each file's begin and end."""
    starts: dict[tuple[str, int], Start] = {}
    ordered = sorted(effects, key=lambda e: (e.file, e.block))
    for n, e in enumerate(ordered):
        if n == 0 or ordered[n - 1].file != e.file:
            inside, depth, opened, eaten = False, 0, False, 0
        last = n + 1 == len(ordered) or ordered[n + 1].file != e.file
        starts[e.file, e.block] = Start(n, inside, depth, opened, e.bytes, last)
        if not opened and e.first not in ("[", None):
            raise BrokenArray(f"{e.file}: not an array")
        depth += e.inside if inside else e.outside
        inside ^= e.turns
        opened |= e.first is not None
        eaten += e.bytes
        if last and (inside or depth):
            raise BrokenArray(f"{e.file}: the array does not end")
        if last and opened and eaten == e.size:          # the reader drops a comma at the very end
            raise BrokenArray(f"{e.file}: text behind the array")
    return starts


class _Cutter:
    """Cuts the text of one split into elements, chunk by chunk, from its state at the start."""

    def __init__(self, file: str, start: Start):
        self.file, self.start = file, start
        self.inside, self.depth = start.inside, start.depth
        self.open = start.depth > 0
        self.closed = start.opened and not self.open
        self.left = self.open                    # the piece at hand began in an earlier split
        self.only = False                        # and may be all of an array without elements
        self.eaten = 0
        self.held: list[bytes] = []
        self.nth = 0
        self.rows: list[tuple] = []

    def feed(self, raw: bytes) -> None:
        self.eaten += len(raw)
        if self.start.last and self.eaten == self.start.bytes:
            raw = raw[:-1] + b" "
        buf = np.frombuffer(raw, np.uint8)
        if not self.open:
            text = np.flatnonzero(~_IS_SPACE[buf])
            if not len(text):
                return
            if self.closed or buf[text[0]] != ord("["):
                raise BrokenArray(f"{self.file}: " + ("text behind the array" if self.closed else "not an array"))
            raw, buf = raw[text[0] + 1:], buf[text[0] + 1:]
            self.open, self.depth, self.only = True, 1, True
        inside = in_string(buf, self.inside)
        depth = np.where(inside, 0, _DEPTH[buf]).cumsum() + self.depth
        shut = np.flatnonzero((depth == 0) & ~inside)
        end = int(shut[0]) if len(shut) else len(buf)
        at = 0
        for c in np.flatnonzero((buf[:end] == _COMMA) & (depth[:end] == 1) & ~inside[:end]).tolist():
            self.held.append(raw[at:c])
            self.only = False
            self._emit(False)
            at = c + 1
        self.held.append(raw[at:end])
        if len(shut):
            self._emit(False, True)
            self.open, self.closed = False, True
            if not _IS_SPACE[buf[end + 1:]].all():
                raise BrokenArray(f"{self.file}: text behind the array")
        elif len(buf):
            self.inside, self.depth = bool(inside[-1]), int(depth[-1])

    def _emit(self, right: bool, shut: bool = False) -> None:
        text = b"".join(self.held)
        if self.left or right or text.strip(_SPACE):
            # only: of an array without elements the first piece follows its bracket and the last one meets the other
            self.rows.append((self.start.number, self.nth, self.left, right, shut if self.left else self.only, text))
        elif not (self.only and shut):
            raise BrokenArray(f"{self.file}: an element is missing")
        self.held, self.nth, self.left = [], self.nth + 1, False

    def finish(self) -> None:
        """What is left at the split's end goes on in the next one."""
        if self.open:
            self._emit(True)


def _cut(broadcast: Broadcast):
    def run(batches):
        cutter, at, starts = None, None, broadcast.value

        def drained(done):
            rows, done.rows = done.rows, []
            if rows:
                *flags, text = zip(*rows)
                cols = [pa.array(c, t) for c, t in zip(flags, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(text, pa.binary()).cast(pa.string())],
                                                 names=[c.split()[0] for c in _PIECE.split(", ")])

        for batch in batches:
            for lo, hi in _runs(batch):
                key = (batch.column("file")[lo].as_py(), batch.column("block")[lo].as_py())
                if key != at:
                    if cutter is not None:
                        cutter.finish()
                        yield from drained(cutter)
                    cutter, at = _Cutter(key[0], starts[key]), key
                cutter.feed(_joined(batch, lo, hi))
                yield from drained(cutter)
        if cutter is not None:
            cutter.finish()
            yield from drained(cutter)
    return run


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_text(spark: SparkSession, path: str | list[str], line_sep: str | None = None) -> DataFrame:
    """Spark's text reader; many paths are listed by a task a core and not, as by default, by a task a path."""
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    if isinstance(path, str) or len(path) < 2:
        return reader.text(path)
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), max(2, spark.sparkContext.defaultParallelism))))
    try:
        return reader.text(path)
    finally:
        spark.conf.set(LISTING, before)


def array_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(item_id, raw): the text of every element of the arrays in ``path``, ids ascending by file and place."""
    ship_package(spark)
    text = read_text(spark, path, ",").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), "value")
    starts = compose(text.mapInArrow(_effects, _EFFECT).collect())         # a row a split, as many as the scan's own plan holds
    # a worker loads the starts once; in the function itself each task would, so that the work grew with tasks times files
    pieces = text.select("file", "block", "value").mapInArrow(_cut(spark.sparkContext.broadcast(starts)), _PIECE)
    place = F.shiftleft("split", SPLIT_BITS) + F.col("nth")
    whole = pieces.where("NOT (left OR right)").select(place.alias("item_id"), F.col("text").alias("raw"))
    if all(s.last and not s.opened for s in starts.values()):               # every file is one split: nothing is cut in two
        return whole
    # pieces at the ends of splits: an element begins at a right end, goes through splits and ends at a left end
    file_of = spark.createDataFrame([(s.number, f) for (f, _), s in starts.items()], "split long, file string")
    ends = cut_lineage(pieces.where("left OR right").withColumn("place", place).join(F.broadcast(file_of), "split"))
    begun = running_count(ends.select("file", "place", (~F.col("left")).alias("mark")), ["file"], "place", "mark", out="element")
    parts = ends.join(begun.select("file", "place", "element"), ["file", "place"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "")
    across = parts.groupBy("file", "element").agg(F.min("place").alias("item_id"), joined.alias("raw"),
                                                  (F.min_by("only", "place") & F.max_by("only", "place")).alias("only"))
    blank = F.btrim("raw", F.lit(" \t\n\r")) == ""
    missing = F.raise_error(F.concat("file", F.lit(": an element is missing")))
    return whole.unionByName(across.where(~(blank & F.col("only")))
                             .select("item_id", F.when(blank, missing).otherwise(F.col("raw")).alias("raw")))
