"""Token ids of texts through their pre-tokens, with a bounded memory of known ones.

For the word-level BPE files a text's ids are the ids of its pre-tokens one after
the other: white space is dropped, special strings hold no white space, and
neither the normaliser (NFC, lower case) nor the pre-token pattern looks across a
space. So each distinct pre-token goes through the library once per worker and is
then a row of a table. Text made of printable ASCII and Latin letters is cut by
the vocabulary's own pattern (NFC does not change it); any other word, and any
word with a special string, goes to the library as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

from corpusfold.llm.common import HELD, LOWER, ragged_index, span_hashes

_LATIN = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
# fixed value: the pattern of the vocabulary file, for lower-cased text of the characters below
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")
_PLAIN = re.compile(rf"[\t\n\r -~A-Z\u00c0-\u00d6\u00d8-\u00de{_LATIN}]*")
_SPECIAL = re.compile(r"<\|")
TABLE_BYTES = 16 << 20           # a larger table is emptied before the next chunk
CHUNK = 512 << 10               # bytes of text of a chunk: its arrays take some 60 times as much
_STRING_BYTES = 160             # of a string in the dictionary
_BATCH = 1 << 12
_JOINED = 1 << 6                # pre-tokens of a string given to the library
_SLOTS = 1 << 17
_SLOT_SHIFT = np.uint64(47)
_CODECS: dict[tuple, "WordCodec"] = {}
HELD.append(_CODECS)


def pretokens(text: str) -> list[str] | None:
    """Pre-tokens of a text the pattern above is right for; None for others."""
    if _PLAIN.fullmatch(text) and not _SPECIAL.search(text):
        return _PRETOKEN.findall(text.lower())
    return None


def pieces(text: bytes) -> list[str]:
    """Strings whose ids, one after the other, are the ids of the text."""
    whole = text.decode("utf-8", "replace")
    out = pretokens(whole)
    if out is None:
        out = []
        for w in text.split():                   # ASCII white space only
            w = w.decode("utf-8", "replace")
            p = pretokens(w)
            out.extend([w] if p is None else p)
    return out


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """The library's tokenizer, without truncation or padding and single-threaded inside a task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


# classes of bytes: 0 white space, 1 letter (also bytes of Latin letters beyond ASCII), 2 digit, 3 other, 4 not plain
_CLASS = np.full(256, 4, np.uint8)
_CLASS[33:127] = 3
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_SECOND = np.zeros(256, bool)                     # second bytes of the letters U+00C0 to U+00FF
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False


class Plain:
    """Pre-tokens of the plain documents of a chunk, by byte classes; ``slow`` marks the other documents.

    Plain are printable ASCII and the letters of Latin-1 without special strings;
    these documents need no call per pre-token. The spans are those of the
    pattern above.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base = int(offsets[0])
        buf = data[base:int(offsets[-1])]
        bounds = offsets - base
        n = len(buf)
        kind = np.r_[_CLASS[buf], np.zeros(3, np.uint8)]
        text = np.r_[LOWER[buf], np.zeros(3, np.uint8)]
        lead = np.flatnonzero(buf == 0xC3)
        lead = lead[_SECOND[text[lead + 1]]]
        kind[lead] = kind[lead + 1] = 1
        up = lead[text[lead + 1] < 0x9F] + 1
        text[up] += 0x20
        odd = np.flatnonzero(kind[:n] == 4)
        special = np.flatnonzero((text[:n] == 60) & (text[1:n + 1] == 124))
        self.slow = np.zeros(len(bounds) - 1, bool)
        self.slow[np.searchsorted(bounds, np.r_[odd, special], side="right") - 1] = True
        for d in np.flatnonzero(self.slow):
            kind[bounds[d]:bounds[d + 1]] = 0
        start = np.zeros(n + 1, bool)
        start[:n] = (kind[:n] == 2) | (kind[:n] != np.r_[np.uint8(0), kind[:n]][:n])
        start[bounds] = True
        # contractions: an apostrophe that begins a match
        at = np.flatnonzero((text[:n] == 39) & start[:n] & (kind[:n] == 3))
        if len(at):
            doc_end = bounds[np.searchsorted(bounds, at, side="right")]
            one, two, three = (np.where(at + k < doc_end, text[at + k], 0) for k in (1, 2, 3)[:3])
            short = np.isin(one, [115, 116, 109, 100])                                    # 's 't 'm 'd
            long_ = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            start[at[short | long_] + 1] = False
            for hit, size in ((short, 2), (long_ & ~short, 3)):
                after = at[hit] + size
                after = after[after < n]
                start[after[kind[after] != 0]] = True
        self.text, self.bounds = text[:n], bounds
        where = np.flatnonzero(start[:n])
        ends = np.r_[where[1:], n]
        # a match ends at white space: runs of white space are their own spans, and dropped
        word = kind[where] != 0
        self.starts, self.ends = where[word], ends[word]
        self.counts = np.diff(np.searchsorted(self.starts, bounds))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.text, self.starts, self.ends)

    def string(self, i: int) -> str:
        return self.text[self.starts[i]:self.ends[i]].tobytes().decode()


class WordCodec:
    """Ids of pre-tokens; one per worker and vocabulary file (see ``of``).

    A row of the table is found by the pre-token's 64-bit hash (plain documents)
    or by its string (all others). New hashes go to a short sorted array that is
    merged into the long one now and then. The table outlives a task, as learning it
    anew costs more than all the rest, and is emptied beyond ``TABLE_BYTES``.
    """

    plain = Plain
    pieces = staticmethod(pieces)

    @classmethod
    def of(cls, path: str) -> "WordCodec":
        if (cls, path) not in _CODECS:
            _CODECS[cls, path] = cls(path)
        return _CODECS[cls, path]

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.hash, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.late_hash, self.late_row = self.hash, self.row
        self.first = np.zeros(_SLOTS + 1, np.int32)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.used = 0
        self.rows = 0
        self.start = np.zeros(1 << 14, np.int32)
        self.length = np.zeros(1 << 14, np.int32)

    def bytes_held(self) -> int:
        arrays = (self.hash, self.row, self.late_hash, self.late_row, self.flat, self.start, self.length)
        return sum(a.nbytes for a in arrays) + _STRING_BYTES * len(self.known)

    def library_ids(self, strings: list[str]) -> Iterator[list[int]]:
        for lo in range(0, len(strings), _BATCH):
            for e in self.tokenizer.encode_batch_fast(strings[lo:lo + _BATCH], add_special_tokens=False):
                yield e.ids

    def plain_ids(self, strings: list[str]) -> Iterator[list[int]]:
        """The same for pre-tokens of plain documents, many at once: spaces part them, and the library tells each id's word."""
        for lo in range(0, len(strings), _BATCH):
            parts = [strings[i:i + _JOINED] for i in range(lo, min(lo + _BATCH, len(strings)), _JOINED)]
            for part, e in zip(parts, self.tokenizer.encode_batch([" ".join(p) for p in parts], add_special_tokens=False)):
                words, ids = e.word_ids, e.ids
                cuts = [i for i, (a, b) in enumerate(zip(words, words[1:]), 1) if a != b]
                if words and len(cuts) + 1 == len(part) and words[0] == 0 and words[-1] == len(part) - 1:
                    yield from map(ids.__getitem__, map(slice, [0, *cuts], [*cuts, len(ids)]))
                else:                                # not one word a pre-token: no such vocabulary file is known
                    yield from self.library_ids(part)

    def _append(self, strings: list[str], plain: bool = False) -> np.ndarray:
        """New rows with the ids of the strings, which may be pre-tokens of plain documents."""
        ids = list((self.plain_ids if plain else self.library_ids)(strings))
        n0, n1 = self.rows, self.rows + len(strings)
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        total = self.used + int(lengths.sum())
        for name, need in (("flat", total), ("start", n1), ("length", n1)):
            a = getattr(self, name)
            if need > len(a):
                setattr(self, name, np.concatenate([a, np.zeros(max(need, len(a) * 3 // 2) - len(a), a.dtype)]))
        self.flat[self.used:total] = np.fromiter(chain.from_iterable(ids), np.uint32, total - self.used)
        self.length[n0:n1] = lengths
        self.start[n0:n1] = self.used + np.cumsum(lengths) - lengths
        self.used, self.rows = total, n1
        return np.arange(n0, n1, dtype=np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it is new."""
        slot = (h >> _SLOT_SHIFT).astype(np.int32)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), -1, np.int32)
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.hash[at[live]] == h[live]
            out[live[hit]] = self.row[at[live[hit]]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        if len(self.late_hash):
            live = np.flatnonzero(out < 0)
            at = np.searchsorted(self.late_hash, h[live])
            at[at == len(self.late_hash)] = 0
            hit = self.late_hash[at] == h[live]
            out[live[hit]] = self.late_row[at[hit]]
        return out

    def _learn(self, fresh: np.ndarray, rows: np.ndarray) -> None:
        at = np.searchsorted(self.late_hash, fresh)
        self.late_hash, self.late_row = np.insert(self.late_hash, at, fresh), np.insert(self.late_row, at, rows)
        if len(self.late_hash) > max(1 << 12, len(self.hash) // 4):
            both = np.concatenate([self.hash, self.late_hash])
            order = np.argsort(both, kind="stable")         # two sorted runs: merged
            self.hash, self.row = both[order], np.concatenate([self.row, self.late_row])[order]
            self.late_hash, self.late_row = self.hash[:0], self.row[:0]
            np.cumsum(np.bincount((self.hash >> _SLOT_SHIFT).astype(np.int32), minlength=_SLOTS), out=self.first[1:])

    def _plain_rows(self, plain: Plain) -> np.ndarray:
        h = plain.hashes()
        row = self._find(h)
        new = np.flatnonzero(row < 0)
        if len(new):
            fresh, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            added = self._append([plain.string(i) for i in new[first]], plain=True)
            row[new] = added[back]
            self._learn(fresh, added)
        return row

    def rows_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(table rows of all pre-tokens of the documents of a chunk, number of pre-tokens of each document)."""
        if self.bytes_held() > TABLE_BYTES:
            self.clear()
        plain = self.plain(data, offsets)
        rows, counts = self._plain_rows(plain), plain.counts
        slow = np.flatnonzero(plain.slow)
        if not len(slow):
            return rows, counts
        parts = [self.pieces(data[offsets[d]:offsets[d + 1]].tobytes()) for d in slow]
        flat = list(chain.from_iterable(parts))
        new = list(set(flat) - self.known.keys())
        self.known.update(zip(new, self._append(new).tolist()))
        other = np.fromiter(map(self.known.__getitem__, flat), np.int32, len(flat))
        counts = counts.copy()
        counts[slow] = list(map(len, parts))
        begin = np.cumsum(counts) - counts
        out = np.empty(len(rows) + len(other), np.int32)
        out[ragged_index(begin[slow], counts[slow])] = other
        fast = np.flatnonzero(~plain.slow)
        out[ragged_index(begin[fast], counts[fast])] = rows
        return out, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a chunk one after the other, number of ids of each)."""
        rows, counts = self.rows_of(data, offsets)
        n = self.length[rows].astype(np.int64)
        per_text = np.diff(np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(counts)]])
        return self.flat[ragged_index(self.start[rows], n)], per_text

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
        return self.encode(np.frombuffer(b"".join(texts), np.uint8), offsets)
