"""Token ids of the byte-level BPE file through its pre-tokens.

The vocabulary's pattern cuts a text into runs of letters, of digits and of other
characters, each with the one space before it, and runs of white space; case and
bytes are kept. Each distinct pre-token goes through the library once per table
(see ``word_codec``). Documents of ASCII and Latin-1 letters without ``<|`` are cut
by byte classes; every other document goes to the library whole.
"""

from __future__ import annotations

import numpy as np

from corpusfold.llm.common import span_hashes
from corpusfold.llm.word_codec import _SECOND, WordCodec, vocabulary

BYTE_VOCABULARY = "byte_bpe_50k.json"

# classes of bytes: 0 white space, 1 letter, 2 digit, 3 other, 4 not plain
_CLASS = np.full(256, 4, np.uint8)
_CLASS[33:127] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1


class BytePlain:
    """Pre-tokens of the plain documents of a chunk; ``slow`` marks the other documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base = int(offsets[0])
        text = data[base:int(offsets[-1])]
        bounds = offsets - base
        n = len(text)
        kind = np.r_[_CLASS[text], np.zeros(3, np.uint8)]
        padded = np.r_[text, np.zeros(3, np.uint8)]
        lead = np.flatnonzero(text == 0xC3)
        lead = lead[_SECOND[padded[lead + 1]]]
        kind[lead] = kind[lead + 1] = 1
        odd = np.flatnonzero(kind[:n] == 4)
        special = np.flatnonzero((padded[:n] == 60) & (padded[1:n + 1] == 124))
        self.slow = np.zeros(len(bounds) - 1, bool)
        self.slow[np.searchsorted(bounds, np.r_[odd, special], side="right") - 1] = True
        for d in np.flatnonzero(self.slow):
            kind[bounds[d]:bounds[d + 1]] = 5               # of no pre-token
        start = np.zeros(n + 1, bool)
        start[:n] = kind[:n] != np.r_[np.uint8(6), kind[:n]][:n]
        start[bounds] = True
        space = padded[:n] == 32
        # contractions: an apostrophe that begins a match (one behind a space belongs to that space)
        at = np.flatnonzero((padded[:n] == 39) & start[:n] & (kind[:n] == 3))
        at = at[~(space[at - 1] & ~np.isin(at, bounds))] if len(at) else at
        if len(at):
            doc_end = bounds[np.searchsorted(bounds, at, side="right")]
            one, two = (np.where(at + k < doc_end, padded[at + k], 0) for k in (1, 2))
            short = np.isin(one, [115, 116, 109, 100])                                    # 's 't 'm 'd
            long_ = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            start[at[short | long_] + 1] = False
            for hit, size in ((short, 2), (long_ & ~short, 3)):
                after = at[hit] + size
                start[after[after < n]] = True
        # white space before a pre-token: its last character stands alone, a space joins what follows
        inner = start.copy()
        inner[bounds] = False
        after = np.flatnonzero(inner[:n] & (kind[:n] != 0) & (np.r_[np.uint8(6), kind[:n]][:n] == 0))
        start[after - 1] = True
        start[after[space[after - 1]]] = False
        self.text, self.bounds = text, bounds
        where = np.flatnonzero(start[:n])
        ends = np.r_[where[1:], n]
        kept = kind[where] != 5
        self.starts, self.ends = where[kept], ends[kept]
        self.counts = np.diff(np.searchsorted(self.starts, bounds))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.text, self.starts, self.ends)

    def string(self, i: int) -> str:
        return self.text[self.starts[i]:self.ends[i]].tobytes().decode()


class ByteCodec(WordCodec):
    """Ids of the byte-level vocabulary."""

    plain = BytePlain
    plain_ids = WordCodec.library_ids            # spaces are part of its pre-tokens

    @staticmethod
    def pieces(text: bytes) -> list[str]:
        return [text.decode("utf-8", "replace")]


def byte_vocabulary() -> str:
    return vocabulary(BYTE_VOCABULARY)
