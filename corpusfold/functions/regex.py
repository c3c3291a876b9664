"""Python ``re`` semantics for rule patterns, on Spark (Java regex) and DuckDB (RE2).

The specification is Python ``re`` on ``str``: Unicode ``\\s``/``\\w``/``\\b``,
``^`` after ``\\n`` only, ``.`` excluding ``\\n`` only. Neither Java nor RE2
has exactly those classes, so the three escapes are spelled out with explicit
Unicode classes that both engines understand:

* ``\\s`` -> ``[\\t-\\r\\x1c-\\x1f\\x85\\p{Z}]`` (the set ``str.isspace`` accepts)
* ``\\w`` -> ``[\\p{L}\\p{N}_]`` (``str.isalnum`` plus underscore)
* ``\\b`` -> look-arounds on Java; on RE2 (no look-around) a consuming
  ``(^|\\W)`` / ``($|\\W)`` chosen from the neighbouring pattern character, which
  is exact for *search* (``rlike`` / ``regexp_matches``) use.

Java always gets ``(?d)`` (UNIX_LINES: only ``\\n`` ends a line) and ``(?iu)``
for case-insensitive patterns (Unicode case folding).
"""

from __future__ import annotations

import re
from functools import lru_cache

WS_CLASS_BODY = r"\t-\r\x1c-\x1f\x85\p{Z}"
WORD_CLASS_BODY = r"\p{L}\p{N}_"
WS = f"[{WS_CLASS_BODY}]"
WORD = f"[{WORD_CLASS_BODY}]"
NON_WORD = f"[^{WORD_CLASS_BODY}]"

_JAVA_BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def _is_word_char(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _boundary_side(pattern: str, i: int) -> str:
    """Return 'before' if the boundary at pattern[i:i+2] precedes a word char, else 'after'."""
    nxt = pattern[i + 2] if i + 2 < len(pattern) else ""
    prev = pattern[i - 1] if i > 0 else ""
    if nxt == "(" or _is_word_char(nxt) or pattern[i + 2:i + 4] == r"\w":
        return "before"
    if prev == ")" or _is_word_char(prev) or pattern[i - 2:i] == r"\w":
        return "after"
    raise ValueError(f"cannot place word boundary in {pattern!r} at {i}")


def _translate(pattern: str, dialect: str) -> str:
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(WS_CLASS_BODY if in_class else WS)
            elif nxt == "w":
                out.append(WORD_CLASS_BODY if in_class else WORD)
            elif nxt == "b" and not in_class:
                if dialect == "java":
                    out.append(_JAVA_BOUNDARY)
                elif _boundary_side(pattern, i) == "before":
                    out.append(f"(?:^|{NON_WORD})")
                else:
                    out.append(f"(?:$|{NON_WORD})")
            elif nxt in "\"'":
                out.append(nxt)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


@lru_cache(maxsize=None)
def java_regex(pattern: str, ignorecase: bool = False, multiline: bool = False) -> str:
    """Pattern for Spark ``rlike`` / ``regexp_*`` with Python ``re`` meaning."""
    flags = "d" + ("iu" if ignorecase else "") + ("m" if multiline else "")
    return f"(?{flags})" + _translate(pattern, "java")


@lru_cache(maxsize=None)
def java_regex_folded(pattern: str, multiline: bool = False) -> str:
    """A case-insensitive pattern for use on *folded* text (see ``classify.fold``).

    Folding maps every character that matches an ASCII letter case-insensitively to
    that lower-case letter, so matching the lower-cased pattern case-sensitively on
    the folded text gives the same answer as ``(?iu)`` on the original - and a
    case-sensitive literal prefix lets Java skip ahead (Boyer-Moore) instead of
    trying every position. The rule patterns use no upper-case escapes.
    """
    if re.search(r"\\[A-Z]", pattern):
        raise ValueError(f"upper-case escape in {pattern!r}")
    return "(?d" + ("m" if multiline else "") + ")" + _translate(pattern.lower(), "java")


@lru_cache(maxsize=None)
def re2_regex(pattern: str, ignorecase: bool = False, multiline: bool = False) -> str:
    """Pattern for DuckDB ``regexp_matches`` with Python ``re`` meaning (search only)."""
    flags = ("i" if ignorecase else "") + ("m" if multiline else "")
    return (f"(?{flags})" if flags else "") + _translate(pattern, "re2")


def sql_literal(s: str) -> str:
    """Single-quoted SQL string literal (DuckDB and Spark SQL both accept doubled quotes)."""
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------ literal guards
# A regex is only worth running on rows whose case-folded text contains a
# literal the pattern cannot match without. ``required_literals`` returns, per
# top-level alternative, the longest literal run that every match contains
# (lower-cased), or None when some alternative has none.

_ESCAPED_LITERAL = set(".()[]{}$^*+?|\\/\"'#:<>=@-")


def _split_top(pattern: str) -> list[str]:
    parts, depth, in_class, cur, i = [], 0, False, [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            cur.append(pattern[i:i + 2])
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            parts.append("".join(cur))
            cur = []
            i += 1
            continue
        cur.append(ch)
        i += 1
    parts.append("".join(cur))
    return parts


MOST_ALTERNATIVES = 64           # expanded alternatives of a pattern that are worth guarding


def _class_end(alt: str, i: int) -> int:
    """Place of the bracket that closes the character class at ``i``."""
    i += 1
    while alt[i] != "]":
        i += 2 if alt[i] == "\\" else 1
    return i


def _inside(group: str) -> list[str] | None:
    """The alternatives of a group's content; None for a look-around."""
    if group.startswith("?:"):
        return _split_top(group[2:])
    return None if group.startswith("?") else _split_top(group)


def _runs(alt: str) -> list[list[str]]:
    """The literal runs that every match of ``alt`` holds, for each way through its groups with alternatives."""
    ways: list[list[str]] = [[]]
    cur: list[str] = []
    i = 0
    n = len(alt)

    def close():
        if cur:
            for w in ways:
                w.append("".join(cur))
        cur.clear()

    while i < n:
        ch = alt[i]
        group: list[str] | None = None
        if ch == "\\" and i + 1 < n:
            nxt = alt[i + 1]
            atom = nxt if nxt in _ESCAPED_LITERAL else None
            i += 2
        elif ch == "[":
            atom, i = None, _class_end(alt, i) + 1
        elif ch == "(":
            depth, j = 0, i
            while j < n:
                if alt[j] == "\\":
                    j += 2
                    continue
                if alt[j] == "[":
                    j = _class_end(alt, j) + 1
                    continue
                depth += alt[j] == "("
                depth -= alt[j] == ")"
                if depth == 0:
                    break
                j += 1
            group = _inside(alt[i + 1:j])
            atom, i = None, j + 1
        elif ch in ".^$":
            atom, i = None, i + 1
        else:
            atom, i = ch, i + 1
        optional = False
        quant = alt[i] if i < n and alt[i] in "*+?{" else ""
        if quant:
            if quant == "{":
                k = alt.index("}", i)
                lo = alt[i + 1:k].split(",")[0]
                optional = lo.strip() in ("", "0")
                i = k + 1
            else:
                optional = quant in "*?"
                i += 1
            if i < n and alt[i] == "?":   # lazy modifier
                i += 1
            if atom is not None and not optional:
                cur.append(atom)
        if quant or atom is None:
            close()
        else:
            cur.append(atom)
        if group is not None and not optional:
            inner = [w for part in group for w in _runs(part)]
            if len(ways) * len(inner) <= MOST_ALTERNATIVES:
                ways = [w + x for w in ways for x in inner]
    close()
    return ways


@lru_cache(maxsize=None)
def required_literals(pattern: str) -> tuple[tuple[str, ...], ...] | None:
    """Per alternative (those inside groups expanded), the lower-cased literal runs every match of it
    contains (all of them, longest first); ``None`` when some alternative has none."""
    alts: list[tuple[str, ...]] = []
    for alt in _split_top(pattern):
        for way in _runs(alt):
            runs = {r.lower() for r in way if r}
            if not runs:
                return None
            runs = [r for r in runs if not any(r != x and r in x for x in runs)]
            alts.append(tuple(sorted(runs, key=lambda r: (-len(r), r))))
    # an alternative whose runs hold all runs of another one is implied by it
    least = [a for a in dict.fromkeys(alts) if not any(b != a and all(any(y in x for x in a) for y in b) for b in set(alts))]
    return tuple(least)
