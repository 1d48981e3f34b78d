"""Words, word hashes and rolling n-gram hashes, shared by the corpus operators.

A *word* is a maximal run of characters outside the separator class: every ASCII
character that is no letter or digit, the Latin-1 controls, signs and no-break space
(U+0080..U+00BF), general punctuation (U+2000..U+206F) and CJK punctuation
(U+3000..U+301F).  Words are lower-cased.  ``SQL_WORDS`` states the same in DuckDB.
A null text has no words.  Everything works on slices of a batch, as whole arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_CLASS = "\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\xbf\\u2000-\\u206f\\u3000-\\u301f"
WORD_RE = re.compile(f"[^{_CLASS}]+")
#: DuckDB expression: the list of words of column ``text``.
SQL_WORDS = (
    r"regexp_extract_all(lower(coalesce(text, '')), "
    r"'[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x{bf}\x{2000}-\x{206f}\x{3000}-\x{301f}]+')"
)
_TABLE = bytes((ord(chr(b).lower()) if chr(b).isalnum() else 32) if b < 128 else b for b in range(256))
_WIDE = re.compile(rb"\xc2[\x80-\xbf]|\xe2\x80[\x80-\xbf]|\xe2\x81[\x80-\xaf]|\xe3\x80[\x80-\x9f]")

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are taken at once; bounds memory, not the result.
SLICE_BYTES = 1_500_000


def clean_bytes(text: str | None) -> bytes:
    """Lower-cased UTF-8 in which every separator is blank."""
    if not text:
        return b""
    if text.isascii():
        return text.encode().translate(_TABLE)
    return _WIDE.sub(b" ", text.lower().encode("utf-8", "replace")).translate(_TABLE)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, in order, as UTF-8."""
    return clean_bytes(text).split()


def word_spans(text: str | None) -> np.ndarray:
    """Character offsets (start, end) of the words of ``words_of``, shape (n, 2)."""
    return np.array([m.span() for m in WORD_RE.finditer(text or "")], dtype=np.int64).reshape(-1, 2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """The words of a slice of rows: ``hashes`` in order, row i owning first[i]:first[i + 1]."""

    rows: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    raw: bytes
    starts: np.ndarray
    ends: np.ndarray

    def of_row(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]]

    def owner(self) -> np.ndarray:
        """Index in ``rows`` of each word."""
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))


class WordHasher:
    """Splits and hashes whole slices; holds the powers it needs."""

    def __init__(self) -> None:
        self.powers, self.inverses = _powers(BASE, 1), _powers(INVERSE, 1)

    def __call__(self, rows: list[int], cleaned: list[bytes]) -> Words:
        raw = b" " + b" ".join(cleaned) + b" "
        if len(raw) > len(self.powers):
            size = max(len(raw), SLICE_BYTES + 200_000)
            self.powers, self.inverses = _powers(BASE, size), _powers(INVERSE, size)
        data = np.frombuffer(raw, np.uint8)
        blank = data == 32
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.powers[: len(raw)] * data, out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.inverses[starts]
        hashes = mix(hashes * np.uint64(2) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        sizes = np.fromiter(map(len, cleaned), np.int64, len(cleaned))
        offsets = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
        return Words(np.asarray(rows), np.searchsorted(starts, offsets), hashes, raw, starts, ends)

    def slices(self, texts: list[str | None], most: int = SLICE_BYTES) -> Iterator[Words]:
        """``Words`` of consecutive rows, about ``most`` bytes at a time."""
        rows, held, size = [], [], 0
        for i, text in enumerate(texts):
            cleaned = clean_bytes(text)
            rows.append(i)
            held.append(cleaned)
            size += len(cleaned) + 1
            if size >= most:
                yield self(rows, held)
                rows, held, size = [], [], 0
        if rows:
            yield self(rows, held)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive word hashes (len - n + 1 values, or none)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    block, width, base = hashes, 1, BASE
    done, taken, rest = None, 0, n
    while rest:
        if rest & 1:
            part = block[taken : taken + size]
            done = part.copy() if done is None else done * np.uint64(base) + part
            taken += width
        rest >>= 1
        if rest:
            block = block[:-width] * np.uint64(base) + block[width:]
            width *= 2
            base = base * base % (1 << 64)
    return mix(done + np.uint64(n))


def inside(first: np.ndarray, total: int, n: int) -> np.ndarray:
    """For each start of an n-gram over all words: whether it stays within one row."""
    size = max(0, total - n + 1)
    ok = np.ones(size, bool)
    for b in np.unique(first[(first > 0) & (first < total)]):
        ok[max(0, b - n + 1) : b] = False
    return ok


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op (minimum or maximum) over every window of ``width`` values."""
    size = len(values) - width + 1
    if size <= 0:
        return values[:0]
    block, have = values, 1
    while have * 2 <= width:
        block = op(block[:-have], block[have:])
        have *= 2
    return op(block[:size], block[width - have : width - have + size])


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened where a column has them already."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
