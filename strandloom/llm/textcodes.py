"""Words, word hashes and windows of whole batches of texts, computed on byte and code-point arrays.

A batch of texts is one byte array with offsets; words are found by a class table over bytes, and a word's
64-bit hash is a keyed polynomial over its (folded) bytes with a final mixing step, all without a Python loop
per word.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_class(pattern: str) -> np.ndarray:
    """256 flags: bytes of words. ``blank``: all but space and \\t..\\r. ``alnum``: digits, letters, bytes over 7F."""
    out = np.zeros(256, bool)
    if pattern == "blank":
        out[:] = True
        out[[0x20, *range(0x09, 0x0E)]] = False
    elif pattern == "alnum":
        out[0x30:0x3A] = True
        out[0x41:0x5B] = True
        out[0x61:0x7B] = True
        out[0x80:] = True
    else:
        raise ValueError(pattern)
    return out


@functools.lru_cache(maxsize=4)
def _byte_keys(fold: bool) -> np.ndarray:
    keys = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    if fold:
        keys = keys.copy()
        keys[0x41:0x5B] = keys[0x61:0x7B]
    return keys


_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the polynomial's base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(256, 1 << (n - 1).bit_length())
        got = np.empty(size, U64)
        got[0] = 1
        have = 1
        step = np.array([_BASE], U64)  # an array: its products wrap silently
        while have < size:  # doubling
            got[have : 2 * have] = got[:have] * step
            step = step * step
            have *= 2
        _powers = got
    return _powers[:n]


@dataclass
class Words:
    """Words of a batch: byte (or code point) spans, the text each is in, and hashes."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray | None
    first: np.ndarray  # of each text: index of its first word, and one more for the end


def spans(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of set flags; a run ends where a text ends."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = flags.copy()
    begins[1:] &= ~flags[:-1]
    ends = flags.copy()
    ends[:-1] &= ~flags[1:]
    at = offsets[1:-1]
    at = at[(at > 0) & (at < n)]
    begins[at] = flags[at]
    ends[at - 1] = flags[at - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def run_hashes(keys: np.ndarray, flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each run [start, end); keys are the 64-bit keys of its symbols, runs cover the set flags."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    inside = keys[flags]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(inside)) - np.repeat(first, size)
    inside = inside * powers(int(size.max()))[place]
    return mix64(np.add.reduceat(inside, first) + size.astype(U64))


def words(data: np.ndarray, offsets: np.ndarray, kind: str, fold: bool, hashed: bool = True) -> Words:
    """Words of UTF-8 bytes. kind: see :func:`byte_class`; fold: A-Z count as a-z."""
    flags = byte_class(kind)[data]
    start, end = spans(flags, offsets)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    got = _blockwise(_byte_keys(fold), data, flags, start, end) if hashed else None
    return Words(start, end, doc, got, first)


#: Symbols whose keys are held at once; a longer word is a block of its own.
BLOCK = 1 << 22


def _blockwise(table: np.ndarray, data: np.ndarray, flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Run hashes of any number of words, with the keys of one block of symbols at a time."""
    if len(data) <= BLOCK:
        return run_hashes(table[data], flags, start, end)
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        a = start[i]
        j = max(i + 1, int(np.searchsorted(end, a + BLOCK, "right")))
        b = end[j - 1]
        out[i:j] = run_hashes(table[data[a:b]], flags[a:b], start[i:j] - a, end[i:j] - a)
        i = j
    return out


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within one text, and where each begins."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    total = np.zeros(len(at), U64)
    for k in range(size):
        total += h[at + k] * U64(_window_key(k))
    return mix64(total + U64(size)), at


@functools.lru_cache(maxsize=None)
def _window_key(k: int) -> int:
    return int(mix64(np.array([k + 77], U64))[0]) | 1


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """Of each text: the sorted distinct hashes of its ``size``-word windows; of a shorter one, its whole sequence."""
    got, at = windows(h, first, size)
    cuts = np.searchsorted(at, first)
    out = []
    for d in range(len(first) - 1):
        own = got[cuts[d] : cuts[d + 1]]
        n = first[d + 1] - first[d]
        if 0 < n < size:
            own = np.zeros(1, U64)
            for k in range(n):
                own += h[first[d] + k : first[d] + k + 1] * U64(_window_key(k))
            own = mix64(own + U64(n))
        elif len(own) > 1:
            own = np.sort(own)
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
    return out


# ---- code points ----


@functools.lru_cache(maxsize=1)
def _code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    upper = np.zeros(0x110000, bool)
    mark = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "L":
            letter[c] = True
            if kind in ("Lu", "Lt"):
                upper[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
        elif kind[0] == "M":
            letter[c] = mark[c] = True
    return lower, letter, upper, mark


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and their offsets."""
    lead = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    text = data.tobytes().decode("utf-8", "replace")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, before[offsets]


def lower_codes(codes: np.ndarray) -> np.ndarray:
    return _code_tables()[0][codes]


def is_letter(codes: np.ndarray) -> np.ndarray:
    """Letters, and the marks that belong to them."""
    return _code_tables()[1][codes]


def is_mark(codes: np.ndarray) -> np.ndarray:
    return _code_tables()[3][codes]


def is_upper(codes: np.ndarray) -> np.ndarray:
    return _code_tables()[2][codes]


def code_keys(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(U64) * U64(0xD1342543DE82EF95) + U64(0x632BE59BD9B4E019))


def hash_text(text: str) -> int:
    """The hash that :func:`run_hashes` gives to a run of these code points."""
    if not text:
        return 0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    flags = np.ones(len(codes), bool)
    return int(run_hashes(code_keys(codes), flags, np.array([0]), np.array([len(codes)]))[0])


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)
