"""Words and word shingles of many texts at once, as 64-bit numbers.

A word's number is a polynomial over its bytes modulo 2**64, taken from running sums over the
whole slice, so no Python object is made for a word. Numbers only find candidates and count
sets; what must be certain is compared as bytes by the callers.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)

#: For ``plain`` words: everything in ASCII that is neither letter nor digit separates.
_MARKS = np.ones(256, bool)
_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_P = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD1342543DE82EF95)
_table: dict[str, np.ndarray] = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_table["pow"]) < n:
        _table["pow"], _table["inv"] = _powers(_P, n), _powers(pow(_P, -1, 1 << 64), n)
    return _table["pow"], _table["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(raw: np.ndarray, at: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of all words of the rows, as words() takes them."""
    n = len(raw)
    inside = ~(_MARKS if plain else _SPACE)[raw]
    edge = at[(at > 0) & (at < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)


def words(raw: np.ndarray, at: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of the rows, and where each row's words begin (one more at the end).

    Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``; with ``plain``, runs of ASCII letters,
    digits and non-ASCII characters. A-Z count as a-z.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    start, end = spans(raw, at, plain)
    up, down = powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LOWER[raw] * up[:n], out=total[1:])
    return mix((total[end + 1] - total[start]) * down[start]), np.searchsorted(start, at)


def shingles(number: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the shingles of k words that begin at each word; of all words if there are fewer."""
    if not len(number):
        return number
    k = min(k, len(number))
    out = np.zeros(len(number) - k + 1, np.uint64)
    for j in range(k):
        out *= _STEP
        out += number[j : j + len(out)]
    return mix(out + np.uint64(k))


def shingle_rows(number: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many rows in one go: all numbers, and where each row's begin."""
    count = np.diff(first)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(made, out=begin[1:])
    out = np.zeros(int(begin[-1]), np.uint64)
    if len(number) >= k:
        full = shingles(number, k)
        long = np.flatnonzero(count >= k)
        if len(long):
            size = made[long]
            take = np.repeat(first[:-1][long] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
            put = np.repeat(begin[:-1][long] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
            out[put] = full[take]
    for i in np.flatnonzero((count > 0) & (count < k)):
        out[begin[i]] = shingles(number[first[i] : first[i + 1]], k)[0]
    return out, begin


def byte_words(text: str | None) -> list[bytes]:
    """Exact words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; ``bytes`` knows just these six spaces."""
    return (text or "").encode("utf-8", "replace").lower().split()


def exact_shingles(found: list[bytes], k: int) -> set[bytes]:
    """Distinct shingles, each its words joined by a space."""
    if not found:
        return set()
    if len(found) < k:
        return {b" ".join(found)}
    return set(map(b" ".join, zip(*(found[j:] for j in range(k)), strict=False)))
