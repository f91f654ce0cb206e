"""Vectorised text scanning: words and word-run hashes of many texts at once.

A batch of texts becomes one array of code points; words are the maximal runs of
letters and digits, lower-cased, and every word gets a 64-bit hash from prefix
sums of a polynomial, so no Python object is made per word.  Batches are cut
into slices of bounded length, which bounds the memory of a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points per slice; a longer single text forms its own slice.
SLICE_CHARS = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_ROLL = np.uint64(0xD6E8FEB86659FD93)

_tables: dict[str, np.ndarray] = {}


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    if "pow" not in _tables or len(_tables["pow"]) < n:
        size = max(n, SLICE_CHARS + 2)
        for key, base in (("pow", int(_BASE)), ("inv", _inverse(int(_BASE)))):
            run = np.full(size, base, dtype=np.uint64)
            run[0] = 1
            _tables[key] = np.multiply.accumulate(run)
    return _tables["pow"], _tables["inv"]


def word_table() -> np.ndarray:
    """True at each code point that is a letter or a digit."""
    if "word" not in _tables:
        _tables["word"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _tables["word"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads the polynomial's low bits over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(31))


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most ``limit`` characters each, or one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), in order, over all ``texts``."""
    joined = "\x00".join([t if "\x00" not in t else t.replace("\x00", " ") for t in texts]).lower()
    points = np.frombuffer((joined + "\x00").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_word = word_table()[points]
    edge = np.diff(is_word.view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    power, inverse = _powers(len(points) + 1)
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    breaks = np.flatnonzero(points == 0)
    return hashes, np.searchsorted(breaks, starts)


def runs(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each run of ``n`` consecutive words inside one text."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = len(hashes) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out = out * _ROLL + hashes[k : k + size]
    at = np.flatnonzero(owner[:size] == owner[n - 1 :])
    return mix(out[at]), at


def distinct_per_text(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, key) pairs, sorted by text and then key."""
    if not len(keys):
        return keys, owner
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], owner[new]
