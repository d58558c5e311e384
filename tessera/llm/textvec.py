"""Vectorised text primitives for the Arrow-batch stages of this subpackage.

Texts of one batch are laid out as one code point array, so tokenising and hashing are a few numpy passes over
characters instead of a Python loop over words.  A *word* is a maximal run of letters or digits in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Characters handled at once: bounds the worker's memory and keeps the passes inside the CPU caches.
BLOCK_CHARS = 400_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser: spreads a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for positions 0..n."""
    have = _cache.get("pow")
    if have is None or len(have) <= n:
        size = max(n + 1, BLOCK_CHARS * 2)
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _cache["pow"] = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _cache["ipow"] = np.cumprod(steps, dtype=np.uint64)
    return _cache["pow"], _cache["ipow"]


def word_table() -> np.ndarray:
    """For every code point: is it a letter or a digit?"""
    if "word" not in _cache:
        _cache["word"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _cache["word"]


def lower_table() -> np.ndarray:
    """Lower case of every code point, one for one: a text's lower case has the text's length, wherever it is cut."""
    if "lower" not in _cache:
        low = (chr(c).lower() for c in range(0x110000))
        _cache["lower"] = np.fromiter((ord(x[0]) for x in low), np.uint32, 0x110000)
    return _cache["lower"]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one NUL between texts, and where each text starts (one more for the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=starts[1:])
    raw = ("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), starts


def prefix_hash(cp: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    power, _ = _powers(len(cp))
    out = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(mix(cp.astype(np.uint64) + np.uint64(0x51ED27)) * power[: len(cp)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the characters [start, end); equal spans hash alike wherever they stand."""
    _, inverse = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a block of texts: hash, place in the code point array, and the first word of each text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index into the arrays above, one entry per text and one for the end
    cp: np.ndarray
    text_start: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text)


def words(texts: list[str]) -> Words:
    cp, text_start = code_points(texts)
    cp = lower_table()[cp]
    inside = word_table()[cp]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    start, end = edge[0::2], edge[1::2]
    if len(end) < len(start):
        end = np.append(end, len(cp))
    first = np.searchsorted(start, text_start)
    return Words(span_hash(prefix_hash(cp), start, end), start, end, first, cp, text_start)


def runs(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` consecutive words, the text that holds each, and its first word's index."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = w.owner
    keep = np.flatnonzero(owner[:n] == owner[size - 1 :])
    h = np.zeros(len(keep), np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w.hash[keep + k])
    return h, owner[keep], keep


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[slice]:
    """Consecutive slices of the list with at most ``limit`` characters, or one text."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(begin, k)
            begin, size = k, 0
        size += len(t) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))
