"""NumPy kernels over whole batches of texts: code points, token spans, token hashes."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

CODE_POINTS = sys.maxunicode + 1
#: Code points handled at once; a longer text is one piece of its own.
PIECE = 1 << 20
_POWERS = 1 << 10


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Per code point: is it a Unicode letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(CODE_POINTS)), np.bool_, CODE_POINTS)


@lru_cache(maxsize=1)
def alphanumerics() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(CODE_POINTS)), np.bool_, CODE_POINTS)


@lru_cache(maxsize=1)
def spaces() -> np.ndarray:
    return np.fromiter((chr(c).isspace() for c in range(CODE_POINTS)), np.bool_, CODE_POINTS)


@lru_cache(maxsize=1)
def lowered() -> np.ndarray:
    """Per code point: its lower case where that is a single code point, else itself."""
    def one(c: int) -> int:
        low = chr(c).lower()
        return ord(low) if len(low) == 1 else c

    return np.fromiter(map(one, range(CODE_POINTS)), np.uint32, CODE_POINTS)


@lru_cache(maxsize=1)
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    codes = rng.integers(1, 2**63, CODE_POINTS, dtype=np.uint64)
    powers = rng.integers(1, 2**63, _POWERS, dtype=np.uint64) | np.uint64(1)
    return codes, powers


def pieces(texts: Iterable[str | None], most: int = PIECE) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``most`` code points: (index of the first, texts); null is empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        if held and size + len(text) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and the n + 1 bounds of the texts in it."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return points, bounds


def runs(classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one class (0: outside any) within one text: starts, ends, texts' indices."""
    n = len(classes)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    new = np.empty(n, np.bool_)
    new[0] = True
    np.not_equal(classes[1:], classes[:-1], out=new[1:])
    new[bounds[:-1][bounds[:-1] < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    inside = classes[starts] != 0
    starts, ends = starts[inside], ends[inside]
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal for equal spans in any batch, process or machine."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    codes, powers = _mixers()
    lengths = ends - starts
    total = int(lengths.sum())
    firsts = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(firsts, lengths)
    at = np.repeat(starts, lengths) + within
    mixed = codes[points[at]] * powers[within % _POWERS]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x9E3779B97F4A7C15) + (within // _POWERS).astype(np.uint64) * np.uint64(2)
    return finish(np.add.reduceat(mixed, firsts) + lengths.astype(np.uint64))


def finish(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Ordered combination of two hashes."""
    return finish(a * np.uint64(0x9E3779B97F4A7C15) + finish(b + np.uint64(salt + 1)))
