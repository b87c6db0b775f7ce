"""Whole Arrow columns of text as arrays of code points, and rolling hashes over them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE, BASE_INVERSE = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLES: dict[str, np.ndarray] = {}
_POWERS: dict[str, np.ndarray] = {}


def chunks(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``most`` code points each; one longer text is a chunk of its own."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, column.slice(at, to - at)
        at = to


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points one after another, and where each text begins (one more entry than texts). Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(column.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def _table(name: str) -> np.ndarray:
    if name not in _TABLES:
        size = 0x20000
        if name == "alnum":
            made = np.ones(0x110000, dtype=bool)
            made[:size] = [chr(c).isalnum() for c in range(size)]
            made[0x32400:] = False
        else:
            made = np.arange(0x110000, dtype=np.uint32)
            for c in range(size):
                low = (unicodedata.normalize("NFKC", chr(c)) if name == "fold" else chr(c)).lower()
                if len(low) == 1:
                    made[c] = ord(low)
        _TABLES[name] = made
    return _TABLES[name]


def is_alnum(points: np.ndarray) -> np.ndarray:
    """Letters and digits of any script."""
    return _table("alnum")[points]


def fold(points: np.ndarray) -> np.ndarray:
    """Lower case, with full-width and other compatibility forms of one character made plain."""
    return _table("fold")[points]


def lower(points: np.ndarray) -> np.ndarray:
    """Lower case, nothing else changed; characters with a longer lower form stay."""
    return _table("lower")[points]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int, inverse: bool) -> np.ndarray:
    name = "down" if inverse else "up"
    if name not in _POWERS or len(_POWERS[name]) < n:
        steps = np.full(n, BASE_INVERSE if inverse else BASE, dtype=U64)
        steps[0] = 1
        _POWERS[name] = np.cumprod(steps)
    return _POWERS[name][:n]


class Rolling:
    """Hashes of any stretches of a sequence of integers, by prefix sums modulo 2**64.

    The hash depends on the stretch only, not on where it stands.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.sums = np.zeros(self.n + 1, dtype=U64)
        np.cumsum(mix(values.astype(U64) + U64(0x5851F42D4C957F2D)) * _powers(max(self.n, 1), False)[: self.n], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * _powers(self.n + 1, True)[starts]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends))

    def windows(self, k: int) -> np.ndarray:
        """The hash of each stretch of ``k`` values."""
        return mix((self.sums[k:] - self.sums[:-k]) * _powers(self.n + 1, True)[: self.n + 1 - k]) if self.n >= k else np.array([], dtype=U64)


def word_spans(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of each run of letters or digits; runs end where a text ends."""
    inside = is_alnum(points)
    edge = np.zeros(len(points) + 1, dtype=bool)
    edge[starts] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    begin = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return begin, end, np.searchsorted(starts, begin, side="right") - 1
