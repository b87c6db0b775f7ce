"""Compressed bitmaps over 16-bit keys, in the manner of the published "Roaring" containers.

A container holds a set of integers below 2**16 and picks the smallest of three forms: a sorted array of
uint16, a bit field of 8 KB, or runs of (start, length - 1).
"""

from __future__ import annotations

import numpy as np

WIDTH = 1 << 16


class Container:
    """An immutable set of integers in [0, 65536)."""

    __slots__ = ("data", "form")

    def __init__(self, form: str, data: np.ndarray) -> None:
        self.form, self.data = form, data

    @classmethod
    def of(cls, values: np.ndarray) -> Container:
        """From any array of integers; repeated values count once."""
        v = np.unique(np.asarray(values, dtype=np.int64)).astype(np.uint16)
        if not len(v):
            return cls("array", v)
        breaks = np.flatnonzero(np.diff(v.astype(np.int32)) != 1) + 1
        starts = np.concatenate([[0], breaks])
        lengths = np.diff(np.concatenate([starts, [len(v)]]))
        forms = {"runs": 4 * len(starts), "array": 2 * len(v), "bits": WIDTH // 8}
        form = min(forms, key=lambda k: forms[k])
        if form == "runs":
            return cls(form, np.stack([v[starts], (lengths - 1).astype(np.uint16)], axis=1))
        if form == "array":
            return cls(form, v)
        flags = np.zeros(WIDTH, dtype=np.uint8)
        flags[v] = 1
        return cls(form, np.packbits(flags))

    def bits(self) -> np.ndarray:
        """The set as 8 KB of bits."""
        if self.form == "bits":
            return self.data
        flags = np.zeros(WIDTH, dtype=np.uint8)
        flags[self.values()] = 1
        return np.packbits(flags)

    def values(self) -> np.ndarray:
        """The members in order."""
        if self.form == "array":
            return self.data.astype(np.int64)
        if self.form == "bits":
            return np.flatnonzero(np.unpackbits(self.data)).astype(np.int64)
        starts, lengths = self.data[:, 0].astype(np.int64), self.data[:, 1].astype(np.int64) + 1
        offsets = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return np.repeat(starts, lengths) + offsets

    def nbytes(self) -> int:
        return int(self.data.nbytes)

    def __or__(self, other: Container) -> Container:
        if "bits" in (self.form, other.form):
            return Container.of(np.flatnonzero(np.unpackbits(self.bits() | other.bits())))
        return Container.of(np.union1d(self.values(), other.values()))

    def __and__(self, other: Container) -> Container:
        if "bits" in (self.form, other.form):
            return Container.of(np.flatnonzero(np.unpackbits(self.bits() & other.bits())))
        return Container.of(np.intersect1d(self.values(), other.values(), assume_unique=True))

    def andnot(self, other: Container) -> Container:
        """Members of this set that ``other`` lacks."""
        if "bits" in (self.form, other.form):
            return Container.of(np.flatnonzero(np.unpackbits(self.bits() & ~other.bits())))
        return Container.of(np.setdiff1d(self.values(), other.values(), assume_unique=True))
