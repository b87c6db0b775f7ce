"""Evaluation passages inside training documents (spaced-seed hashing).

Fixed masks over windows of words (of letters and digits for Chinese and Japanese items) ignore some positions, so a
window still meets its counterpart when words there were replaced. Hashes of both sides are joined; around each hit
the two texts are compared along the same diagonal, exactly and with substitutions.

The items are a stated query set: blocks of BLOCK_CHARS characters of them go to every task, and the documents are
read once per block, joined on the seeds and compared in the scan, so that no document is shuffled.

Words are runs of letters or digits; case, punctuation, white space and compatibility forms (full width) don't count.
A mask never spans more than the shortest passage asked for, so every exact passage of that length is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.arrays import U64, Rolling, chunks, code_points, fold, is_alnum, mix, word_spans

WORD_MASKS = ("110110101111", "111101011011")
CHAR_MASKS = ("111111111111100001111111111111", "111110111110111110111110111110")
MIN_WORDS, MIN_CHARS = len(WORD_MASKS[0]), len(CHAR_MASKS[0])
BY_CHARACTER = ("zh", "ja")
#: Characters of items per block; a longer item is a block of its own.
BLOCK_CHARS = 20_000_000
FILTER_BITS = 22
#: Replaced units in a row that a tolerant overlap bridges, and the share of its units that must be equal.
GAP, EQUAL = 3, 5 / 6


def units(texts: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each unit, text of each unit); units are words or single letters and digits."""
    points, starts = code_points(texts)
    folded = fold(points)
    if kind == "word":
        begin, end, owner = word_spans(folded, starts)
        return Rolling(folded)(begin, end), owner
    kept = np.flatnonzero(is_alnum(folded))
    return mix(folded[kept].astype(U64)), np.searchsorted(starts, kept, side="right") - 1


def seeds(hashes: np.ndarray, owner: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(first unit, hash) of each window of one text; the mask's zeros are ignored."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.array([], dtype=np.int64), np.array([], dtype=U64)
    at = np.flatnonzero(owner[:n] == owner[len(mask) - 1 :])
    total = np.full(len(at), (number + 1) * 0xD6E8FEB86659FD93 % 2**64, dtype=U64)
    for j, kept in enumerate(mask):
        if kept == "1":
            total += hashes[at + j] * U64((2 * j + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return at, mix(total)


def _masks(kind: str) -> list[tuple[int, str]]:
    return list(enumerate(WORD_MASKS)) if kind == "word" else [(len(WORD_MASKS) + i, m) for i, m in enumerate(CHAR_MASKS)]


class Items:
    """The seeds of a block of items, ready to be met by documents."""

    def __init__(self, table: pa.Table) -> None:
        self.ids = table["item_id"].combine_chunks()
        rows = list(zip(table["text"].to_pylist(), table["kind"].to_pylist(), strict=True))
        self.kinds = sorted({kind for _, kind in rows})
        self.units: list[np.ndarray] = [np.array([], dtype=U64)] * len(rows)
        parts = []
        for kind in self.kinds:
            own = [k for k, r in enumerate(rows) if r[1] == kind]
            hashes, owner = units(pa.array([rows[k][0] for k in own]), kind)
            first = np.searchsorted(owner, np.arange(len(own) + 1))
            for n, k in enumerate(own):
                self.units[k] = hashes[first[n] : first[n + 1]]
            for number, mask in _masks(kind):
                at, h = seeds(hashes, owner, mask, number)
                parts.append((h, np.array(own)[owner[at]], at - first[owner[at]]))
        h, item, at = (np.concatenate([p[c] for p in parts]) if parts else np.array([], dtype=d) for c, d in ((0, U64), (1, np.int64), (2, np.int64)))
        order = np.argsort(h, kind="stable")
        self.seed, self.item, self.at = h[order], item[order], at[order]
        self.flags = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.flags[(self.seed >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def met(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes, which of the seeds) for each equal pair."""
        near = np.flatnonzero(self.flags[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.seed, h[near], side="left"), np.searchsorted(self.seed, h[near], side="right")
        n = hi - lo
        return np.repeat(near, n), np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else near


def _longest_run(equal: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def _tolerant(equal: np.ndarray, gap: int) -> tuple[int, int, int]:
    """(span, equal units, beginning) of the longest stretch whose breaks are at most ``gap`` units long."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0, 0
    cut = np.flatnonzero(np.diff(at) > gap + 1)
    lo, hi = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])
    best = int(np.argmax(hi - lo))
    return int(at[hi[best]] - at[lo[best]] + 1), int(hi[best] - lo[best] + 1), int(at[lo[best]])


def _compared(d: np.ndarray, q: np.ndarray, diagonals: np.ndarray, gap: int) -> tuple[int, int, int, int]:
    """(longest run, tolerant span, its equal units, first unit of it in the document) over the diagonals."""
    run, best = 0, (0, 0, 0)
    for diagonal in diagonals.tolist():
        lo, hi = max(0, diagonal), min(len(d), len(q) + diagonal)
        equal = d[lo:hi] == q[lo - diagonal : hi - diagonal]
        run = max(run, _longest_run(equal))
        span, same, at = _tolerant(equal, gap)
        best = max(best, (same, span, -(lo + at)))
    return run, best[1], best[0], -best[2]


def _leak_rows(batches: Iterator[pa.RecordBatch], items: Items, gap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in chunks(batch.column(1)):
            out = []
            for kind in items.kinds:
                hashes, owner = units(texts, kind)
                first = np.searchsorted(owner, np.arange(len(texts) + 1))
                found = []
                for number, mask in _masks(kind):
                    at, h = seeds(hashes, owner, mask, number)
                    which, seed = items.met(h)
                    doc = owner[at[which]]
                    found.append(np.stack([doc, items.item[seed], at[which] - first[doc] - items.at[seed]]))
                hits = np.unique(np.concatenate(found, axis=1), axis=1)
                cuts = np.flatnonzero((np.diff(hits[0]) != 0) | (np.diff(hits[1]) != 0)) + 1
                for part in np.split(hits, cuts, axis=1) if hits.shape[1] else []:
                    doc, item = int(part[0, 0]), int(part[1, 0])
                    q = items.units[item]
                    out.append((doc, item, kind, *_compared(hashes[first[doc] : first[doc + 1]], q, part[2], gap), len(q)))
            if out:
                docs, *rest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)).take(pa.array(docs)), items.ids.take(pa.array(rest[0])), pa.array(rest[1]), *(pa.array(x, type=pa.int32()) for x in rest[2:])],
                    names=["doc_id", "item_id", "unit", "longest_run", "tolerant_span", "tolerant_equal", "first_unit", "item_units"],
                )


def leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", lang: str = "lang", gap: int = GAP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each document and item that a seed brings together, with the passages they share.

    Columns: doc_id, item_id, unit (word or char), longest_run (units in a row that are equal), tolerant_span and
    tolerant_equal (the best stretch with at most ``gap`` replaced units between equal ones), first_unit (where it
    begins in the document), item_units. Null or empty texts and rows without id share nothing; repeated rows count once.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"), F.when(F.col(lang).isin(*BY_CHARACTER), "char").otherwise("word").alias("kind")).where("item_id is not null and text is not null").distinct()
    blocks = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    types = {n: d.schema[f"{n}_id"].dataType.simpleString() for n, d in (("doc", docs), ("item", asked))}
    out = None
    for k in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()  # about ``block_chars`` characters
        shared = documents.sparkSession.sparkContext.broadcast(part)
        found = docs.mapInArrow(
            lambda batches, shared=shared: _leak_rows(batches, Items(shared.value), gap),
            f"doc_id {types['doc']}, item_id {types['item']}, unit string, longest_run int, tolerant_span int, tolerant_equal int, first_unit int, item_units int",
        )
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def leaked(found: DataFrame, equal: float = EQUAL) -> DataFrame:
    """The rows of ``leaks`` with a passage of the least length, exact or with at least the share ``equal`` of its units.

    ``exact`` tells the two apart.
    """
    least = F.when(F.col("unit") == "char", MIN_CHARS).otherwise(MIN_WORDS)
    exact = F.col("longest_run") >= least
    tolerant = (F.col("tolerant_span") >= least) & (F.col("tolerant_equal") >= F.col("tolerant_span") * equal)
    return found.withColumn("exact", exact).where(exact | tolerant)
