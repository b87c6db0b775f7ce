"""Near-duplicate records: banded MinHash, sequential Bayesian pruning, exact verification.

A record is the multiset of its words; the n-th occurrence of a word is an element of its own, so that the overlap of
two records is the size of a plain set intersection. Records with the same multiset form a class and only one of each
class is compared.

The wanted overlap (words shared over words of the longer record) of at least s means a Jaccard similarity of the
element sets of at least s / (2 - s). Bands are tuned for that value: BANDS bands of ROWS rows miss a pair just at the
threshold s = 0.8 with probability (1 - (2/3)**7)**100 = 0.0024, one of overlap 0.82 with 0.0003. GROUP bands at a time
are shuffled and their pairs written, and their shuffle files go before the next ones, so that disk does not grow with
the number of bands; texts are cut into words once. Pairs that meet in a band compare four-bit signatures in batches;
after each batch a pair is dropped when the posterior probability (uniform prior) that it reaches the threshold is below
MISS. Survivors are verified on all their words. A band that very many bags share is cut into blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.arrays import U64, Rolling, chunks, code_points, lower, mix, word_spans
from strataloom.session import written

BANDS, ROWS, SIGNATURE, BATCH, MISS = 100, 7, 64, 16, 1e-4
GROUP = 34
#: Elements hashed at a time, so that their hashes stay in the processor's cache.
STRIP = 128
PAIRS = 1 << 20
#: Rows of a band (estimated from one in SAMPLE of the bags) from which it is cut into blocks that meet two by two.
HOT, SAMPLE = 8192, 64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def elements(texts: pa.Array) -> list[np.ndarray]:
    """For each text the 64-bit hashes of (word, n-th occurrence), in an order that depends on the words only."""
    out: list[np.ndarray] = []
    for _, part in chunks(texts):
        points, starts = code_points(part)
        small = lower(points)
        begin, end, owner = word_spans(small, starts)
        hashes = Rolling(small)(begin, end)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        first = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])[: len(hashes)]
        at = np.arange(len(hashes))
        occurrence = at - np.maximum.accumulate(np.where(first, at, 0)) if len(at) else at
        made = hashes + occurrence.astype(U64) * U64(0x9E3779B97F4A7C15)
        out += np.split(made, np.searchsorted(owner, np.arange(1, len(part))))
    return out


@functools.cache
def _coefficients() -> np.ndarray:
    n = BANDS * ROWS + SIGNATURE
    return (mix(np.arange(1, n + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)


def packed(bags: list[np.ndarray]) -> list[bytes]:
    """48 bits of each item's hash: all high 32-bit parts, which MinHash works on, then all low 16-bit parts."""
    h = mix(np.concatenate([np.array([], dtype=U64), *bags]))
    high, low = (h >> U64(32)).astype(np.uint32), (h >> U64(16)).astype(np.uint16)
    ends = np.cumsum([0, *map(len, bags)])
    return [high[i:j].tobytes() + low[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]


def high_parts(items: bytes) -> np.ndarray:
    return np.frombuffer(items, dtype=np.uint32, count=len(items) // 6)


def unpacked(items: bytes) -> np.ndarray:
    n = len(items) // 6
    return (high_parts(items).astype(U64) << U64(16)) | np.frombuffer(items, dtype=np.uint16, offset=4 * n)


class MinHashes:
    """The smallest value of 32-bit hashes under each of the hash functions ``lo`` to ``hi``."""

    def __init__(self, lo: int, hi: int) -> None:
        self.a = _coefficients()[lo:hi]
        self.room = np.empty((STRIP, len(self.a)), dtype=np.uint32)

    def __call__(self, bags: list[bytes]) -> np.ndarray:
        """A row of values per bag of packed items; none may be empty."""
        out = np.empty((len(bags), len(self.a)), dtype=np.uint32)
        for low, bag in zip(out, bags, strict=True):
            short = high_parts(bag)[:, None]
            np.minimum.reduce(np.multiply(short[:STRIP], self.a, out=self.room[: min(len(short), STRIP)]), axis=0, out=low)
            for at in range(STRIP, len(short), STRIP):
                part = short[at : at + STRIP]
                np.minimum(low, np.multiply(part, self.a, out=self.room[: len(part)]).min(axis=0), out=low)
        return out


def _bag(items: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(items.tobytes()) - (1 << 63)


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bag, signature, items); the last two only where the task meets the bag for the first time."""
    sign, seen = MinHashes(BANDS * ROWS, BANDS * ROWS + SIGNATURE), set()
    for batch in batches:
        made = elements(batch.column(1))
        worded = [k for k, items in enumerate(made) if len(items)]
        bags = [_bag(made[k]) for k in worded]
        first = [n for n, bag in enumerate(bags) if not (bag in seen or seen.add(bag))]
        items = packed([made[worded[n]] for n in first])
        halves = mix(sign(items)).astype(np.uint8) & 15
        signatures = halves[:, ::2] | halves[:, 1::2] << 4
        kept = dict(zip(first, zip((x.tobytes() for x in signatures), items, strict=True), strict=True))
        both = [kept.get(n, (None, None)) for n in range(len(bags))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(worded, type=pa.int64())), pa.array(bags, type=pa.int64()), pa.array([x for x, _ in both], type=pa.binary()), pa.array([x for _, x in both], type=pa.binary())],
            names=["id", "bag", "signature", "items"],
        )


def _band_rows(batches: Iterator[pa.RecordBatch], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, ROWS + 1, dtype=U64)) | U64(1)
    number = np.arange(lo, hi, dtype=U64) * U64(0xD6E8FEB86659FD93)
    least = MinHashes(lo * ROWS, hi * ROWS)
    for batch in batches:
        bands = mix((least(batch.column(1).to_pylist()).reshape(len(batch), hi - lo, ROWS) * salt).sum(axis=2, dtype=U64) + number)
        yield pa.RecordBatch.from_arrays([pa.array(bands.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), hi - lo))], names=["band", "bag"])


def _met_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) with a < b of each two bags of a band, from rows in the order of their bands; a band may span batches."""

    def pairs(band: np.ndarray, bag: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((bag, band))
        band, bag = band[order], bag[order]
        new = np.concatenate([[True], (band[1:] != band[:-1]) | (bag[1:] != bag[:-1])])[: len(band)]
        band, bag = band[new], bag[new]
        after = np.searchsorted(band, band, side="right") - np.arange(len(band)) - 1
        total = np.concatenate([[0], np.cumsum(after)])
        at = 0
        while at < len(band) and total[at] < total[-1]:
            end = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
            n = after[at:end]
            x = np.repeat(np.arange(at, end), n)
            y = x + 1 + np.arange(len(x)) - np.repeat(total[at:end] - total[at], n)
            yield pa.RecordBatch.from_arrays([pa.array(bag[x]), pa.array(bag[y])], names=["a", "b"])
            at = end

    band = bag = np.array([], dtype=np.int64)
    for batch in batches:
        if not len(batch):
            continue
        band, bag = np.concatenate([band, batch.column(0).to_numpy()]), np.concatenate([bag, batch.column(1).to_numpy()])
        whole = np.searchsorted(band, band[-1])
        yield from pairs(band[:whole], bag[:whole])
        band, bag = band[whole:], bag[whole:]
    yield from pairs(band, bag)


def bands_of(bags: DataFrame, lo: int, hi: int) -> DataFrame:
    """(band, bag) of the bands ``lo`` to ``hi`` of each (bag, items)."""
    return bags.select("bag", "items").mapInArrow(lambda b: _band_rows(b, lo, hi), "band long, bag long")


def spread(banded: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of the hot bands, repeated so that each two blocks of a band share a key of their own.

    ``hot`` has band and blocks. Any two rows of a band still share a key, so no pair is lost.
    """
    own = F.pmod(F.xxhash64("bag"), F.col("blocks").cast("long"))
    cut = banded.join(hot, "band", "left").withColumn("j", F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))))
    key = F.when(F.col("blocks") > 1, F.xxhash64("band", F.least(own, F.col("j").cast("long")), F.greatest(own, F.col("j").cast("long")))).otherwise(F.col("band"))
    return cut.select(key.alias("band"), "bag")


def candidates(bags: DataFrame, jaccard: float, hot_rows: int = HOT) -> DataFrame:
    """(a, b) of the bags that meet in a band and that their signatures don't part, from (bag, signature, items).

    ``GROUP`` bands are on disk at a time; a pair that several groups find is compared in each and counts once. Bands
    of about ``hot_rows`` rows or more are cut into blocks; which they are is estimated from one bag in SAMPLE, and
    decides only how the work is spread.
    """
    conf, out = bags.sparkSession.conf, None
    some = bags.where(F.pmod("bag", F.lit(SAMPLE)) == 0)
    hot = bands_of(some, 0, BANDS).groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE >= hot_rows)
    hot = written(hot.select("band", F.ceil(F.col("n") * SAMPLE / hot_rows + 1).cast("int").alias("blocks")))
    any_hot = not hot.isEmpty()
    marks = bags.select("bag", "signature").dropDuplicates(["bag"])
    left, right = (marks.select(F.col("bag").alias(n), F.col("signature").alias("s" + n)).hint("merge") for n in "ab")
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        for lo in range(0, BANDS, GROUP):
            banded = bands_of(bags, lo, min(lo + GROUP, BANDS))
            banded = spread(banded, hot) if any_hot else banded
            met = banded.repartition("band").sortWithinPartitions("band").mapInArrow(_met_rows, "a long, b long").distinct()
            part = written(met.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(lambda batches: _pruned(batches, jaccard), "a long, b long"))
            out = part if out is None else out.unionByName(part)
        return written(out.distinct())
    finally:
        conf.set(CLEANUP, before)


@functools.cache
def least_matches(threshold: float) -> tuple[int, ...]:
    """For each number of compared batches, the fewest equal values with which a pair stays."""
    j = np.linspace(0, 1, 4001)[1:-1]
    p = j + (1 - j) / 16
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[j >= threshold].sum() / weight.sum() >= MISS:
                out.append(m)
                break
    return tuple(out)


def _pruned(batches: Iterator[pa.RecordBatch], jaccard: float) -> Iterator[pa.RecordBatch]:
    least = least_matches(jaccard)
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, SIGNATURE // 2) for k in (2, 3))
        alive, equal = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for k, fewest in enumerate(least):
            part = slice(k * BATCH // 2, (k + 1) * BATCH // 2)
            differ = x[alive, part] ^ y[alive, part]
            equal[alive] += ((differ & 15) == 0).sum(axis=1) + ((differ >> 4) == 0).sum(axis=1)
            alive = alive[equal[alive] >= fewest]
        yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(alive)) for k in (0, 1)], names=["a", "b"])


def texts_of(df: DataFrame, id_column: str, texts: Sequence[str]) -> DataFrame:
    """(id, t): each record's texts together; rows without id are left out."""
    return df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("string").alias("id"), F.concat_ws("\n", *[F.col(t).cast("string") for t in texts]).alias("t"))


def _overlaps(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, similarity = [], []
        for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            longer = max(len(x), len(y)) // 6
            if min(len(x), len(y)) // 6 * 100 < longer * percent:
                continue
            shared = len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True))
            if shared * 100 >= longer * percent:
                kept.append(k)
                similarity.append(shared / longer)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(kept, type=pa.int64())) for c in (0, 1)), pa.array(similarity, type=pa.float64())], names=["a", "b", "similarity"])


def near_bags(bags: DataFrame, overlap: float, hot_rows: int = HOT) -> DataFrame:
    """(a, b, similarity) of the word multisets that are near but not equal, from (bag, signature, items).

    The words of the bags in the pairs that are left are compared one by one (by 48 bits of their hashes).
    """
    kept = candidates(bags, overlap / (2 - overlap), hot_rows)
    needed = kept.select(F.explode(F.array("a", "b")).alias("bag")).distinct()
    words = bags.select("bag", "items").join(needed, "bag", "left_semi").dropDuplicates(["bag"])
    full = kept.join(words.withColumnsRenamed({"bag": "a", "items": "ia"}), "a").join(words.withColumnsRenamed({"bag": "b", "items": "ib"}), "b")
    percent = round(overlap * 100)
    return full.select("a", "b", "ia", "ib").mapInArrow(lambda batches: _overlaps(batches, percent), "a long, b long, similarity double")


def near_duplicates(df: DataFrame, id_column: str, texts: Sequence[str], overlap: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, rep) of each record and (a, b, similarity) of each two near classes.

    Records whose words are the same in any order share a class, named by the 64-bit digest of its word multiset. Null
    texts count as empty; records without any word belong to no class, rows without id are left out and repeated rows
    count once. Other columns are ignored. A record delivered with several texts is a member of several classes.
    """
    records = texts_of(df, id_column, texts)
    bags = written(records.mapInArrow(_bag_rows, "id string, bag long, signature binary, items binary"))
    return bags.select("id", F.col("bag").alias("rep")).distinct(), near_bags(bags.where("items is not null"), overlap)


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every two different records of one class or of two near classes: (a, b) with a < b."""
    within = members.alias("x").join(members.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    left = members.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
    right = members.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    across = pairs.join(left, "a").join(right, "b").where("ia <> ib").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    return within.unionByName(across).distinct()
