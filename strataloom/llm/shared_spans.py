"""Long stretches of text that stand word for word in more than one record.

Banding whole paragraphs (``paragraph_clusters``) finds paragraphs that are near-copies and clusters them for removal,
but a stretch that lies inside unlike paragraphs never collides there. The spans themselves are therefore found by
another method, winnowing: of each window of SPAN characters the smallest hash of its K-grams is kept; equal windows
have equal ones, so each stretch of SPAN characters that two records share collides, whatever stands around it.
Neighbouring windows mostly share their smallest K-gram; a run of them is one row, about two in (SPAN - K + 2)
characters.

Colliding runs are then verified exactly: first the hashes of a run's first and last window; where both also stand in
another record, all windows between lie inside the two. Runs with an end that no other record has are resolved window
by window, together with all runs of the same smallest K-gram (equal windows have equal ones). Records are never paired: a window is shared when its smallest and its largest owner differ, which a
map-side combined aggregation finds for windows of any number of owners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.arrays import U64, Rolling, chunks, code_points
from strataloom.llm.near_duplicates import near_duplicates
from strataloom.operators.components import connected_components
from strataloom.session import written

SPAN, K, MOST_RUN = 240, 90, 200
#: Characters of the shortest paragraph that is compared.
PARAGRAPH = 40


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours (van Herk's two passes)."""
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, w)
    prefix = np.minimum.accumulate(padded, axis=1).ravel()
    suffix = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n], prefix[w - 1 : w - 1 + n])


def runs(texts: pa.Array, span: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, smallest K-gram, hash of the first window, hash of the last window) of each run."""
    points, starts = code_points(texts)
    none = np.array([], dtype=np.int64)
    if len(points) < span:
        return none, none, none, none.view(U64), none.view(U64), none.view(U64)
    roll = Rolling(points)
    low = sliding_min(roll.windows(k), span - k + 1)
    owner = np.repeat(np.arange(len(texts)), np.maximum(0, np.diff(starts) - span + 1))
    windows = np.arange(len(owner)) + np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(starts) - span + 1))[:-1]]), np.maximum(0, np.diff(starts) - span + 1))
    low = low[windows]
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])) if len(low) else none
    size = np.diff(np.concatenate([first, [len(low)]]))
    parts = (size + MOST_RUN - 1) // MOST_RUN
    offset = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * MOST_RUN
    first, size = np.repeat(first, parts) + offset, np.minimum(np.repeat(size, parts) - offset, MOST_RUN)
    at, last = windows[first], windows[first + size - 1]
    return owner[first], at - starts[owner[first]], size, low[first], roll(at, at + span), roll(last, last + span)


def _run_rows(batches: Iterator[pa.RecordBatch], span: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in chunks(batch.column(1)):
            owner, at, size, low, head, tail = runs(texts, span, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, len(texts)).take(pa.array(owner)), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int16)), *(pa.array(x.view(np.int64)) for x in (low, head, tail))],
                names=["owner", "at", "size", "low", "head", "tail"],
            )


def _window_rows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for owner, text, ats, sizes in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            roll = Rolling(code_points(pa.array([text]))[0])
            at = np.unique(np.concatenate([np.arange(a, a + n) for a, n in zip(ats, sizes, strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), owner)), pa.array(at.astype(np.int32)), pa.array(roll(at, at + span).view(np.int64))], names=["owner", "at", "window"])


def _owned_twice(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).where("lo <> hi").select(key)


def shared_windows(df: DataFrame, id_column: str, text: str, span: int = SPAN, k: int = K, links: bool = False) -> DataFrame:
    """(owner, at, window): windows of ``span`` characters that also stand in another record, enough to cover all.

    ``owner`` is the 64-bit hash of the id, ``at`` the window's place, ``window`` its hash. Every character of a shared
    stretch lies in one of the windows. With ``links`` any two owners of a window are also linked through the windows
    given: runs of one smallest K-gram that are not all equal are resolved window by window, settled or not.
    """
    base = df.where(F.col(id_column).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(id_column).alias("owner"), F.col(text).alias("content"))
    found = written(base.where(F.length("content") >= span).mapInArrow(lambda b: _run_rows(b, span, k), "owner long, at int, size smallint, low long, head long, tail long"))
    met = written(found.join(_owned_twice(found.select("low", "owner"), "low").hint("merge"), "low", "left_semi"))
    ends = met.select("owner", "at", "size", F.explode(F.array(F.struct(F.col("at").alias("place"), F.col("head").alias("window")), F.struct((F.col("at") + F.col("size") - 1).alias("place"), F.col("tail").alias("window")))).alias("e")).select("owner", "at", "size", "e.*")
    good = written(ends.join(_owned_twice(ends.select("window", "owner"), "window").hint("merge"), "window", "left_semi").distinct())
    settled = good.groupBy("owner", "at", "size").agg(F.count_distinct("place").alias("n")).where((F.col("n") == 2) | (F.col("size") == 1)).select("owner", "at", "size")
    unsettled = met.join(settled, ["owner", "at", "size"], "left_anti").select("low").distinct()
    if links:
        differ = " or ".join(f"min({c}) <> max({c})" for c in ("head", "tail", "size"))
        unsettled = unsettled.unionByName(met.groupBy("low").agg(F.expr(differ).alias("differ")).where("differ").select("low")).distinct()
    open_runs = met.join(unsettled.hint("merge"), "low", "left_semi").groupBy("owner").agg(F.collect_list("at").alias("ats"), F.collect_list("size").alias("sizes"))  # of one record each
    singles = written(base.join(open_runs, "owner").select("owner", "content", "ats", "sizes").mapInArrow(lambda b: _window_rows(b, span), "owner long, at int, window long"))
    more = singles.join(_owned_twice(singles.select("window", "owner"), "window").hint("merge"), "window", "left_semi")
    return good.select("owner", F.col("place").alias("at"), "window").unionByName(more.select("owner", "at", "window")).distinct()


def shared_spans(df: DataFrame, id_column: str, text: str, span: int = SPAN, k: int = K) -> DataFrame:
    """Each record with the number of its characters that also stand in another record in stretches of ``span`` or more.

    Columns: id, n_chars, shared_chars. Null texts have no characters; rows without id are left out; repeated rows of
    one id are one record. Characters are code points.
    """
    windows = shared_windows(df, id_column, text, span, k)
    nxt = F.lead("at").over(_by_owner())
    covered = windows.select("owner", F.least(F.lit(span), F.coalesce(nxt - F.col("at"), F.lit(span))).alias("c")).groupBy("owner").agg(F.sum("c").alias("shared_chars"))
    records = df.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n_chars"))
    return records.join(covered.withColumnRenamed("owner", "o"), F.xxhash64("id") == F.col("o"), "left").select("id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))


def _by_owner():
    from pyspark.sql import Window

    return Window.partitionBy("owner").orderBy("at")


def sharing_ids(df: DataFrame, id_column: str, text: str, span: int = SPAN, k: int = K) -> DataFrame:
    """The ids of records with at least one shared stretch."""
    owners = shared_windows(df, id_column, text, span, k).select("owner").distinct()
    return df.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id")).join(owners, F.xxhash64("id") == F.col("owner"), "left_semi").distinct()


def sharing_groups(df: DataFrame, id_column: str, text: str, span: int = SPAN, k: int = K) -> DataFrame:
    """(id, group): records linked through shared windows, for removing all but one of a group.

    Each window links its owners to the smallest of them, so a window of n owners gives n - 1 links.
    """
    windows = shared_windows(df, id_column, text, span, k, links=True).select("window", "owner").distinct()
    least = windows.groupBy("window").agg(F.min("owner").alias("low"))
    links = windows.join(least.hint("merge"), "window").where("owner <> low").select(F.col("owner").alias("a"), F.col("low").alias("b")).distinct()
    groups = connected_components(links)
    ids = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id")).distinct()
    named = ids.join(groups, F.xxhash64("id") == F.col("node")).select("id", "component")
    return named.join(named.groupBy("component").agg(F.min("id").alias("group")), "component").select("id", "group")


def paragraph_clusters(df: DataFrame, id_column: str, text: str, least: int = PARAGRAPH, overlap: float = 0.8) -> DataFrame:
    """(id, paragraph_no, cluster, removed): paragraphs of ``least`` characters or more that near-copies exist of.

    Paragraphs are parted by blank lines and counted from 0. They are banded by MinHash, compared exactly on their
    words and clustered by connected components; all of a cluster but the first (by id and number) are to be removed.
    Null texts and rows without id have none; repeated rows count once.
    """
    known = df.where(F.col(id_column).isNotNull() & F.col(text).isNotNull()).select(F.col(id_column).cast("string").alias("i"), F.posexplode(F.split(text, r"\r?\n[^\S\n]*\r?\n")).alias("n", "t"))
    parts = known.where(F.length("t") >= least).select(F.concat_ws("\x1f", F.lpad(F.col("n").cast("string"), 10, "0"), "i").alias("id"), "t")
    members, pairs = near_duplicates(parts, "id", ["t"], overlap)
    linked = connected_components(pairs).withColumnRenamed("node", "rep")
    named = members.join(linked, "rep", "left").withColumn("cluster", F.coalesce("component", "rep"))
    order = F.struct(F.substring("id", 12, 1 << 30).alias("i"), F.substring("id", 1, 10).cast("int").alias("n"))
    placed = named.select("cluster", order.alias("o")).distinct()
    first = placed.groupBy("cluster").agg(F.min("o").alias("kept"), F.count("*").alias("copies")).where("copies > 1")
    return placed.join(first, "cluster").select(F.col("o.i").alias("id"), F.col("o.n").alias("paragraph_no"), "cluster", (F.col("o") != F.col("kept")).alias("removed"))
