"""Joins, rankings, roll-ups and diffs that the queries share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def mode_by(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column | str] | None = None) -> DataFrame:
    """The most common value of each key; ties go to the first in ``order`` (default: the value itself)."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return first_per(counted, keys, [F.desc("n"), *(order or [value])])


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass; nulls are dropped."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def smallest_enclosing(points: DataFrame, spans: DataFrame, keys: Sequence[str], point_id: str, width: int = 512, own: str | None = None) -> DataFrame:
    """Each point row with the shortest span of the same keys that holds [start_line, end_line]; null where none does.

    ``spans`` has span_id, span_start, span_end. Both sides meet on a block of ``width`` lines, so that a file of very
    many spans doesn't meet itself as a whole; spans are repeated for the blocks they reach into. The first of equally
    short spans (by start, then id) wins. Null lines match nothing. With ``own`` = "span_id", a point's own span doesn't
    count.
    """
    cut = spans.where("span_start <= span_end").withColumn("_b", F.explode(F.sequence(F.floor(F.col("span_start") / width), F.floor(F.col("span_end") / width))))
    met = points.withColumn("_b", F.floor(F.col("start_line") / width)).join(cut, [*keys, "_b"]).where("span_start <= start_line and span_end >= end_line")
    if own:
        met = met.where(F.col(own) != F.col(point_id))
    best = met.groupBy(point_id).agg(F.min(F.struct((F.col("span_end") - F.col("span_start")).alias("size"), F.col("span_start"), F.col("span_id"))).alias("s"))
    return points.join(best.select(point_id, F.col("s.span_id").alias("span_id")), point_id, "left")


def diff(current: DataFrame, previous: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change) with added, removed, changed or unchanged."""
    c = current.select(key, F.col(value).alias("_c"), F.lit(1).alias("_in"))
    p = previous.select(key, F.col(value).alias("_p"), F.lit(1).alias("_was"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_in").isNull(), "removed").when(F.col("_c").eqNullSafe(F.col("_p")), "unchanged").otherwise("changed")
    return c.join(p, key, "full_outer").select(key, change.alias("change"))


def ancestors(path: Column) -> Column:
    """All directories above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def pack(df: DataFrame, keys: Sequence[str], order: str, size: str, budget: int) -> DataFrame:
    """Each row's keys and order with its batch number, from 0: rows fill a batch in order until the next would pass the budget.

    The reset depends on what is in the batch, so a key is folded row by row: its sizes stream through one task in
    order (no other columns do), which keeps two numbers per key. Null sizes count as 0; a row over the budget is a
    batch of its own.
    """
    narrow = df.select(*keys, order, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name != "_size") + ", batch int"
    names = list(keys)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used, batch = None, 0, 0
        for frame in frames:
            out = []
            for now, n in zip(frame[names].itertuples(index=False, name=None), frame["_size"], strict=True):
                if now != key:
                    key, used, batch = now, 0, 0
                if used and used + n > budget:
                    used, batch = 0, batch + 1
                used += n
                out.append(batch)
            yield frame[[*names, order]].assign(batch=pd.Series(out, dtype="int32", index=frame.index))

    return narrow.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(fold, schema)


def entries(df: DataFrame, extension: str | None = None, **allowed: Sequence[str] | None) -> DataFrame:
    """Rows that meet all given conditions; a column's None means no condition. A leading dot of the extension goes."""
    for column, values in allowed.items():
        if values is not None:
            df = df.where(F.col(column).isin(*values))
    return df if extension is None else df.where(F.col("extension") == extension.lstrip(".").lower())


def resolved(rows: DataFrame, own: str, tiers: Sequence[Sequence[str]]) -> DataFrame:
    """The rows with another one's ``own`` as target, of the first tier (from 1) whose columns agree, its smallest one.

    A key needs its two smallest names only, so rows never meet all rows of their key. Rows that no other one matches
    are left out.
    """
    out = rows
    for n, keys in enumerate(tiers, 1):
        keys = list(keys)
        low = rows.groupBy(*keys).agg(F.min(own).alias("_low"))
        second = rows.join(low, keys).where(F.col(own) != F.col("_low")).groupBy(*keys).agg(F.min(own).alias("_second"))
        out = out.join(low.join(second, keys, "left"), keys, "left")
        out = out.withColumn(f"_t{n}", F.when(F.col("_low") != F.col(own), F.col("_low")).otherwise(F.col("_second"))).drop("_low", "_second")
    found = [F.col(f"_t{n}") for n in range(1, len(tiers) + 1)]
    tier = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in enumerate(found, 1)])
    return out.select(*rows.columns, F.coalesce(*found).alias("target"), tier.alias("tier")).where("target is not null")


def clamped(df: DataFrame, keys: Sequence[str], order: str, start: Column, end: Column) -> DataFrame:
    """``start_ms`` never before an earlier row's, ``end_ms`` never after the next row's start."""
    w = Window.partitionBy(*keys).orderBy(order)
    made = df.withColumn("start_ms", F.max(start).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_long", F.greatest(end - start, F.lit(0)))
    ends = F.col("start_ms") + F.col("_long")
    return made.withColumn("end_ms", F.least(ends, F.coalesce(F.lead("start_ms").over(w), ends))).drop("_long")


def stacked(parts: Sequence[tuple[str, DataFrame]], name: str = "origin") -> DataFrame:
    """Tables of different columns in one, each row with its table's name; missing columns are null."""
    out = None
    for origin, df in parts:
        df = df.withColumn(name, F.lit(origin))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def transitions(states: DataFrame, key: str, state: str, order: Sequence[str], allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, before, state, allowed) of each change between two states of a key that follow each other."""
    before = states.withColumn("before", F.lag(state).over(Window.partitionBy(key).orderBy(*order))).where(f"before is not null and before <> {state}")
    return before.select(key, "before", state, F.concat_ws(">", "before", state).isin(*[f"{a}>{b}" for a, b in allowed]).alias("allowed"))


def reassembled(pieces: DataFrame, key: str, start: str, size: str) -> DataFrame:
    """(key, received, length, gaps): pieces put together by offset; one that comes twice counts once."""
    p = pieces.groupBy(key, start).agg(F.max(size).alias(size))
    reached = F.max(F.col(start) + F.col(size)).over(Window.partitionBy(key).orderBy(start).rowsBetween(Window.unboundedPreceding, -1))
    gap = p.withColumn("_gap", F.col(start) > F.coalesce(reached, F.lit(0)))
    return gap.groupBy(key).agg(F.sum(size).alias("received"), F.max(F.col(start) + F.col(size)).alias("length"), F.count_if("_gap").alias("gaps"))


def throttled(events: DataFrame, keys: Sequence[str], at: str, every_ms: int, event_id: str) -> DataFrame:
    """The first event of each key and slot of ``every_ms`` milliseconds."""
    slot = F.floor(F.unix_millis(F.col(at).cast("timestamp")) / every_ms).alias("slot")
    return events.groupBy(*keys, slot).agg(F.min(event_id).alias(event_id))


def without(tables: dict[str, DataFrame], dead: DataFrame, key: str) -> dict[str, DataFrame]:
    """The tables without the rows of dead keys."""
    return {name: df.join(dead.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def numbered(df: DataFrame, keys: Sequence[str], name: str, order: Sequence[Column | str]) -> DataFrame:
    """``stored``: the name, and from its second use on with -2, -3, ... before its extension."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order))
    stem, extension = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.[^.]*$", 0)
    return df.withColumn("_n", n).withColumn("stored", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), F.col("_n").cast("string"), extension))).drop("_n")
