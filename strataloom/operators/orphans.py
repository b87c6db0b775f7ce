"""References to records that do not exist (or not yet).

Keys are dictionary-encoded as integers; per key range and period the referenced keys and the keys whose record
exists by then become compressed bitmaps; ``reference AND NOT parent`` leaves the keys without a record, and the
surviving bits are decoded to keys and joined back to the referring rows.

Nothing here grows with the number of rows of one key: references are reduced to one row per key and period before
the shuffle, a key range holds at most 2**15 different keys, and the last join is an equi-join that adaptive
execution splits where one orphan key is held by very many rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.times import utc
from strataloom.operators.bitmaps import Container

RANGE_BITS = 15
NO_PERIOD = 2_000_000_000
ALWAYS = -(1 << 62)

REF_COLUMNS = ["table_name", "field_name", "record_id", "key", "created_at", "report_at"]
PARENT_COLUMNS = ["table_name", "field_name", "key", "created_at"]


def month_of(ms: str) -> F.Column:
    """Months since year 0 of an epoch-millisecond column, ``NO_PERIOD`` where it is null."""
    ts = utc(ms)
    return F.coalesce(F.year(ts) * 12 + F.month(ts) - 1, F.lit(NO_PERIOD)).cast("int")


def references(
    table: DataFrame, table_name: str, field: str, *, scope: Sequence[str] = (), created: str | None = "created_at", report: str | None = None, record_id: str = "id"
) -> DataFrame:
    """The non-null, non-empty values of ``field`` as reference rows.

    ``scope`` columns become part of the key (null matches null); ``created`` None means that time doesn't matter.
    ``report`` names the epoch-millisecond column whose month the report counts by (default: ``created``).
    """
    return table.where(F.col(field).isNotNull() & (F.col(field) != "")).select(
        F.lit(table_name).alias("table_name"),
        F.lit(field).alias("field_name"),
        F.col(record_id).cast("string").alias("record_id"),
        compound([*scope, field]).alias("key"),
        (F.col(created) if created else F.lit(None)).cast("long").alias("created_at"),
        (F.col(report or created) if report or created else F.lit(None)).cast("long").alias("report_at"),
    )


def parents(table: DataFrame, relation: tuple[str, str], key: str, *, scope: Sequence[str] = (), created: str | None = "created_at") -> DataFrame:
    """The keys that exist for ``relation`` (table, field); a null creation time counts as always there."""
    when = F.coalesce(F.col(created).cast("long"), F.lit(ALWAYS)) if created else F.lit(ALWAYS)
    return table.where(F.col(key).isNotNull()).select(F.lit(relation[0]).alias("table_name"), F.lit(relation[1]).alias("field_name"), compound([*scope, key]).alias("key"), when.alias("created_at"))


def compound(columns: Sequence[str]) -> F.Column:
    """A key of several columns, each led by its length so that no two tuples look alike."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    return F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns])


def _andnot_range(table: pa.Table) -> pa.Table:
    """All relations of one key range: bitmaps per period, then the surviving (key, period) pairs."""
    slot = table["slot"].to_numpy() & ((1 << RANGE_BITS) - 1)
    first = table["first_at"].to_numpy(zero_copy_only=False)
    exists = ~np.asarray(table["first_at"].is_null())
    first_period = table["first_period"].to_numpy(zero_copy_only=False)
    lists = table["periods"].combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    row_of = np.repeat(np.arange(len(slot)), counts)
    periods = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    relation = table["relation"].to_numpy(zero_copy_only=False)
    keys, out_row, out_period = np.full(1 << RANGE_BITS, -1), [], []
    for name in np.unique(relation):
        own = relation == name
        rows = np.flatnonzero(own)
        keys[slot[rows]] = rows
        mine = own[row_of]
        there, known = Container.of([]), rows[exists[rows]]
        order = known[np.argsort(first_period[known], kind="stable")]
        upto = 0
        for period in np.unique(periods[mine]):
            wanted = Container.of(slot[row_of[mine & (periods == period)]])
            end = upto + int(np.searchsorted(first_period[order[upto:]], period, side="right"))
            there, upto = there | Container.of(slot[order[upto:end]]), end
            born_now = Container.of(slot[known[first_period[known] == period]])
            left = wanted.andnot(there) | (wanted & born_now)  # born in the same month: the rows' own times decide
            found = keys[left.values()]
            out_row.append(found)
            out_period.append(np.full(len(found), period, dtype=np.int32))
    row = np.concatenate(out_row) if out_row else np.array([], dtype=np.int64)
    period = np.concatenate(out_period) if out_period else np.array([], dtype=np.int32)
    taken = table.take(pa.array(row, type=pa.int64()))
    return pa.table({"table_name": taken["table_name"], "field_name": taken["field_name"], "key": taken["key"], "period": pa.array(period, type=pa.int32()), "first_at": taken["first_at"]})


def orphan_keys(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """(table_name, field_name, key, period, first_at) of keys without a record in that period.

    ``first_at`` is null where no record exists at all, else the time of the first one.
    """
    relation = ["table_name", "field_name"]
    asked = refs.select(*relation, "key", month_of("created_at").alias("period"), F.lit(None).cast("long").alias("first_at"))
    known = targets.select(*relation, "key", F.lit(None).cast("int").alias("period"), F.col("created_at").alias("first_at"))
    per_key = (
        asked.unionByName(known)
        .groupBy(*relation, "key")
        .agg(F.collect_set("period").alias("periods"), F.min("first_at").alias("first_at"))  # as many periods as there are months
        .where(F.size("periods") > 0)
    )
    encoded = (
        per_key.sortWithinPartitions(*relation, "key")
        .withColumn("slot", F.monotonically_increasing_id())
        .withColumn("key_range", F.shiftright("slot", RANGE_BITS))
        .withColumn("relation", F.concat_ws(".", *relation))
        .withColumn("first_period", F.when(F.col("first_at") == ALWAYS, F.lit(-1)).otherwise(month_of("first_at")))
    )
    return encoded.groupBy("key_range").applyInArrow(_andnot_range, "table_name string, field_name string, key string, period int, first_at long")


def orphan_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Reference rows (``REF_COLUMNS``) without a target row, or whose target rows are all created later.

    Rows repeated with the same record, key and times count once. A null ``created_at`` of the referring row is later
    than any target; a null one of a target is earlier than any reference. Empty inputs give no rows.
    """
    refs = refs.distinct()
    gone = orphan_keys(refs, targets)
    joined = refs.withColumn("period", month_of("created_at")).join(gone, ["table_name", "field_name", "key", "period"])
    late = F.col("first_at").isNull() | (F.col("created_at") < F.col("first_at"))
    return joined.where(late).select(*REF_COLUMNS)


def orphan_report(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """References and orphans per table, field and month (``yyyy-MM``, null where the time is unknown)."""
    month = F.date_format(utc("report_at"), "yyyy-MM").alias("month")
    both = refs.distinct().select("table_name", "field_name", month, F.lit(1).alias("r"), F.lit(0).alias("o")).unionByName(
        orphans.select("table_name", "field_name", month, F.lit(0).alias("r"), F.lit(1).alias("o"))
    )
    return both.groupBy("table_name", "field_name", "month").agg(F.sum("r").cast("long").alias("n_references"), F.sum("o").cast("long").alias("n_orphans"))
