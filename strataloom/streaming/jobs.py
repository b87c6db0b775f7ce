"""Event streams: windows with late data, change feeds and stale records, as streams and in batch."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataloom.session import shared_folder


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of Parquet files as a stream of its files, event times as timestamps."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    if os.path.isdir(f"{sf_dir}/{table}.parquet"):
        return reader.parquet(f"{sf_dir}/{table}.parquet")
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and read back what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").start(f"{base}/out").awaitTermination()
    else:

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out") if mode == "append" else spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").drop("batch")


def tumbling(events: DataFrame, minutes: int, late: str | None = None) -> DataFrame:
    """(began, event_type, n, total) per window; ``late`` is a stream's watermark."""
    e = events.withColumn("t", F.col("ts").cast("timestamp"))
    e = e.withWatermark("t", late) if late else e
    return e.groupBy(F.window("t", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("began"), "event_type", "n", "total")


def sliding(events: DataFrame, minutes: int, step: int) -> DataFrame:
    """(began, n) per sliding window."""
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes", f"{step} minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("began"), "n")


def changes(events: DataFrame) -> DataFrame:
    """The events of a user whose type differs from the one before: a change feed in batch."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("before", before).where("before is null or before <> event_type").select("event_id", "user_id", "event_type", "before")


def _emit_changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])  # of one user and micro-batch
    before = rows["event_type"].shift(1)
    before.iloc[0] = last
    state.update((rows["event_type"].iloc[-1],))
    out = rows.assign(before=before)
    out = out[out["before"].isna() | (out["before"] != out["event_type"])]
    yield out[["event_id", "user_id", "event_type", "before"]]


def change_stream(events: DataFrame) -> DataFrame:
    """The same feed on a stream: the last type of each user is kept as state between micro-batches."""
    schema = "event_id long, user_id long, event_type string, before string"
    return events.groupBy("user_id").applyInPandasWithState(_emit_changes, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def stale(jobs: DataFrame, now_ms: int, horizon_ms: int = 90_000) -> DataFrame:
    """Running jobs whose last heartbeat is older than the horizon."""
    last = jobs.groupBy("id").agg(F.max_by("status", F.struct(F.coalesce("heartbeat_at", "started_at", "created_at"), "status")).alias("status"), F.max("heartbeat_at").alias("heartbeat_at"))
    return last.where((F.col("status") == "running") & (F.col("heartbeat_at") < now_ms - horizon_ms)).select("id", "heartbeat_at")
