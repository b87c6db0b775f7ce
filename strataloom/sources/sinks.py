"""Writing tables: append without conflicts, upsert, replace by project, and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose key the table lacks."""
    spark = df.sparkSession
    rows = df.dropDuplicates(list(keys))
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    rows.write.mode("append").parquet(path)


def merged(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` put in place of or beside its own; columns that changes lack stay."""
    own = [c for c in base.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in own if c in changes.columns], F.lit(True).alias("_new"))
    both = base.withColumn("_old", F.lit(True)).join(new, list(keys), "full_outer")
    return both.select(*keys, *[F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns else F.col(c) for c in own])


def replace_partitions(df: DataFrame, path: str, by: str = "project_id") -> None:
    """Overwrite only the projects that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def json_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as one JSON document, nulls included."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def markdown_table(df: DataFrame, group: str, columns: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """(group, markdown): a table of the first ``most`` rows of each group (the cut is the report's)."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= most)
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    body = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias("rows"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    return body.select(group, F.concat(F.lit(head + "\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("markdown"))
