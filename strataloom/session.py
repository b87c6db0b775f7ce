"""Session set-up and durable materialisation."""

from __future__ import annotations

import atexit
import importlib.util
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset
    (a single-machine test session) a temporary folder of this machine is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one of ``spark.checkpoint.dir``, else the context's checkpoint folder.

    A session of one machine that names neither gets a temporary folder; a cluster must name one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = sc._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(sc, "_strataloom_folder"):
        sc._strataloom_folder = "file://" + tempfile.mkdtemp(prefix="strataloom-shared-")
    return sc._strataloom_folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, removed when the session ends.

    Smaller on disk than a checkpoint, and its columns can be read one by one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strataloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session is gone already
        pass


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_strataloom_shipped", False):
        return
    root = Path(importlib.util.find_spec("strataloom").origin).parent
    stage = Path(tempfile.mkdtemp(prefix="strataloom-ship-"))
    shutil.copytree(root, stage / "src" / "strataloom", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.fspath(stage / "strataloom"), "zip", stage / "src"))
    sc._strataloom_shipped = True
