"""Files of folders and archives as rows, with the limits that untrusted input needs."""

from __future__ import annotations

import io
import posixpath
import re
import stat
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDED = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", "coverage", "target")


def read_folder(spark: SparkSession, root: str, *, max_bytes: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """(files, pruned): path, length, content of each file, and the number of files in each excluded folder.

    Contents over ``max_bytes`` are null; excluded folders are never read, only counted.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    named = found.withColumn("path", below)
    bad = "(^|/)(" + "|".join(map(re.escape, EXCLUDED)) + ")/"
    pruned = named.select("path").where(F.col("path").rlike(bad)).groupBy(F.regexp_extract("path", "^(.*?" + bad + ")", 1).alias("folder")).agg(F.count("*").alias("n"))
    return named.where(~F.col("path").rlike(bad)).select("path", "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content")), pruned


def safe_path(name: str) -> str | None:
    """The entry's path below the archive's root, or None for one that leaves it."""
    name = name.replace("\\", "/")
    if name.startswith("/") or re.match(r"[A-Za-z]:", name) or "\0" in name:
        return None
    path = posixpath.normpath(name)
    return None if path.startswith("..") or path in (".", "") else path


def entries(data: bytes, *, max_entries: int = 300_000, max_bytes: int = 2 << 20, max_ratio: int = 200) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """(path, size, content, reason it was skipped) of each entry of a ZIP archive."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        yield "", 0, None, "no archive"
        return
    for k, info in enumerate(archive.infolist()):
        if k >= max_entries:
            yield info.filename, info.file_size, None, "too many entries"
            return
        if info.is_dir():
            continue
        path = safe_path(info.filename)
        reason = "unsafe path" if path is None else "link" if stat.S_ISLNK(info.external_attr >> 16) else "too large" if info.file_size > max_bytes else "ratio" if info.file_size > max_ratio * max(info.compress_size, 1) else None
        if reason:
            yield path or info.filename, info.file_size, None, reason
            continue
        try:
            with archive.open(info) as f:
                content = f.read(max_bytes + 1)
            yield path, len(content), None if len(content) > max_bytes else content, "too large" if len(content) > max_bytes else None
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as e:
            yield path, info.file_size, None, type(e).__name__


def read_archives(spark: SparkSession, pattern: str, **limits: int) -> DataFrame:
    """(archive, path, size, content, skipped) of the entries of all ZIP archives of a path pattern."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                for row in entries(data, **limits):
                    yield pd.DataFrame([(name, *row)], columns=["archive", "path", "size", "content", "skipped"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "archive string, path string, size long, content binary, skipped string")
