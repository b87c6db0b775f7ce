"""Timed words as cues, caption files and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import stamp

MOST_MS, MOST_CHARS, LEAST_WORDS = 6000, 84, 3
STAMP = re.compile(r"(?:(\d+):)?(\d{2}):(\d{2})\.(\d{3})")


def interpolated(words: DataFrame) -> DataFrame:
    """Words (track, idx, text, start_ms) with every missing start set between its measured neighbours, by length.

    Starts never go back. Words before the first measured one start with it.
    """
    own = Window.partitionBy("track").orderBy("idx")
    back, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    w = words.withColumn("chars", F.sum(F.length("text") + 1).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    w = w.withColumn("chars", F.coalesce("chars", F.lit(0)))
    at = F.when(F.col("start_ms").isNotNull(), F.struct("start_ms", "chars"))
    w = w.withColumn("a", F.last(at, True).over(back)).withColumn("b", F.first(at, True).over(ahead))
    share = (F.col("chars") - F.col("a.chars")) / F.greatest(F.col("b.chars") - F.col("a.chars"), F.lit(1))
    mid = F.floor(F.col("a.start_ms") + (F.col("b.start_ms") - F.col("a.start_ms")) * share + 0.5)
    guess = F.coalesce("start_ms", mid, F.col("a.start_ms"), F.col("b.start_ms"), F.lit(0)).cast("long")
    return w.withColumn("g", guess).select("track", "idx", "text", F.max("g").over(back).alias("start_ms"))


def cues(words: DataFrame) -> DataFrame:
    """(track, cue, start_ms, end_ms, text) of words (track, section, idx, text, start_ms, end_ms).

    A cue ends with its section, after a sentence of three or more words, or before it would pass six seconds or 84
    characters. The break depends on what the cue holds, so each track is folded in order.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        open_cue: list | None = None
        for w in frame.sort_values("idx").itertuples(index=False):
            if open_cue and (w.section != open_cue[5] or w.end_ms - open_cue[2] > MOST_MS or len(open_cue[4]) + 1 + len(w.text) > MOST_CHARS or (open_cue[4][-1:] in ".!?" and open_cue[4].count(" ") + 1 >= LEAST_WORDS)):
                out.append(open_cue)
                open_cue = None
            if open_cue is None:
                open_cue = [w.track, len(out), w.start_ms, w.end_ms, w.text, w.section]
            else:
                open_cue[3], open_cue[4] = w.end_ms, f"{open_cue[4]} {w.text}"
        if open_cue:
            out.append(open_cue)
        return pd.DataFrame([c[:5] for c in out], columns=["track", "cue", "start_ms", "end_ms", "text"])

    kind = words.schema["track"].dataType.simpleString()
    return words.where("text is not null and text <> ''").groupBy("track").applyInPandas(fold, f"track {kind}, cue int, start_ms long, end_ms long, text string")


def vtt(cue_rows: DataFrame) -> DataFrame:
    """(track, vtt): one caption file per track."""
    block = F.concat(stamp(F.col("start_ms")), F.lit(" --> "), stamp(F.col("end_ms")), F.lit("\n"), F.col("text"))
    listed = cue_rows.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("cue", block.alias("b")))).alias("bs"))
    return listed.select("track", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("vtt"))


def _ms(text: str) -> int:
    h, m, s, f = STAMP.match(text).groups()
    return ((int(h or 0) * 60 + int(m)) * 60 + int(s)) * 1000 + int(f)


def read_vtt(files: DataFrame) -> DataFrame:
    """(track, cue, start_ms, end_ms, text) of caption files (track, vtt)."""
    kind = files.schema["track"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for track, text in zip(f["track"], f["vtt"], strict=True):
                for block in re.split(r"\n\n+", text.replace("\r\n", "\n")):
                    m = re.search(r"^([\d:.]+) --> ([\d:.]+)[^\n]*\n(.*)", block, re.M | re.S)
                    if m and STAMP.match(m[1]) and STAMP.match(m[2]):
                        rows.append((track, sum(r[0] == track for r in rows), _ms(m[1]), _ms(m[2]), m[3].strip()))
            yield pd.DataFrame(rows, columns=["track", "cue", "start_ms", "end_ms", "text"])

    return files.where("vtt is not null").select("track", "vtt").mapInPandas(run, f"track {kind}, cue int, start_ms long, end_ms long, text string")
