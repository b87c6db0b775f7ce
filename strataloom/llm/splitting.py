"""Cutting oversized texts at natural boundaries (agglomerative merging).

A text starts as atomic segments: its lines, lines over the limit cut at words, words over the limit cut anywhere.
Adjacent segments wait in a heap by the strength of the boundary between them; the weakest boundary is removed first
(among equal ones the pair that makes the shortest segment), as long as the merged segment and the overlap before it
fit the limit. What remains are the pieces.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 6000, 200
ANYWHERE, WORD, LINE, PARAGRAPH, FUNCTION = range(5)
KINDS = ("anywhere", "word", "line", "paragraph", "function")
CLOSER = re.compile(r"[}\])]+[;,]?\s*$")
OPENER = re.compile(r"(?:@|def |class |async def |func |type |function |export |public |abstract |interface |CREATE |#{1,6} )")
WORDS = re.compile(r"\S*\s+|\S+")


def atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """(ends, strengths): where each atomic segment ends and how natural a cut there is."""
    ends: list[int] = []
    strengths: list[int] = []
    lines = text.split("\n")
    at = 0
    for i, line in enumerate(lines):
        stop = min(at + len(line) + 1, len(text))
        if stop - at > most:
            for word in WORDS.finditer(text, at, stop):
                begin = word.start()
                while word.end() - begin > most:
                    begin += most
                    ends.append(begin)
                    strengths.append(ANYWHERE)
                ends.append(word.end())
                strengths.append(WORD)
            if ends and ends[-1] == stop:
                ends.pop()
                strengths.pop()
        if stop == at:
            continue
        following = lines[i + 1] if i + 1 < len(lines) else ""
        blank = not line.strip()
        if OPENER.match(following) and not OPENER.match(line) or CLOSER.match(line):
            strength = FUNCTION
        elif blank and following.strip():
            strength = FUNCTION if OPENER.match(following) else PARAGRAPH
        else:
            strength = LINE
        ends.append(stop)
        strengths.append(strength)
        at = stop
    return ends, strengths


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, own, end, strength): the piece text[start:end] adds text[own:end] to the pieces before it.

    ``start`` is the first boundary at most ``overlap`` characters before ``own`` (a word's begin where there is one),
    ``strength`` that of the cut at ``end``. Joined, text[own:end] of all pieces is the text.
    """
    if len(text) <= limit:
        return [(0, 0, len(text), FUNCTION)] if text else []
    room = limit - overlap
    ends, strengths = atoms(text, room)
    n = len(ends)
    begins = [0, *ends[:-1]]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive, last = [True] * n, list(range(n))
    heap = [(strengths[i], ends[i + 1] - begins[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and ends[last[j]] - begins[i] == size):
            continue
        if size > (room if begins[i] else limit):
            continue
        alive[j] = False
        last[i], after[i] = last[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (strengths[last[i]], ends[last[after[i]]] - begins[i], i, after[i]))
        if before[i] >= 0:
            k = before[i]
            heapq.heappush(heap, (strengths[last[k]], ends[last[i]] - begins[k], k, i))
    out = []
    i = 0
    while i < n:
        own, end = begins[i], ends[last[i]]
        out.append((overlap_start(text, own, overlap), own, end, strengths[last[i]]))
        i = after[i]
    return out


def overlap_start(text: str, own: int, overlap: int) -> int:
    """The first line begin at most ``overlap`` characters back, else the first word begin, else exactly that far."""
    low = max(0, own - overlap)
    if low == 0:
        return 0
    line = text.find("\n", low - 1, own - 1)
    if line >= 0:
        return line + 1
    if text[low - 1].isspace():
        return low
    word = re.compile(r"\s+").search(text, low, own)
    return word.end() if word and word.end() < own else low


def pieces(df: DataFrame, id_column: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of each text longer than ``limit`` characters.

    Columns: id, piece_no (from 0), start_char, own_char, end_char (0-based code points; a piece is
    [start_char, end_char), of which what lies before own_char repeats the piece before), cut (the kind of boundary at
    its end), content. Null, empty and short texts have no pieces; rows without id are left out; repeated rows count
    once. Each text is cut on its own, so a task holds one text at a time.
    """
    kind = df.schema[id_column].dataType.simpleString()
    long = df.where(F.col(id_column).isNotNull() & (F.length(text) > limit)).select(F.col(id_column).alias("id"), F.col(text).alias("content")).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, s, o, e, KINDS[g], t[s:e]) for i, t in zip(frame["id"], frame["content"], strict=True) for k, (s, o, e, g) in enumerate(split(t, limit, overlap))]
            yield pd.DataFrame(rows, columns=["id", "piece_no", "start_char", "own_char", "end_char", "cut", "content"])

    return long.mapInPandas(run, f"id {kind}, piece_no int, start_char int, own_char int, end_char int, cut string, content string")
