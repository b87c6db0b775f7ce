"""Patches, quoted evidence, fuzzy dedupe and literal blanking: character-level state machines over one text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HUNK = re.compile(r"^@@(?: -(\d+)(?:,\d+)? \+\d+(?:,\d+)?)? ?@@?")
DRIFT = 40


def apply_patch(text: str, patch: str) -> tuple[bool, str, str]:
    """(done, result, reason) of a unified diff.

    A hunk is looked for at its line, then up to 40 lines away, nearest first; one without a line number must match in
    exactly one place. Hunks need at least one line of context or removal.
    """
    lines, shift, at_least = text.split("\n"), 0, 0
    hunks: list[tuple[int | None, list[str]]] = []
    for line in patch.split("\n"):
        m = HUNK.match(line)
        if m:
            hunks.append((int(m[1]) if m[1] else None, []))
        elif hunks and line[:1] in (" ", "+", "-"):
            hunks[-1][1].append(line)
        elif hunks and line == "":
            hunks[-1][1].append(" ")
    if not hunks:
        return False, text, "no hunks"
    for where, body in hunks:
        while body and body[-1] == " ":
            body.pop()
        old = [x[1:] for x in body if x[0] in " -"]
        new = [x[1:] for x in body if x[0] in " +"]
        if not old:
            return False, text, "no context"
        fits = [k for k in range(at_least if where is None else 0, len(lines) - len(old) + 1) if lines[k : k + len(old)] == old]
        if where is None:
            if len(fits) != 1:
                return False, text, "ambiguous" if fits else "not found"
            k = fits[0]
        else:
            wanted = where - 1 + shift
            near = [f for f in fits if abs(f - wanted) <= DRIFT]
            if not near:
                return False, text, "not found"
            k = min(near, key=lambda f: (abs(f - wanted), f))
        lines[k : k + len(old)] = new
        shift += len(new) - len(old)
    return True, "\n".join(lines), ""


def patched(df: DataFrame) -> DataFrame:
    """(id, done, result, reason) of rows (id, text, patch); null texts or patches are left out."""
    kind = df.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(i, *apply_patch(t, p)) for i, t, p in zip(f["id"], f["text"], f["patch"], strict=True)], columns=["id", "done", "result", "reason"])

    return df.where("id is not null and text is not null and patch is not null").select("id", "text", "patch").mapInPandas(run, f"id {kind}, done boolean, result string, reason string")


def reanchored(claims: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Claims (claim_id, keys, start_line, quote) with ``line_no``: the nearest line that holds the quote, else null.

    Ties go to the earlier line. Only texts that hold a claim's quote at all become lines.
    """
    both = claims.join(texts, keys).where((F.trim("quote") != "") & F.contains(F.col("content"), F.trim("quote")))
    lines = both.select("claim_id", "start_line", F.trim("quote").alias("q"), F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).where(F.contains(F.col("line"), F.col("q")))
    near = lines.groupBy("claim_id").agg(F.min(F.struct(F.abs(F.col("pos") + 1 - F.col("start_line")).alias("d"), (F.col("pos") + 1).alias("n"))).alias("m"))
    return claims.join(near.select("claim_id", F.col("m.n").alias("line_no")), "claim_id", "left")


CODE = re.compile(r"//[^\n]*|(?:(?<=[ \t\n])|\A)#[^\n]*|/\*(?:.|\n)*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|[`{}]")
TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)


def blank_literals(text: str) -> str:
    """The text with the insides of strings, templates and comments replaced by spaces; line breaks stay.

    Template state is carried over lines; code inside ``${}`` stays.
    """
    out: list[str] = []
    hide = lambda part: re.sub(r"[^\n]", " ", part)
    at, n, stack = 0, len(text), []
    while at < n:
        inside = bool(stack) and stack[-1] == "`"
        m = (TEMPLATE if inside else CODE).search(text, at)
        end = m.start() if m else n
        out.append(hide(text[at:end]) if inside else text[at:end])
        if not m:
            break
        token, at = m[0], m.end()
        if token == "`":
            stack.pop() if inside else stack.append("`")
        elif token == "${":
            stack.append("{")
        elif token in "{}" and not inside:
            if stack:
                stack.append("{") if token == "{" else stack.pop()
        elif token[0] in "\"'" and not inside:
            closed = len(token) > 1 and token[-1] == token[0]
            token = token[0] + hide(token[1 : len(token) - closed]) + token[0] * closed
        else:
            token = hide(token)
        out.append(token)
    return "".join(out)


def call_arguments(text: str, opening: int, most: int = 12_000) -> list[str]:
    """The arguments of the call whose parenthesis opens at ``opening``; nested brackets and strings stay whole."""
    out, depth, begin, at = [], 0, opening + 1, opening
    while at < min(len(text), opening + most):
        c = text[at]
        if c in "\"'`":
            at += 1
            while at < len(text) and text[at] != c:
                at += 2 if text[at] == "\\" else 1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                last = text[begin:at].strip()
                return [*out, last] if last or out else out
        elif c == "," and depth == 1:
            out.append(text[begin:at].strip())
            begin = at + 1
        at += 1
    return []


def title_words(title: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]{3,}", title.lower()))


def keep_first(rows: list[tuple[str, str, int, int, int]], similar: float = 0.4, near: int = 5) -> list[str]:
    """Ids that stay of (id, title, start, end, rank) of one file: a later one that overlaps and reads alike goes."""
    kept: list[tuple[str, set[str], int, int]] = []
    for i, title, start, end, _ in sorted(rows, key=lambda r: (r[4], r[2], r[0])):
        w = title_words(title)
        if not any(start <= b + near and end >= a - near and (w == v or len(w & v) >= similar * max(1, len(w | v))) for _, v, a, b in kept):
            kept.append((i, w, start, end))
    return [k[0] for k in kept]


def deduped(findings: DataFrame, keys: list[str]) -> DataFrame:
    """The ids that stay of findings (id, keys, title, start_line, end_line, rank).

    The rule is greedy in rank, line and id. It can only reach from finding to finding within five lines, so the fold
    runs over each island of such findings, not over a file; findings without lines stay.
    """
    f = findings.where("title is not null and start_line is not null and end_line is not null").dropDuplicates(["id"])
    own = Window.partitionBy(*keys).orderBy("start_line", "id")
    f = f.withColumn("_far", F.max("end_line").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    f = f.withColumn("_island", F.sum(F.when(F.col("start_line") <= F.col("_far") + 5, 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": keep_first(list(frame[["id", "title", "start_line", "end_line", "rank"]].itertuples(index=False, name=None)))})

    return f.groupBy(*keys, "_island").applyInPandas(fold, "id string").unionByName(findings.where("title is null or start_line is null or end_line is null").select("id").distinct())
