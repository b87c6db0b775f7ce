"""Sentence boundaries across languages and scripts (a maximum-entropy classifier over candidate boundaries).

Blocks first: fenced code, heading lines and list lines are one unit each, blank lines end what stands before them.
In running text every cluster of end marks is a candidate. Marks inside quotations and parentheses end nothing, those
of scripts whose full stop is unambiguous always end, white space ends a Thai sentence; all others are classified by
the tokens on both sides, their case, length, digits and script, and the white space between.

The classifier is trained on reliable boundaries of a bounded sample: an end mark before a blank line and another
paragraph is one; a mark directly before a lower-case letter, digit or further punctuation, before a lower-case word,
or after a title is none. A single mark after a long word and before a lower-case word, which careful writing doesn't
have, is left unlabelled and taken for the end of a sentence in text without capitals.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import written

FEATURES = 1 << 15
#: About how many texts the training sample has (those of the smallest hashes).
TRAINING_TEXTS = 4000
#: Labelled marks that the classifier is trained on at most.
TRAINING_MARKS = 200_000
#: Repeated ids that are broadcast at most.
BROADCAST_IDS = 1_000_000
#: Abbreviations that stand before a name or number and never end a sentence: labels for training, not a rule.
TITLES = ("dr", "mr", "mrs", "ms", "prof", "st", "nr", "no", "art", "fig", "sec", "vs", "cf", "z", "b", "d", "h", "p", "e.g", "i.e", "pág", "डॉ", "jan", "feb", "aug", "sept", "oct", "nov", "dec", "bzw", "ca", "approx", "aprox", "env", "sr", "sra", "mme", "vgl", "s", "u", "n", "vol", "ch")
#: Month names after a day's number, also labels for training.
MONTHS = ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember", "january", "february", "march", "may", "june", "july", "october", "december")
FULL_STOPS = "。！？｡।॥"
MARKS = re.compile(r"[.!?…。！？｡।॥]+")
LINES = re.compile(r"[^\n]*\n|[^\n]+")
BLANK = re.compile(r"[^\S\n]*\n?\Z")
FENCE = re.compile(r"[^\S\n]*(```|~~~)")
HEADING = re.compile(r"[^\S\n]*(?=#{1,6}(?:\s|$))")
LIST = re.compile(r"[^\S\n]*(?=[-*+•]\s)")
NUMBERED = re.compile(r"[^\S\n]*(?=\d{1,3}[.)]\s)")
THAI = re.compile(r"[ก-๛]")
SPACE = re.compile(r"\s+")
CASELESS = re.compile(r"[ऀ-෿฀-๿぀-ヿ㐀-鿿가-힯]")
LEFT = re.compile(r"[^\s`\"“”«»„()（）「」『』*]+\Z")
#: A sentence that begins right after the end mark of the one before, as in "it.Mr".
GLUED = re.compile(r"\w{3}[.!?]([^\W\d_a-z]\w*)\Z")
RIGHT = re.compile(r"[^\s`\"“”«»„()（）「」『』*]+")
OPENERS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》"}
BRACKETS = re.compile(r"[“”„«»‹›「」『』()（）\[\]【】《》\"]")


def blocks(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end) with kind fence, line or text; a text block reaches over single line breaks."""
    at, begin, fence, open_line = 0, -1, "", False
    fence_at = 0
    for line in LINES.findall(text):
        stop = at + len(line)
        if fence:
            if line.strip().startswith(fence):
                yield "fence", fence_at, stop
                fence = ""
        else:
            mark = None
            opening = FENCE.match(line)
            if opening:
                fence, fence_at = opening[1], at + opening.start(1)
            else:
                mark = HEADING.match(line) or LIST.match(line) or (None if open_line else NUMBERED.match(line))
            blank = not opening and not mark and BLANK.match(line)
            if opening or mark or blank:
                if begin >= 0:
                    yield "text", begin, at
                    begin = -1
                if mark:
                    yield "line", at + mark.end(), stop
            elif begin < 0:
                begin = at
            open_line = begin >= 0
        at = stop
    if fence:
        yield "fence", fence_at, at
    elif begin >= 0:
        yield "text", begin, at


def spans(text: str) -> list[tuple[int, int, str]]:
    """(open, after the close, opener) of the outermost quotations and parentheses that are closed."""
    out: list[tuple[int, int, str]] = []
    stack: list[tuple[int, str]] = []
    for m in BRACKETS.finditer(text):
        c, at = m[0], m.start()
        if stack and (c in OPENERS.get(stack[-1][1], "") or c == '"' == stack[-1][1]):
            begin, opener = stack.pop()
            out.append((begin, at + 1, opener))
        elif c in OPENERS:
            stack.append((at, c))
        elif c == '"':
            if any(o == '"' for _, o in stack):
                while stack[-1][1] != '"':
                    stack.pop()
                out.append((stack.pop()[0], at + 1, c))
            else:
                stack.append((at, c))
        elif any(c in OPENERS.get(o, "") for _, o in stack):
            while c not in OPENERS.get(stack[-1][1], ""):
                stack.pop()
            begin, opener = stack.pop()
            out.append((begin, at + 1, opener))
    out.sort()
    outer: list[tuple[int, int, str]] = []
    for s in out:
        if not outer or s[0] >= outer[-1][1]:
            outer.append(s)
    return outer


def shape(token: str) -> str:
    """Case, digits and script of a token, repeated classes once."""
    out = ""
    for c in token[:24]:
        k = "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "c" if c.isalpha() else c if c in "._/-%'" else "o"
        if not out.endswith(k):
            out += k
    return out[:6]


def right_kind(text: str, at: int) -> str:
    """What begins at ``at``: a plain lower-case word, an identifier, upper case, a digit and so on."""
    if at >= len(text):
        return "end"
    c = text[at]
    if c.isdigit():
        return "digit"
    if c == "`":
        return "code"
    if c.isalpha():
        token = RIGHT.match(text, at)
        word = token[0].rstrip(".,;:!?…") if token else c
        if CASELESS.match(c):
            return "caseless"
        if "_" in word or "/" in word or any(x.isupper() for x in word[1:]):
            return "name" if c.islower() else "Name"
        return "lower" if c.islower() else "upper"
    if c in OPENERS or c in "\"'¿¡":
        return "open"
    return "dash" if c in "-–—" else "punct" if c in ",;:)]}%/\\=*<>|&+" else "other"


def features(text: str, begin: int, end: int, right: int) -> tuple[list[str], str, str]:
    """The features of the mark text[begin:end] before what begins at ``right``; also the left token and right kind."""
    mark = text[begin:end]
    kind = mark if len(mark) == 1 else "dots" if set(mark) <= {".", "…"} else "mixed"
    if mark == "…":
        kind = "dots"
    left = LEFT.search(text, max(0, begin - 30), begin)
    word = left[0] if left else ""
    glued = GLUED.search(word)
    word = glued[1] if glued else word
    token = word.lower()
    ls = shape(word) if word else "none"
    gap = text[end:right]
    ws = "none" if not gap else "line" if "\n" in gap else "space"
    rk = right_kind(text, right)
    if rk == "lower" and mark in (".", "!", "?") and gap and len(token) > 4 and token not in TITLES:
        rk = "small"
    rt = RIGHT.match(text, right)
    follows = rt[0].lower() if rt and len(rt[0]) <= 6 else ""
    size = str(min(len(token), 6))
    known = token if len(token) <= 7 else ""
    dated = len(token) < 3 and token.isdigit() and rt is not None and rt[0].lower() in MONTHS
    return [f"special={'title' if token in TITLES and kind == '.' else 'day' if dated else ''}", f"m={kind}", f"lt={known}", f"ls={ls}", f"ll={size}", f"ws={ws}", f"rk={rk}", f"rt={follows}", f"m,rk={kind},{rk}", f"ls,rk={ls},{rk}", f"lt,rk={known},{rk}", f"m,ws,rk={kind},{ws},{rk}", f"ll,ls={size},{ls}"], token, rk


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode()) & (FEATURES - 1) for n in names]


def labelled(text: str) -> Iterator[tuple[list[int], int]]:
    """(features, 1 or 0) of the candidates of a text whose label is certain."""
    parts = list(blocks(text))
    for k, (kind, begin, end) in enumerate(parts):
        if kind != "text":
            continue
        body = text[begin:end]
        last = len(body.rstrip())
        inner = spans(body)
        for m in MARKS.finditer(body):
            if m[0][0] in FULL_STOPS or any(a < m.start() < b for a, b, _ in inner):
                continue
            if m.end() == last:
                if k + 1 < len(parts) and parts[k + 1][0] == "text":
                    following = text[parts[k + 1][1] : parts[k + 1][1] + 40].lstrip()
                    names, token, rk = features(body[: m.end()] + " " + following, m.start(), m.end(), m.end() + 1)
                    if rk in ("upper", "name", "Name", "open", "code") and len(m[0]) == 1:
                        yield hashed(names), 1
                continue
            right = SPACE.match(body, m.end())
            right = right.end() if right else m.end()
            names, token, rk = features(body, m.start(), m.end(), right)
            dated = names[0] == "special=day"
            if rk in ("lower", "digit", "punct", "dash", "caseless") or (right == m.end() and rk == "name") or (m[0] == "." and (dated or token in TITLES)):
                yield hashed(names), 0
            elif right == m.end() and rk == "upper" and len(token) > 2 and m[0] in ".!?" and body[right + 1 : right + 2].islower():
                yield hashed(names), 1


def seeds() -> list[tuple[list[int], int]]:
    """Labelled examples of titles before a name and days before a month, so that a small sample has them too."""
    width = len(features("a. B", 1, 2, 3)[0])
    return [(hashed([f"special={s}", *["-"] * (width - 1)]), 0) for s in ("title", "day") for _ in range(100)]


def train(examples: list[tuple[list[int], int]], rounds: int = 200, l2: float = 1e-4) -> np.ndarray:
    """Weights of the maximum-entropy (logistic) model; both classes weigh the same."""
    if not examples:
        return np.zeros(FEATURES)
    x = np.array([e[0] for e in examples])
    y = np.array([e[1] for e in examples], dtype=float)
    share = y.mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    w, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        error = weight * (1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30))) - y)
        gradient = np.bincount(x.ravel(), np.repeat(error, x.shape[1]), FEATURES) / len(y) + l2 * w
        squares += gradient**2
        w -= 0.3 * gradient / np.sqrt(squares)
    return w


def after_close(opener: str, wholly: bool, mark: str, following: str, spaced: bool) -> bool:
    """Whether a sentence ends with a quotation or parenthesis whose last character is an end mark.

    ``wholly``: it opened where the sentence begins; ``following``: what comes after it, ``spaced``: after white space.
    """
    if opener in "(（[【":
        return wholly
    if following == "lower":
        return False
    if following == "caseless":
        return wholly and spaced and mark in FULL_STOPS
    if not spaced:
        return wholly and following in ("upper", "open")
    if following in ("name", "code", "digit"):
        return wholly and mark == "."
    return following in ("upper", "Name", "open")


@dataclass
class Splitter:
    """Cuts texts with trained weights."""

    weights: list[float]
    known: dict[str, float] = field(default_factory=dict)

    def ends(self, text: str, begin: int, end: int, right: int) -> bool:
        if right == end and (text[end].islower() or text[end].isdigit()):
            return False  # what the labels are certain of needs no classifier
        names, _, kind = features(text, begin, end, right)
        if kind == "small":
            return True
        known, total = self.known, 0.0
        for n in names:
            w = known.get(n)
            if w is None:
                if len(known) > 200_000:
                    known.clear()
                w = known[n] = self.weights[zlib.crc32(n.encode()) & (FEATURES - 1)]
            total += w
        return total > 0

    def paragraph(self, body: str) -> list[int]:
        """The beginnings of the sentences of one text block."""
        stop = len(body.rstrip())
        start = len(body) - len(body.lstrip())
        if start >= stop:
            return []
        out = [start]
        inner = spans(body) if BRACKETS.search(body) else []
        events = [(m.start(), m.end(), m[0], -1) for m in MARKS.finditer(body, start, stop)]
        if THAI.search(body):
            events += [(m.start(), m.end(), " ", -1) for m in SPACE.finditer(body, start, stop)]
        for a, b, opener in inner:
            if MARKS.match(body[b - 2]) and b - 2 > a:
                events.append((b - 1, b, opener, a))
        events.sort()
        at = 0
        for begin, end, what, opened in events:
            while at < len(inner) and inner[at][1] <= begin:
                at += 1
            inside = at < len(inner) and inner[at][0] < begin < inner[at][1] - 1
            if inside or end >= stop:
                continue
            gap = SPACE.match(body, end)
            right = gap.end() if gap else end
            if right >= stop or body[right] in ",;、，；：:":
                continue
            if what == " ":
                cut, right = THAI.search(body, out[-1], begin) is not None, end
            elif opened >= 0:
                cut = after_close(what, opened == out[-1], body[begin - 1], right_kind(body, right), right > end)
            elif what[0] in FULL_STOPS or what[-1] in FULL_STOPS:
                cut = body[right] not in "）」』”》)"
            elif body[end : end + 1] in ("”", "»", "」", "』", "）"):
                cut = False
            else:
                cut = self.ends(body, begin, end, right)
            if cut and right > out[-1]:
                out.append(right)
        return out

    def starts(self, text: str) -> list[int]:
        """The 0-based offsets at which the units of a text begin."""
        out: list[int] = []
        for kind, begin, end in blocks(text):
            out += [begin] if kind != "text" else [begin + x for x in self.paragraph(text[begin:end])]
        return out


def fit(df: DataFrame, text: str, texts: int = TRAINING_TEXTS, marks: int = TRAINING_MARKS) -> Splitter:
    """Train on the labelled marks of about ``texts`` different texts, those of the smallest hashes.

    At most ``marks`` of these examples (a few numbers each) reach the driver, again those of the smallest hashes.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    below = int(min(1.0, texts / max(rows.count(), 1)) * 2.0**64) - 2**63
    sample = rows.where(F.col("h") <= min(below, 2**63 - 1)).dropDuplicates(["h"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [(zlib.crc32(f"{h} {k}".encode()), x, y) for h, t in zip(frame["h"], frame["t"], strict=True) for k, (x, y) in enumerate(labelled(t))]
            yield pd.DataFrame(made, columns=["o", "x", "y"])

    examples = sample.mapInPandas(run, "o long, x array<int>, y int").orderBy("o", "x").limit(marks).toPandas()
    return Splitter(train([*seeds(), *((list(x), y) for x, y in zip(examples["x"], examples["y"], strict=True))]).tolist())


def sentences(df: DataFrame, id_column: str, text: str, splitter: Splitter | None = None) -> DataFrame:
    """The units of each text in order: id, sentence_no (from 0), start_char (0-based code points), sentence.

    A sentence reaches to the next one's beginning, less the white space there. Null, empty and blank texts have none;
    rows without id are left out; repeated rows count once.
    """
    splitter = splitter or fit(df, text)
    kind = df.schema[id_column].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, numbers, begins, parts = [], [], [], []
            for i, t in zip(frame["id"], frame["t"], strict=True):
                at = splitter.starts(t)
                ids += [i] * len(at)
                numbers += range(len(at))
                begins += at
                parts += [t[a:b].rstrip() for a, b in zip(at, [*at[1:], len(t)], strict=False)]
            yield pd.DataFrame({"id": pd.Series(ids, dtype=frame["id"].dtype), "sentence_no": pd.Series(numbers, dtype="int32"), "start_char": pd.Series(begins, dtype="int32"), "sentence": pd.Series(parts, dtype=object)})

    rows = df.where(F.col(id_column).isNotNull() & F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.col(text).alias("t"))
    again = written(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    many = again.count()
    again = F.broadcast(again) if many <= BROADCAST_IDS else again  # few repeated ids spare the texts a shuffle
    once = rows.join(again, "id", "left_anti").unionByName(rows.join(again, "id", "left_semi").distinct()) if many else rows
    return once.mapInPandas(run, f"id {kind}, sentence_no int, start_char int, sentence string")
