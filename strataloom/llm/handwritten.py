"""Source files that nobody wrote by hand: generated, minified, third-party copies, data in the form of code.

A random forest learns how such contents look. Its features are taken from the text without its head: compression
ratio, entropy of the tokens, length of the identifiers, density of comments, share of long lines and of literal data,
and size (ratios of a few characters say little). Its labels come from what the features don't see: notices in the head comment, the names that tools give their files,
and examples made from the collection's own contents by minifying them or writing them as literal data. Labels are
incomplete (most minified files carry no notice), so the forest's probability is a share of the true one; that share is
the mean probability of held-out labelled contents, and a content is taken from CUT times it. Notices, banners and paths also count by themselves, since generated and third-party
code in ordinary lines looks like any other.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import written

LANGUAGES = ("TypeScript", "JavaScript", "Python", "Go")
#: Contents (those of the smallest hashes) that the forest is trained on.
TRAINING_ROWS = 20_000
CUT = 0.5
#: One in so many of the training contents is held out to measure the share of labelled contents.
HELD_OUT = 5
#: One in so many of the training contents also gives a made example.
MADE = 4
#: Characters or bytes that an example is made from at least; shorter texts are repeated.
LEAST_MADE = 2000
FEATURES = ["compression", "entropy", "identifier", "comments", "long_lines", "data", "size"]

# Wording of notices and names that tools and package managers give.
NOTICE = re.compile(
    r"code generated\b|do not edit(?! them)|do not modify by hand|auto-?generated|automatically generated|@generated\b|machine[- ](?:written|generated)|generated (?:from|by|with) \S+ on|generated by \S+ (?:from|version|v?\d)"
    r"|edits are overwritten|changes will be lost|automatisch (?:erzeugt|generiert)|nicht von hand|généré automatiquement|ne pas modifier|generado automáticamente|no (?:editar|modificar) a mano|自动生成|自動生成",
    re.I,
)
BANNER = re.compile(r"@license\s+\S+@\d|upstream copy|\bv?\d+\.\d+\.\d+ \| \(c\)|/\*!.*\(c\) ?\d{4}|\bvendored from\b", re.I)
VENDOR_PATH = r"(^|/)(vendor|third[_-]?party|3rd[_-]?party|node_modules|bower_components|external|jspm_packages|site-packages|Godeps)/|(^|/)deps/[^/]+-\d"
TOOL_PATH = r"(^|/)(generated|__generated__)/|\.(min|chunk|bundle|generated|gen|pb|g)\.[a-z]+$|_pb2(_grpc)?\.pyi?$|(^|/)zz_generated|_generated\.go$"

#: Characters from which a line counts as long, and as code unless it is a comment.
LONG = 200
COMMENT = re.compile(r"\s*(?://|#|/\*|\*|\"\"\"|'''|<!--)")
PREAMBLE = re.compile(r"\s*$|package |import\b|from |\s+[\"'(]|\s*\w* *\"[\w./@-]+\"$|[)}]|(?:const|var|let) .*\brequire\(|[\"']use strict|export \* from")
TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]")
NUMBERS = re.compile(r"(?:-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*[,;]\s*){8,}")
ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{80,}|(?:\\x[0-9a-fA-F]{2}){20,}")
LINE_COMMENT = re.compile(r"^[^\S\n]*(?://|#|/?\*).*$", re.M)


def head_of(text: str) -> tuple[str, int]:
    """(the comments above the first code, where the head ends); imports and package lines are no code."""
    comments, at, inside = [], 0, ""
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if inside:
            comments.append(line)
            if inside in line:
                inside = ""
        elif COMMENT.match(line):
            comments.append(line)
            mark = line.lstrip()
            for opener, closer in (("/*", "*/"), ('"""', '"""'), ("'''", "'''")):
                if mark.startswith(opener):
                    close = mark.find(closer, len(opener))
                    inside = closer if close < 0 else ""
                    if close >= 0 and len(mark) > close + LONG:  # a banner and the code in one line
                        comments[-1] = mark[: close + len(closer)]
                        return "\n".join(comments), at + len(line) - len(mark) + close + len(closer)
        elif len(line) > LONG or not PREAMBLE.match(line):
            break
        at = end + 1
    return "\n".join(comments), min(at, len(text))


def measures(text: str) -> tuple[bool, bool, float, float, float, float, float, float, float]:
    """(notice, banner, then FEATURES of what stands below the head)."""
    head, end = head_of(text)
    body = text[end:] or text
    raw = body.encode("utf-8", "surrogatepass")
    tokens = Counter(TOKEN.findall(body))
    n = sum(tokens.values()) or 1
    entropy = -sum(c / n * math.log2(c / n) for c in tokens.values())
    names = [(len(t), c) for t, c in tokens.items() if t[0].isalpha() or t[0] in "_$"]
    size = max(len(body), 1)
    return (
        bool(NOTICE.search(head)),
        bool(BANNER.search(head)),
        len(zlib.compress(raw, 1)) / max(len(raw), 1),
        entropy / math.log2(n + 1),
        sum(k * c for k, c in names) / max(sum(c for _, c in names), 1),
        sum(map(len, LINE_COMMENT.findall(body))) / size,
        sum(len(x) for x in body.split("\n") if len(x) > LONG) / size,
        (sum(map(len, (m[0] for m in NUMBERS.finditer(body)))) + sum(map(len, (m[0] for m in ENCODED.finditer(body))))) / size,
        math.log2(size),
    )


def content_measures(blobs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, notice, banner, FEATURES) of each content; null and empty texts have none."""
    kind = blobs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *measures(t)) for k, t in zip(frame["k"], frame["t"], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "notice", "banner", *FEATURES])

    rows = blobs.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"{key} {kind}, notice boolean, banner boolean, " + ", ".join(f"{f} double" for f in FEATURES))


def made_example(text: str, kind: int) -> str:
    """The text minified (kinds 0 and 1), or an array of numbers or an encoded literal of its size, in one line or wrapped."""
    form, width, size = kind % 4, (0, 80, 120, 500)[kind // 4 % 4], max(LEAST_MADE, len(text)) * (1, 2, 4)[kind // 16 % 3]
    words = re.findall(r"[A-Za-z_]\w{3,}", text)[:3]
    name = ("_".join(words).upper() if kind // 48 % 2 else "".join(w.title() for w in words)) or "DATA"
    if form < 2:
        text *= -(-LEAST_MADE // len(text))
        names: dict[str, str] = {}
        long_names = form == 1
        short = lambda m: names.setdefault(m[0], chr(97 + len(names) % 26) + (str(len(names) * 37) if long_names else str(len(names) // 26) if len(names) >= 26 else ""))
        bare = re.sub(r"(?<![\w.$])[A-Za-z_$][\w$]{3,}(?![\w$]*\s*:)", short, LINE_COMMENT.sub("", text))
        out = re.sub(r"\s*([^\w\s])\s*", r"\1", re.sub(r"\s+", " ", re.sub(r"\s*\n\s*", ";", bare.strip())))
        width = width if width > 80 else 0
        return "\n".join(out[i : i + width] for i in range(0, len(out), width)) if width else out
    raw = hashlib.shake_128(text.encode("utf-8", "surrogatepass")).digest(size)
    if form == 3:
        out = base64.b64encode(raw).decode()
        return f'{name} = "{out}"' if not width else f"{name} = (\n" + "\n".join(f'"{out[i : i + width]}"' for i in range(0, len(out), width)) + "\n)"
    numbers = [f"0x{x:02x}" for x in raw] if kind // 96 % 2 else [str(x % 110_000 - 10_000) for x in memoryview(raw[: size // 4 * 4]).cast("I")]
    row = max(8, width // 10)
    return f"{name} = [\n" + "\n".join("    " + ", ".join(numbers[i : i + row]) + "," for i in range(0, len(numbers), row)) + "\n]"


def made_measures(blobs: DataFrame, key: str, text: str) -> DataFrame:
    """FEATURES of an example made from each content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [measures(made_example(t, zlib.crc32(str(k).encode())))[2:] for k, t in zip(frame["k"], frame["t"], strict=True)]
            yield pd.DataFrame(rows, columns=FEATURES)

    rows = blobs.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()
    return rows.mapInPandas(run, ", ".join(f"{f} double" for f in FEATURES))


def machine_written(files: DataFrame, blobs: DataFrame, languages: tuple[str, ...] = LANGUAGES, training_rows: int = TRAINING_ROWS, cut: float = CUT) -> DataFrame:
    """Each file of the languages that is not hand-written, with the evidence.

    ``files`` has id, path, language, hash; ``blobs`` hash, content. Columns: id, path_evidence (vendor, tool or null),
    notice, banner, looks (the forest's finding), probability. Files without content are judged by path; rows without
    id or language are left out, repeated rows count once.
    """
    own = files.where(F.col("id").isNotNull() & F.col("language").isin(*languages)).select("id", F.coalesce("path", F.lit("")).alias("path"), "hash").distinct()
    own = own.withColumn("path_evidence", F.when(F.col("path").rlike(VENDOR_PATH), "vendor").when(F.col("path").rlike(TOOL_PATH), "tool"))
    named = own.where("hash is not null").groupBy("hash").agg(F.max((F.col("path_evidence") == "tool").cast("int")).alias("named")).na.fill(0, ["named"])
    measured = written(content_measures(blobs, "hash", "content"))
    labelled = measured.join(named, "hash").withColumn("label", (F.col("notice") | (F.col("named") == 1)).cast("double"))
    sample = written(labelled.orderBy(F.xxhash64("hash"), "hash").limit(training_rows).select("hash", "label", *FEATURES))
    some = F.broadcast(sample.where(F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(MADE)) == 0).select("hash"))  # about training_rows / MADE keys
    made = made_measures(blobs.join(some, "hash", "left_semi"), "hash", "content").withColumn("label", F.lit(1.0))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    training = written(gather.transform(sample.select("label", *FEATURES).unionByName(made)).withColumn("held", F.pmod(F.xxhash64(*FEATURES), F.lit(HELD_OUT)) == 0).select("label", "features", "held"))
    if training.where("not held").select("label").distinct().count() == 2:
        least = max(5, training.count() // 500)  # leaves of fewer contents would single out what merely lacks a label
        forest = RandomForestClassifier(numTrees=50, maxDepth=6, seed=7, minInstancesPerNode=least, labelCol="label", featuresCol="features").fit(training.where("not held"))
        probability = vector_to_array("probability")[1]
        share = forest.transform(training.where("held and label = 1")).agg(F.avg(probability)).first()[0] or 1.0
        judged = forest.transform(gather.transform(measured)).withColumn("p", probability)
    else:
        share, judged = 1.0, measured.withColumn("p", F.lit(0.0))
    judged = judged.select("hash", "notice", "banner", (F.col("p") >= cut * share).alias("looks"), F.col("p").alias("probability"))
    out = own.join(judged, "hash", "left").select("id", "path_evidence", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("notice", "banner", "looks")], "probability")
    return out.where("path_evidence is not null or notice or banner or looks")
