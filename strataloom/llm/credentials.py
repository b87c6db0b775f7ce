"""Credentials in source, configuration, key and documentation files.

Pass one indexes the corpus's literals by hash, whatever stands around them, with their owners, and the evidence at
their places: provider formats, names of secrets, addresses and headers, private keys, secret manifests. Owners are
counted as groups of near-copies; a literal with evidence that more of them hold than a share of the corpus is a
placeholder and suppressed, rare structured ones are confirmed. Pass two finds the confirmed values wherever they
stand: a value can only stand in a text that has its longest run of letters and digits, so runs are equi-joined and an
Aho-Corasick automaton then reads the texts that are left. Values without such a run (words in addresses, digits only)
are searched for in every text, block by block.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import written

#: A value held by more groups of near-copies than this, and than this share of all contents, is a placeholder.
MOST_OWNERS = 8
MOST_SHARE = 0.0003
#: Kinds that many owners alone don't suppress, and the bits per character below which a value is repetitive.
CERTAIN = ("private key", "provider")
DULL = 2.5
#: Confirmed values without a run to join on per automaton.
BLOCK = 50_000
#: Values shorter than this are searched for between token boundaries, and only if they don't look like a word.
SEARCHED = 12
#: Characters of a value in the automaton; the rest is compared in the text.
HEAD = 64

# Public formats of credentials.
PROVIDER = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}|sk-[A-Za-z0-9_-]{24,}|[sr]k_live_[A-Za-z0-9]{16,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{16,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}|AIza[\w-]{35}|glpat-[\w-]{20,}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{20,}\.[\w-]{20,}|ya29\.[\w-]{20,}|hooks\.slack\.com/services/[A-Z0-9]{6,}/[A-Z0-9]{6,}/\w{16,})"
)
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'`<>]*:([^\s@\"'`/]{4,})@")
PARAMETER = re.compile(r"[?&](?:access_token|auth_token|api_?key|token|sig|signature|key|secret|client_secret|password|pwd|auth)=([\w%+/=~.-]{12,})", re.I)
SCHEME = re.compile(r"\b(?:Bearer|Basic)\s+([A-Za-z0-9+/=_.~-]{12,})", re.I)
NAME = re.compile(
    r"(?:pass(?:w(?:or)?d|phrase|code)|(?<![a-z])passw?(?![a-z])|smtp_?pass|(?<![a-zA-Z])pwd|_?(?<=[a-z_])pwd|(?:admin|db|root|user)_?pw|(?<![a-z])pw(?![a-z])|secret|api_?-?key|(?:sign(?:ing|ature)?|encrypt(?:ion)?|private|master|account|access|session|hmac|shared|storage|service)_?-?key"
    r"|(?:access|auth|api|ci|bot|deploy|refresh|session|service|id|bearer|push)_?-?token|auth(?:orization|_?-?header)|credential|conn(?:ection)?_?str(?:ing)?|private_?key)",
    re.I,
)
#: Names that hold a fact about a secret, not the secret.
ABOUT = re.compile(r"[_.-]?(?:hint|field|name|label|policy|length|len|min|max|file|path|url|prompt|reset|expir|ttl|rotat|type|column|count|size|strength|digest|hash|checksum|fingerprint|public|id(?![a-z]))", re.I)
ABOUT_BEFORE = re.compile(r"(?:public|digest|hash|checksum|fingerprint)[_.-]?\Z", re.I)
REST = re.compile(r"[\w.-]*")
#: A word and number that only tell variables apart, as in passwordReport12.
SUFFIX = re.compile(r"[A-Z][a-z]+\d+\Z")
GAP = re.compile(r"[\"'`\])}*]*\s*(?:(?::=|=>|->|==?|:|\(|,|\bto\b|\bis\b|\bas\b)\s*|\s)[\"'`(\[{*|>\s]*(?:[bruf]{1,2}[\"'])?")
TRIGGER = re.compile(r"(?i:pass|pwd|_?pw(?![a-z])|admin_?pw|secret|[_-]?key|token|auth|credential|conn|bearer|basic |pw\b|[?&]sig)|://|AKIA|ASIA|gh[pousr]_|github_pat|sk-|k_live|xox|eyJ|AIza|glpat|npm_|SG\.|ya29|slack|PRIVATE KEY|\" *\+ *\"|' *\+ *'")
PLUS = re.compile(r"([\"'`])\s*\+\s*\n?\s*\1")
LITERAL = re.compile(r"[^\s\"'`,;<>{}\[\]\\]{8,}")
BEGIN_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_BODY = re.compile(r"(?:\s|\\n|\\r|[\"'`+,#*/]|Proc-Type[^\n]*\n|DEK-Info[^\n]*\n|Version:[^\n]*\n)*((?:[A-Za-z0-9+/=]{16,}(?:\s|\\n|\\r|[\"'`+,#*/])*)+)")
SECRET_MANIFEST = re.compile(r"^kind:\s*[\"']?Secret\b", re.M)
ENCODED = re.compile(r"^\s+([\w.-]+):\s*[\"']?([A-Za-z0-9+/]{8,}={0,2})[\"']?\s*(?:#.*)?$", re.M)
#: Wording of samples; a fact about the value that the confirmation weighs.
WORDING = re.compile(
    r"(?:^|[^a-z])(?:your|change|replace|example|sample|dummy|placeholder|redacted|insert|todo|fixme|none|null|undefined|my[-_]|test[-_]?(?:key|secret|password)|fake|secret[-_]?here|foo|bar)(?:[^a-z]|me|$)|x{4,}|\*{3,}|\.{3,}|(.)\1{5,}",
    re.I,
)
#: References to where the value is kept.
REFERENCE = re.compile(r"[<>]|\$\{|\$\(|\{\{|%\(|^\$[A-Za-z_]|^%[A-Z_]+%$|^env[.:(]|process\.env|environ|getenv|os\.", re.I)
#: Literals of the index, and runs that searches join on; escapes end a run.
WORD = re.compile(r"[^\s\"'`,;<>{}\[\]\\()=:&?|]{8,}")
RUN = re.compile(r"\\[nrtbf0]|(?:[A-Za-z]+[0-9]|[0-9]+[A-Za-z])[A-Za-z0-9]*")
LEAST_RUN = 4
PATHLIKE = re.compile(r"(?:[\w@.-]+/)+[\w.-]*\.[a-z]{1,5}$|^(?:[a-z_-]+/)+[a-zA-Z_.-]+$|://|^[\w.-]+\.(?:py|js|ts|tsx|go|json|ya?ml|md|invalid|com|org|net|io)\b")
IDENTIFIER = re.compile(r"[A-Za-z_$][a-zA-Z_$.]*\d{0,3}(?:\(.*|:|\)+)?$")
TOKEN = re.compile(r"\w")
#: What stands before a body that is meant to be public.
PUBLISHED = re.compile(r"-----BEGIN [A-Z0-9 ]*(?:PUBLIC KEY|CERTIFICATE)[A-Z ]*-----\s*\Z")
CALL = re.compile(r"[A-Za-z_$][\w$.]*\(")


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def plausible(value: str) -> bool:
    """Whether a value beside a secret's name looks like one rather than like a word, path or reference."""
    value = value.rstrip(".:)")
    if len(value) < 8 or value[0] == "@" or REFERENCE.search(value) or IDENTIFIER.match(value) or CALL.match(value) or PATHLIKE.search(value):
        return False
    lower, upper, digit = any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value)
    if len(value) < 30 and re.search(r"[\w$]\.[a-z]+[*+/-]\d", value):
        return False
    special = any(not c.isalnum() and c not in "_-./" for c in value)
    if re.fullmatch(r"[0-9a-fA-F]+", value):
        return len(value) >= 16 and digit and (lower or upper) and entropy(value) > 2.5
    if re.fullmatch(r"[\d.,:_/-]+", value):
        return False
    if len(value) >= 20:
        return digit and (upper or lower) and (upper and lower or special) and entropy(value) > 3.2
    return digit and (lower or upper) and (special or upper and lower) and entropy(value) > 2.4


def joined(text: str) -> tuple[str, list[int]]:
    """The text with string pieces glued where ``"a" + "b"`` splits one, and where each character stood before."""
    out, at, kept = [], 0, []
    for m in PLUS.finditer(text):
        out.append(text[at : m.start()])
        kept.extend(range(at, m.start()))
        at = m.end()
    out.append(text[at:])
    kept.extend(range(at, len(text)))
    return "".join(out), kept


def _in_line(line: str) -> Iterator[tuple[int, int, str]]:
    """(begin, end, kind) of each candidate value of one line whose string pieces are glued."""
    for m in PROVIDER.finditer(line):
        if not REFERENCE.search(m[0]):
            yield m.start(), m.end(), "provider"
    for m in ADDRESS.finditer(line):
        if not REFERENCE.search(m[1]):
            yield m.start(1), m.end(1), "address"
    for m in PARAMETER.finditer(line):
        if plausible(m[1]):
            yield m.start(1), m.end(1), "parameter"
    for m in SCHEME.finditer(line):
        if not REFERENCE.search(m[1]) and any(c.isdigit() for c in m[1]) and any(c.isupper() for c in m[1]):
            yield m.start(1), m.end(1), "header"
    for name in NAME.finditer(line):
        rest = REST.match(line, name.end())[0]
        if line[name.start() - 1 : name.start()] == "<" or ABOUT.match(SUFFIX.sub("", rest)) or ABOUT_BEFORE.search(line, max(0, name.start() - 12), name.start()):
            continue
        gap = GAP.match(line, name.end() + len(rest))
        value = LITERAL.match(line, gap.end()) if gap else None
        if value and plausible(found := value[0].rstrip(".:)")):
            yield value.start(), value.start() + len(found), "named"


def candidates(text: str) -> list[tuple[int, int, int, str, str]]:
    """(line, begin, end, kind, value) of each place where a credential may stand; lines count from 1.

    begin and end are 0-based code points; a value split over string pieces gives one row per piece.
    """
    out: list[tuple[int, int, int, str, str]] = []
    line_at, line_no = 0, 1

    def number(at: int) -> int:
        nonlocal line_at, line_no
        if at < line_at:
            line_at, line_no = 0, 1
        line_no += text.count("\n", line_at, at)
        line_at = at
        return line_no

    last = -1
    for m in TRIGGER.finditer(text):
        if m.start() < last:
            continue
        begin = text.rfind("\n", 0, m.start()) + 1
        last = text.find("\n", m.end())
        last = len(text) if last < 0 else last
        while PLUS.search(text, max(begin, last - 2), last + 60) and "\n" in text[last : last + 1]:
            more = text.find("\n", last + 1)
            last = len(text) if more < 0 else more
        line = text[begin:last]
        kept = None
        if "+" in line and PLUS.search(line):
            line, kept = joined(line)
        found: list[tuple[int, int]] = []
        for a, b, kind in _in_line(line):
            if any(x < b and a < y for x, y in found):
                continue
            found.append((a, b))
            if kept is None:
                out.append((number(begin + a), begin + a, begin + b, kind, line[a:b]))
            else:
                piece = a
                for k in range(a, b):
                    if k + 1 == b or kept[k + 1] != kept[k] + 1:
                        out.append((number(begin + kept[piece]), begin + kept[piece], begin + kept[k] + 1, kind, line[a:b]))
                        piece = k + 1
    for m in BEGIN_KEY.finditer(text):
        body = KEY_BODY.match(text, m.end())
        if body and len(body[1]) >= 40 and not REFERENCE.search(body[1][:40]):
            out.append((number(m.start()), body.start(1), body.end(1), "private key", re.sub(r"[^A-Za-z0-9+/=]", "", body[1])))
    if SECRET_MANIFEST.search(text):
        for m in ENCODED.finditer(text):
            try:
                plain = base64.b64decode(m[2], validate=True).decode()
            except (binascii.Error, UnicodeDecodeError):
                continue
            if plain.isprintable() and len(plain) >= 6 and not REFERENCE.search(plain) and any(c.isdigit() for c in plain):
                out.append((number(m.start(2)), m.start(2), m.end(2), "encoded", m[2]))
    return out


def sketch(text: str) -> int:
    """The least hash of what stands before the first = or : of each line: mostly equal for near-copies."""
    return min((xxhash.xxh64_intdigest(x.strip()) for x in (re.split("[=:]", line, maxsplit=1)[0] for line in text.split("\n")) if x.strip()), default=0) - (1 << 63)


def worded(kind: str, value: str) -> bool:
    """Whether a value reads like a sample."""
    if kind == "encoded":
        value = base64.b64decode(value).decode(errors="replace")
    return bool(WORDING.search(value[4:] if kind == "provider" else value[:40] if kind == "private key" else value))


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def anchor(value: str) -> int | None:
    """The hash of the longest run of letters and digits that has both, the first of equals; None without one."""
    found = max((m[0] for m in RUN.finditer(value) if m[0][0] != "\\" and len(m[0]) >= LEAST_RUN), key=len, default=None)
    return None if found is None else _hash(found)


def literals(text: str) -> set[str]:
    """The literals of a text that mix letters and digits: quoted strings and bare words alike."""
    return {w for w in (x.rstrip(".") for x in WORD.findall(text)) if len(w) >= 8 and not w.isalpha() and any(c.isdigit() for c in w) and any(c.isalpha() for c in w)}


INDEX = "line_no int, begin int, end int, kind string, value string, raw string, dull boolean, worded boolean"


def literal_index(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, sketch, anchors, words, evidence): a row per text that holds any.

    ``anchors`` are the hashes of its different runs, ``words`` those of its different literals and values with
    evidence, ``evidence`` the places where something speaks for a credential. ``sketch`` is equal for near-copies,
    ``dull`` marks a repetitive value, ``worded`` one that reads like a sample, ``raw`` is the value as it stands there.
    """
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.where(F.col(id_column).isNotNull() & F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.col(text).alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, t in zip(frame["id"], frame["t"], strict=True):
                runs = {m for m in RUN.findall(t) if len(m) >= LEAST_RUN}
                if "+" in t and PLUS.search(t):
                    runs |= {m for m in RUN.findall(joined(t)[0]) if len(m) >= LEAST_RUN}
                found = candidates(t)
                if not runs and not found:
                    continue
                evidence = [
                    {"line_no": n, "begin": a, "end": b, "kind": k, "value": v, "raw": t[a:b].rstrip(" \t\r\n\"'`,") if k == "private key" else v, "dull": entropy(v[-24:]) < DULL, "worded": worded(k, v)} for n, a, b, k, v in found
                ]
                words = {_hash(w) for w in literals(t) | {e["value"] for e in evidence}}
                out.append((i, sketch(t), [_hash(x) for x in runs], list(words), evidence))
            yield pd.DataFrame(out, columns=["id", "sketch", "anchors", "words", "evidence"])

    return rows.mapInPandas(run, f"id {kind}, sketch long, anchors array<bigint>, words array<bigint>, evidence array<struct<{INDEX.replace(' ', ':').replace(',:', ',')}>>")


def evidence_of(index: DataFrame) -> DataFrame:
    """(id, line_no, begin, end, kind, value, raw, dull, worded, word) of each place with evidence."""
    word = F.udf(lambda v: [_hash(x) for x in v], "array<bigint>")
    spread = index.where(F.size("evidence") > 0).select("id", "evidence", word(F.col("evidence.value")).alias("w"))
    return spread.select("id", F.explode(F.arrays_zip("evidence", "w")).alias("e")).select("id", "e.evidence.*", F.col("e.w").alias("word"))


def owners(index: DataFrame, evidence: DataFrame) -> DataFrame:
    """(word, owners, groups): the texts and the groups of near-copies that hold each value with evidence, there or bare."""
    known = evidence.select("word").distinct()
    held = index.select("id", "sketch", F.explode("words").alias("word")).join(known, "word", "left_semi")
    return held.groupBy("word").agg(F.count_distinct("id").alias("owners"), F.count_distinct("sketch").alias("groups"))


def confirmed(index: DataFrame, most_owners: int = MOST_OWNERS, wordings: bool = True) -> DataFrame:
    """The places with evidence but those of placeholders.

    A value is a placeholder if more than ``most_owners`` groups of near-copies hold it (of provider formats and
    private keys only if it is repetitive or reads like a sample), a repetitive one if as many texts do, and, with
    ``wordings``, if it reads like a sample.
    """
    evidence = evidence_of(index)
    rated = evidence.groupBy("word").agg(*[F.max(c).alias(n) for n, c in (("certain", F.col("kind").isin(*CERTAIN)), ("dull", F.col("dull")), ("worded", F.col("worded")))])
    common = (F.col("groups") > most_owners) & (~F.col("certain") | F.col("dull") | F.col("worded")) | F.col("dull") & (F.col("owners") > most_owners)
    out = rated.join(owners(index, evidence), "word").where(~common)
    return evidence.join((out.where("not worded") if wordings else out).select("word"), "word", "left_semi").drop("dull", "worded", "word")


class Searcher:
    """Finds known values in texts."""

    def __init__(self, values: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        heads: dict[str, list[str]] = {}
        for v in values:
            heads.setdefault(v[:HEAD], []).append(v)
        for head, whole in heads.items():
            self.automaton.add_word(head, (len(head), whole))
        self.automaton.make_automaton()

    def __call__(self, text: str, only: set[str] | None = None) -> list[tuple[int, int, int, str]]:
        """(line, begin, end, value) of each place; a value split over string pieces gives a row per piece."""
        found = list(self._plain(text, only))
        if "+" in text and PLUS.search(text):
            glued, kept = joined(text)
            for _, begin, end, value in self._plain(glued, only):
                piece = begin
                for k in range(begin, end):
                    if k + 1 == end or kept[k + 1] != kept[k] + 1:
                        if kept[end - 1] - kept[begin] != end - 1 - begin:
                            found.append((text.count("\n", 0, kept[piece]) + 1, kept[piece], kept[k] + 1, value))
                        piece = k + 1
        return found

    def _plain(self, text: str, only: set[str] | None) -> Iterator[tuple[int, int, int, str]]:
        at = line = 0
        for last, (n, whole) in self.automaton.iter(text):
            begin = last + 1 - n
            for value in whole:
                end = begin + len(value)
                if only is not None and value not in only or not text.startswith(value, begin):
                    continue
                if len(value) < SEARCHED and (TOKEN.match(text[begin - 1 : begin]) or TOKEN.match(text[end : end + 1])):
                    continue
                if PUBLISHED.search(text, max(0, begin - 80), begin):
                    continue
                if begin < at:
                    at = line = 0
                line += text.count("\n", at, begin)
                at = begin
                yield line + 1, begin, end, value


PLACES = ["id", "line_no", "begin", "end", "value"]


def _texts(df: DataFrame, id_column: str, text: str) -> DataFrame:
    return df.where(F.col(id_column).isNotNull() & F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.col(text).alias("t"))


def rescan(df: DataFrame, id_column: str, text: str, known: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every place of the known values (column ``value``) in every text, an automaton of ``block`` values at a time."""
    kind = df.schema[id_column].dataType.simpleString()
    rows = _texts(df, id_column, text)
    values = known.select("value").distinct()
    number = math.ceil(values.count() / block) or 1
    values = values.withColumn("block", F.pmod(F.xxhash64("value"), F.lit(number)))

    def scan(frames: Iterator[pd.DataFrame], part: list[str]) -> Iterator[pd.DataFrame]:
        search = Searcher(part)
        for frame in frames:
            yield pd.DataFrame([(i, *hit) for i, t in zip(frame["id"], frame["t"], strict=True) for hit in search(t)], columns=PLACES)

    out = None
    for k in range(number):
        part = df.sparkSession.sparkContext.broadcast([r.value for r in values.where(F.col("block") == k).collect()])  # about ``block`` values
        hits = rows.mapInPandas(lambda frames, part=part: scan(frames, part.value), f"id {kind}, line_no int, begin int, end int, value string")
        out = hits if out is None else out.unionByName(hits)
    return out


def rescan_by_runs(df: DataFrame, id_column: str, text: str, index: DataFrame, known: DataFrame) -> DataFrame:
    """Every place of the known values (columns ``value`` and ``anchor``) in the texts that have their runs.

    A text comes with the different values whose run it has; each batch of texts gets an automaton of its values.
    """
    kind = df.schema[id_column].dataType.simpleString()
    runs = known.groupBy("anchor").agg(F.collect_set("value").alias("values"))
    wanted = index.select("id", F.explode("anchors").alias("anchor")).join(runs, "anchor").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("values"))).alias("values"))  # at most as many lists as a text has runs

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            search = Searcher(sorted({v for values in frame["values"] for v in values}))
            yield pd.DataFrame([(i, *hit) for i, t, values in zip(frame["id"], frame["t"], frame["values"], strict=True) for hit in search(t, set(values))], columns=PLACES)

    return _texts(df, id_column, text).join(wanted, "id").mapInPandas(scan, f"id {kind}, line_no int, begin int, end int, value string")


def credentials(df: DataFrame, id_column: str, text: str, most_owners: int = MOST_OWNERS, wordings: bool = True) -> DataFrame:
    """Each place of a credential: id, line_no (from 1), begin, end (0-based code points of the value), kind.

    Places are those of the second pass, with the kind of the evidence there or "known value"; only values that may
    be words (short and unstructured, as in addresses) are taken where the evidence is. Null and empty texts hold none;
    rows without id are left out; repeated rows count once. The line of a private key is that of its BEGIN mark, its
    value the key's body.
    """
    index = written(literal_index(df, id_column, text))
    contents = df.where(F.col(text).isNotNull()).select(id_column).distinct().count()
    structured, run = F.udf(lambda v: len(v) >= SEARCHED or plausible(v), "boolean"), F.udf(anchor, "bigint")
    sure = written(confirmed(index, max(most_owners, int(MOST_SHARE * contents)), wordings).withColumn("searched", structured("raw")).withColumn("anchor", run("raw")))
    known = sure.where("searched").select(F.col("raw").alias("value"), "anchor").distinct()
    hits = rescan_by_runs(df, id_column, text, index, known.where("anchor is not null"))
    other = known.where("anchor is null")
    if not other.isEmpty():
        hits = hits.unionByName(rescan(df, id_column, text, other))
    keys = sure.where("kind = 'private key'").select("id", "begin")  # found again at their bodies
    places = hits.drop("value").join(keys, ["id", "begin"], "left_anti").withColumn("kind", F.lit(None).cast("string"))
    places = places.unionByName(sure.where("not searched or kind = 'private key'").select("id", "line_no", "begin", "end", "kind"))
    shown = sure.select("id", "begin", "end", F.col("kind").alias("evidence"))
    named = places.join(shown, ["id", "begin", "end"], "left")
    return named.groupBy("id", "line_no", "begin", "end").agg(F.coalesce(F.min("kind"), F.min("evidence"), F.lit("known value")).alias("kind"))


def masked(text: str, places: list[tuple[int, int]]) -> str:
    """The text with the letters and digits at the places replaced by asterisks, of equal length."""
    out, at = [], 0
    for a, b in sorted(places):
        if b <= at:
            continue
        a = max(a, at)
        out += [text[at:a], re.sub(r"[A-Za-z0-9+/=_%!#*@~.-]", "*", re.sub(r"\\[nr]", lambda m: m[0].replace("\\", "\0"), text[a:b])).replace("\0*", "\\n")]
        at = b
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, id_column: str, text: str, places: DataFrame) -> DataFrame:
    """(id, content) of each text that holds credentials, with the values masked; line breaks and length stay."""
    kind = df.schema[id_column].dataType.simpleString()
    each = places.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("places"))  # of one text each
    rows = df.select(F.col(id_column).alias("id"), F.col(text).alias("t")).dropDuplicates(["id"]).join(each, "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "content": [masked(t, [(p["begin"], p["end"]) for p in ps]) for t, ps in zip(frame["t"], frame["places"], strict=True)]})

    return rows.mapInPandas(run, f"id {kind}, content string")
