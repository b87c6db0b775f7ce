"""Scalar functions over text, paths and numbers, all as built-in column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and their languages, words that search ignores.
LANGUAGES = {"ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "py": "Python", "go": "Go", "json": "JSON", "md": "Markdown", "mdx": "Markdown", "yml": "YAML", "yaml": "YAML", "sql": "SQL", "env": "Dotenv", "csv": "CSV", "svg": "SVG", "rs": "Rust", "rb": "Ruby", "php": "PHP", "java": "Java", "cs": "C#", "css": "CSS", "html": "HTML", "sh": "Shell"}
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "into", "are", "was", "how", "what", "where", "when", "which", "does", "is", "in", "of", "to", "on", "it", "by", "an", "as", "at", "be", "or", "not")


def count_lines(text: Column) -> Column:
    """0 for an empty text, else line breaks + 1."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def slice_lines(text: Column, start: int, end: int) -> Column:
    """Lines start to end, counted from 1, both included; at least one."""
    first = max(start, 1)
    return F.array_join(F.slice(F.split(text, "\n", -1), first, max(end - first + 1, 1)), "\n")


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def words(text: Column) -> Column:
    """Lower-case words of two or more letters or digits; camelCase and acronyms come apart."""
    apart = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.transform(F.split(apart, "[^A-Za-z0-9]+", -1), F.lower), lambda w: F.length(w) >= 2)


def query_terms(text: Column) -> Column:
    """Distinct words without stop words, each also without a plural, -ing or -ed ending."""
    kept = F.array_except(words(text), F.array(*[F.lit(w) for w in STOP_WORDS]))
    bare = F.transform(kept, lambda w: F.when(w.rlike("[a-z]{3,}(s|ing|ed)$"), F.regexp_replace(w, "(s|ing|ed)$", "")).otherwise(w))
    return F.array_distinct(F.concat(kept, bare))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, F.size(F.array_intersect(a, b)) / whole).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors of doubles; 0 where one is all zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1048576, F.format_string("%.1f KB", F.round(n / 1024, 1))).when(n.isNotNull(), F.format_string("%.1f MB", F.round(n / 1048576, 1)))


def first_sentence(text: Column, most: int = 160) -> Column:
    """Up to the first end mark before white space; longer ones end at a word with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    one = F.coalesce(F.nullif(F.regexp_extract(flat, r"^(.*?[.!?])\s", 1), F.lit("")), flat)
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.regexp_replace(F.left(one, F.lit(most)), r"\s\S*$", ""), F.lit("…")))


def extension_of(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit(""))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension_of(path)), F.lit("Unknown"))


def resolve_path(path: Column) -> Column:
    """``.`` and ``..`` resolved; what would leave the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.array_join(done, "/")


def compact(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def singular(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("ies$"), F.regexp_replace(low, "ies$", "y")).when(low.rlike("(s|x|ch|sh)es$"), F.regexp_replace(low, "es$", "")).when(low.rlike("[^s]s$"), F.regexp_replace(low, "s$", "")).otherwise(low)


def short_hash(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts: a repeatable id."""
    return F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(16))


def stamp(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS.mmm."""
    ms = ms.cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def mask_mail(text: Column) -> Column:
    return F.regexp_replace(text, r"([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***@$2")


def mask_card(digits: Column) -> Column:
    return F.concat(F.lit("**** "), F.right(digits, F.lit(4)))


def luhn(digits: Column) -> Column:
    """Whether the check digit of a number is right."""
    return F.call_function("luhn_check", digits)


def cascade(path: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that matches."""
    out = None
    for pattern, label in rules:
        out = F.when(path.rlike(pattern), label) if out is None else out.when(path.rlike(pattern), label)
    return out.otherwise(otherwise)


def table_cell(text: Column) -> Column:
    """Safe in a Markdown table."""
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def node_id(text: Column) -> Column:
    """Safe as a diagram's node id."""
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def hash31(text: Column) -> Column:
    """The sum of code units by powers of 31, modulo 2**32."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(units, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 4294967296)


def mask_grouped(number: Column) -> Column:
    """123-45-6789 as ***-**-6789."""
    return F.regexp_replace(number, r"^\d{3}-\d{2}-(\d{4})$", r"***-**-$1")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def spoken(name: Column) -> Column:
    """camelCase, snake_case and kebab-case as lower-case words."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " "))


def cited_path(citation: Column) -> Column:
    return F.regexp_extract(citation, r"^(.*):\d", 1)


def cited_lines(citation: Column) -> Column:
    """[first, last] of path:line or path:line-line."""
    first = F.regexp_extract(citation, r":(\d+)", 1).cast("long")
    return F.array(first, F.coalesce(F.nullif(F.regexp_extract(citation, r"-(\d+)$", 1), F.lit("")).cast("long"), first))


def identifier(name: Column) -> Column:
    """The name in quotes if it is a plain identifier, else null: nothing else may become part of a statement."""
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit('"'), name, F.lit('"')))


def line_of(text: Column, at: Column) -> Column:
    """The line, from 1, of the character at a place counted from 1."""
    before = F.left(text, at - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def repository(address: Column, part: int) -> Column:
    """Owner (1) or name (2) of a repository's address."""
    return F.regexp_extract(address, r"[/:]([^/:]+)/([^/]+?)(?:\.git)?/?$", part)
