"""What source, configuration and documentation texts declare, by their lines; no parser needed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCRIPT = r"^(export )?(?:default )?(?:declare )?(?:abstract )?(?:async )?(function\*?|class|interface|type|enum|const|let|var) ([A-Za-z_$][A-Za-z0-9_$]*)"
GENERIC = r"^\s*(?:export |public |pub |static |async )*(class|struct|interface|trait|function|def|func|fn|sub) +([A-Za-z_]\w*)"
FROM = r"^(?:import|export) .*from [\"']([^\"']+)[\"']|^import [\"']([^\"']+)[\"']|require\([\"']([^\"']+)[\"']\)"
GO_FUNCTION = r"^func (?:\([A-Za-z_]\w* \*?([A-Za-z_]\w*)\) )?([A-Za-z_]\w*)\("
GO_TYPE = r"^type (\w+) (\w+)"
KEY = r"^([A-Za-z_][A-Za-z0-9_.-]*)\s*[:=]"
BRANCH = r"\b(?:if|for|while|case|catch|elif|except)\b|&&|\|\|"
FIELD = r"(?m)^\s+(\w+)(\??): ([\w<>\[\]]+);"


def lines_of(texts: DataFrame, pattern: str) -> DataFrame:
    """(all but content, line_no from 1, line) of the lines that match; texts without a match never become lines.

    Null texts have no lines.
    """
    others = [c for c in texts.columns if c != "content"]
    some = texts.where(F.col("content").rlike("(?m)" + pattern))
    lines = some.select(*others, F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
    return lines.where(F.col("line").rlike(pattern)).select(*others, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def declared(texts: DataFrame, pattern: str, kind: int, name: int) -> DataFrame:
    """(id, language, line_no, kind, name, line) of each declaring line, by groups of the pattern."""
    return lines_of(texts, pattern).select("id", "language", "line_no", F.regexp_extract("line", pattern, kind).alias("kind"), F.regexp_extract("line", pattern, name).alias("name"), "line")


def imported(texts: DataFrame) -> DataFrame:
    """(id, line_no, specifier) of each importing line."""
    parts = [F.nullif(F.regexp_extract("line", FROM, k), F.lit("")) for k in (1, 2, 3)]
    return lines_of(texts, FROM).select("id", "line_no", F.coalesce(*parts).alias("specifier"))


def go_symbols(texts: DataFrame) -> DataFrame:
    """(id, line_no, kind, name, receiver) of functions, methods and types."""
    receiver = F.nullif(F.regexp_extract("line", GO_FUNCTION, 1), F.lit(""))
    functions = lines_of(texts, GO_FUNCTION).select("id", "line_no", F.when(receiver.isNull(), "function").otherwise("method").alias("kind"), F.regexp_extract("line", GO_FUNCTION, 2).alias("name"), receiver.alias("receiver"))
    types = declared(texts, GO_TYPE, kind=2, name=1).select("id", "line_no", "kind", "name", F.lit(None).cast("string").alias("receiver"))
    return functions.unionByName(types)


def config_keys(texts: DataFrame) -> DataFrame:
    """(id, line_no, name) of top-level keys."""
    return lines_of(texts, KEY).select("id", "line_no", F.regexp_extract("line", KEY, 1).alias("name"))


def complexity(text: Column) -> Column:
    return (F.size(F.regexp_extract_all(text, F.lit(BRANCH), F.lit(0))) + 1).cast("long")


def typed_fields(texts: DataFrame) -> DataFrame:
    """(id, field, type, cardinality): many for arrays, optional for marked fields, else one."""
    found = texts.select("id", F.explode(F.regexp_extract_all("content", F.lit(FIELD), F.lit(0))).alias("m"))
    kind = F.regexp_extract("m", r": ([\w<>\[\]]+);", 1)
    held = F.when(kind.endswith("[]") | kind.startswith("Array<"), "many").when(F.contains("m", F.lit("?:")), "optional").otherwise("one")
    return found.select("id", F.regexp_extract("m", r"(\w+)\??: ", 1).alias("field"), kind.alias("type"), held.alias("cardinality"))


def nested(texts: DataFrame) -> DataFrame:
    """(id, line_no, parent_line) of each Markdown heading; null at the top.

    The parent is the nearest heading above of a lower level that no heading of its level or a lower one has closed.
    """
    h = lines_of(texts, "^#{1,6} ").select("id", "line_no", F.length(F.regexp_extract("line", "^(#+) ", 1)).alias("level"))
    above = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("line_no"))).over(above) for k in range(1, 6)}
    h = h.select("*", *[c.alias(f"l{k}") for k, c in last.items()])
    open_ = lambda k: reduce(lambda ok, j: ok & (F.coalesce(F.col(f"l{j}"), F.lit(0)) < F.col(f"l{k}")), range(1, k), F.lit(True))
    kept = [F.when((F.col("level") > k) & open_(k), F.col(f"l{k}")) for k in range(1, 6)]
    return h.select("id", "line_no", F.greatest(*kept).alias("parent_line"))
