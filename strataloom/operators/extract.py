"""Symbols, headings, tables and settings out of source texts."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRANCHES = (ast.If, ast.For, ast.While, ast.AsyncFor, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case, ast.Assert)


def python_symbols_of(text: str) -> list[tuple[str, str, int, int, int, int, str]]:
    """(name, kind, start, end, complexity, calls, doc) of each class and function; nothing where the text is invalid."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []

    def walk(node: ast.AST, prefix: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                name = f"{prefix}{child.name}"
                inner = list(ast.walk(child))
                complexity = 1 + sum(isinstance(n, BRANCHES) for n in inner) + sum(len(n.values) - 1 for n in inner if isinstance(n, ast.BoolOp))
                doc = (ast.get_docstring(child) or "")[:600]
                out.append((name, "class" if is_class else "method" if in_class else "function", child.lineno, child.end_lineno, 0 if is_class else complexity, sum(isinstance(n, ast.Call) for n in inner), doc))
                walk(child, name + ".", is_class)
            else:
                walk(child, prefix, in_class)

    walk(tree, "", False)
    return out


def python_symbols(texts: DataFrame) -> DataFrame:
    """Symbols of (id, content) in Python; id, name, kind, start_line, end_line, complexity, calls, doc."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *s) for i, t in zip(frame["id"], frame["content"], strict=True) for s in python_symbols_of(t)]
            yield pd.DataFrame(rows, columns=["id", "name", "kind", "start_line", "end_line", "complexity", "calls", "doc"])

    rows = texts.where("id is not null and content is not null").select("id", "content")
    return rows.mapInPandas(run, f"id {kind}, name string, kind string, start_line int, end_line int, complexity int, calls int, doc string")


def sql_tables(texts: DataFrame) -> DataFrame:
    """(id, table_name, n_columns) of each CREATE TABLE statement."""
    found = texts.select("id", F.explode(F.regexp_extract_all("content", F.lit(r"CREATE TABLE (\w+ \([^;]*)\);"), F.lit(1))).alias("s"))
    return found.select("id", F.split("s", " ")[0].alias("table_name"), F.regexp_count("s", F.lit(r"\n\s+\w+ [A-Z]")).alias("n_columns"))


def headings(texts: DataFrame) -> DataFrame:
    """(id, line_no, level, title) of each Markdown heading."""
    lines = texts.where(F.col("content").rlike(r"(?m)^#{1,6} ")).select("id", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(r"^#{1,6} "))
    return lines.select("id", (F.col("pos") + 1).alias("line_no"), F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("line", r"^#+ ([^\r]*)", 1)).alias("title"))


def settings(texts: DataFrame) -> DataFrame:
    """(id, name) of each environment variable a text reads or sets."""
    patterns = [r"process\.env\.([A-Z][A-Z0-9_]+)", r"os\.environ\[\"([A-Z][A-Z0-9_]+)\"\]", r"os\.Getenv\(\"([A-Z][A-Z0-9_]+)\"\)", r"\$\{([A-Z][A-Z0-9_]+)\}", r"(?m)^(?:export )?([A-Z][A-Z0-9_]+)="]
    every = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns])
    return texts.select("id", F.explode(F.array_distinct(every)).alias("name"))
