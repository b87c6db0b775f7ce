"""Imports to the files they mean: ordered candidate paths per language, the first that exists wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPT = ("", ".ts", ".tsx", ".mts", ".js", ".jsx", ".mjs", ".cjs", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs")


def joined(folder: str, relative: str) -> str:
    parts = [p for p in folder.split("/") if p]
    for p in relative.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def candidates(path: str, spec: str, language: str, aliases: dict[str, str] | None = None) -> list[tuple[str, bool]]:
    """(path, whole) in order; ``whole`` False asks for any file whose path ends so."""
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    if language in ("TypeScript", "JavaScript"):
        bases = [joined(folder, spec)] if spec.startswith(".") else []
        for alias, target in (aliases or {}).items():
            head = alias.rstrip("*")
            if alias.endswith("*") and spec.startswith(head):
                bases.append(joined("", target.rstrip("*") + spec[len(head) :]))
            elif spec == alias:
                bases.append(joined("", target))
        stems = [b[: -len(e)] if b.endswith(e) else None for b in bases for e in (".js", ".mjs")]
        return [(b + e, True) for b in [*bases, *[s for s in stems if s]] for e in SCRIPT]
    if language == "Python":
        dots = len(spec) - len(spec.lstrip("."))
        name = spec[dots:].replace(".", "/")
        if dots:
            base = joined(folder, "/".join([".."] * (dots - 1)) + "/" + name) if name or dots > 1 else folder
            return [(base + ".py", True), (base + "/__init__.py", True)]
        return [(x, whole) for x in (name + ".py", name + "/__init__.py") for whole in (True, False)]
    if language == "Go":
        parts = spec.split("/")
        return [("/".join(parts[k:]) + "/*.go", False) for k in range(1, len(parts))]
    return []


def package_of(spec: Column, language: Column) -> Column:
    """The package an unresolved import belongs to."""
    parts = F.split(spec, "/")
    script = F.array_join(F.slice(parts, 1, F.when(spec.startswith("@"), 2).otherwise(1)), "/")
    go = F.when(F.contains(parts[0], F.lit(".")), F.array_join(F.slice(parts, 1, 3), "/")).otherwise(spec)
    return F.when(language.isin("TypeScript", "JavaScript"), script).when(language == "Python", F.split(spec, r"\.")[0]).when(language == "Go", go).otherwise(spec)


def resolved(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(project_id, path, spec, target, package) of imports (project_id, path, language, spec).

    ``paths`` has project_id, path. Candidates meet existing paths by equality: whole paths, suffixes made from each
    existing path, or folders for Go. Where no candidate exists, target is null and package names the import.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, path, spec, k, c, whole) for p, path, lang, spec in f.itertuples(index=False, name=None) for k, (c, whole) in enumerate(candidates(path, spec, lang))]
            yield pd.DataFrame(rows, columns=["project_id", "path", "spec", "ord", "candidate", "whole"])

    asked = imports.where("path is not null and spec is not null and spec <> ''").select("project_id", "path", "language", "spec").distinct()
    wanted = asked.mapInPandas(run, "project_id string, path string, spec string, ord int, candidate string, whole boolean")
    parts = F.split("target", "/")
    known = paths.where("path is not null").select("project_id", F.col("path").alias("target")).distinct()
    suffixes = known.select("project_id", "target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("candidate"), F.lit(False).alias("whole"))
    folder = F.slice(parts, 1, F.size(parts) - 1)
    folders = known.where("target like '%/%.go'").select("project_id", "target", F.explode(F.transform(F.sequence(F.lit(1), F.size(folder)), lambda i: F.concat(F.array_join(F.slice(folder, i, F.size(folder)), "/"), F.lit("/*.go")))).alias("candidate"), F.lit(False).alias("whole"))
    table = known.select("project_id", "target", F.col("target").alias("candidate"), F.lit(True).alias("whole")).unionByName(suffixes).unionByName(folders)
    best = wanted.join(table, ["project_id", "candidate", "whole"]).groupBy("project_id", "path", "spec").agg(F.min(F.struct("ord", "target")).alias("m"))
    return asked.join(best, ["project_id", "path", "spec"], "left").select("project_id", "path", "spec", F.col("m.target").alias("target"), F.when(F.col("m").isNull(), package_of(F.col("spec"), F.col("language"))).alias("package"))
