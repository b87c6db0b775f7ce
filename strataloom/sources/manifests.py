"""Dependencies that package manifests declare, and path aliases."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _json(text: str) -> dict:
    text = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    try:
        value = json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def _table(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def _requirement(line: str) -> tuple[str, str] | None:
    m = re.match(r"\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*([^;#]*)", line)
    return (m[1], m[2].strip()) if m and not line.lstrip().startswith(("-", "#")) else None


def dependencies_of(path: str, text: str) -> Iterator[tuple[str, str, str, bool]]:
    """(ecosystem, name, version, development) in the order of the manifest."""
    name = path.rsplit("/", 1)[-1]
    if name == "package.json":
        d = _json(text)
        for key, dev in (("dependencies", False), ("devDependencies", True), ("peerDependencies", False), ("optionalDependencies", False)):
            for k, v in _table(d.get(key)).items():
                yield "npm", k, str(v), dev
    elif re.match(r"requirements.*\.txt$", name):
        for line in text.split("\n"):
            if r := _requirement(line):
                yield "pypi", *r, "dev" in name
    elif name == "pyproject.toml":
        project = _table(_toml(text).get("project"))
        for line in project.get("dependencies") or []:
            if r := _requirement(str(line)):
                yield "pypi", *r, False
        for group in _table(project.get("optional-dependencies")).values():
            for line in group:
                if r := _requirement(str(line)):
                    yield "pypi", *r, True
        for k, v in _table(_table(_table(_toml(text).get("tool")).get("poetry")).get("dependencies")).items():
            if k != "python":
                yield "pypi", k, v if isinstance(v, str) else str(_table(v).get("version", "")), False
    elif name == "go.mod":
        for m in re.finditer(r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/[\w./-]+|[\w.-]+\.[a-z]+/[\w./-]+)\s+(v[\w.+-]+)", text, re.M):
            yield "go", m[1], m[2], "// indirect" in text[m.end() : text.find("\n", m.end()) + 1]
    elif name == "Cargo.toml":
        for key, dev in (("dependencies", False), ("dev-dependencies", True)):
            for k, v in _table(_toml(text).get(key)).items():
                yield "cargo", k, v if isinstance(v, str) else str(_table(v).get("version", "")), dev
    elif name == "pom.xml":
        for block in re.findall(r"<dependency>(.*?)</dependency>", text, re.S):
            g, a, v, s = (re.search(rf"<{t}>\s*([^<]*?)\s*</{t}>", block) for t in ("groupId", "artifactId", "version", "scope"))
            if g and a:
                yield "maven", f"{g[1]}:{a[1]}", v[1] if v else "", bool(s and s[1] == "test")
    elif name in ("build.gradle", "build.gradle.kts"):
        for m in re.finditer(r"\b(\w*[iI]mplementation|api|compileOnly|runtimeOnly)\s*\(?\s*[\"']([^:\"']+:[^:\"']+)(?::([^\"']+))?[\"']", text):
            yield "maven", m[2], m[3] or "", m[1].startswith("test")
    elif name == "Gemfile":
        for m in re.finditer(r"^\s*gem\s+[\"']([^\"']+)[\"'](?:\s*,\s*[\"']([^\"']+)[\"'])?", text, re.M):
            yield "gem", m[1], m[2] or "", False
    elif name == "composer.json":
        d = _json(text)
        for key, dev in (("require", False), ("require-dev", True)):
            for k, v in _table(d.get(key)).items():
                if "/" in k:
                    yield "composer", k, str(v), dev
    elif name.endswith(".csproj") or name == "Directory.Packages.props":
        for m in re.finditer(r"<Package(?:Reference|Version)\s+Include=\"([^\"]+)\"(?:\s+Version=\"([^\"]+)\")?", text):
            yield "nuget", m[1], m[2] or "", False
    elif name == "pubspec.yaml":
        section = ""
        for line in text.split("\n"):
            if re.match(r"\w+:", line):
                section = line.split(":")[0]
            elif section in ("dependencies", "dev_dependencies") and (m := re.match(r"  (\w+):\s*(.*)$", line)):
                yield "pub", m[1], m[2].strip("'\" "), section.startswith("dev")


def aliases_of(path: str, text: str) -> Iterator[tuple[str, str]]:
    """(alias, target) of a tsconfig or jsconfig, targets below its base folder."""
    folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    options = _table(_json(text).get("compilerOptions"))
    base = str(options.get("baseUrl", ".")).strip("./")
    for alias, targets in _table(options.get("paths")).items():
        for target in targets if isinstance(targets, list) else []:
            yield alias, folder + (base + "/" if base else "") + str(target).removeprefix("./")


def dependencies(files: DataFrame) -> DataFrame:
    """(project_id, ecosystem, name, version, development, path) of files (project_id, path, content); the first of a name wins."""
    from strataloom.operators.relational import first_per

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *d, path, k) for p, path, t in zip(f["project_id"], f["path"], f["content"], strict=True) for k, d in enumerate(dependencies_of(path, t))]
            yield pd.DataFrame(rows, columns=["project_id", "ecosystem", "name", "version", "development", "path", "n"])

    own = files.where("path is not null and content is not null").select("project_id", "path", "content")
    found = own.mapInPandas(run, "project_id string, ecosystem string, name string, version string, development boolean, path string, n int")
    return first_per(found, ["project_id", "ecosystem", "name"], ["path", "n"]).drop("n")
