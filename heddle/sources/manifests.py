"""Dependencies and identities that manifests declare."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, name string, version_spec string"
REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[^\]]*\])?\s*([^;#]*)")


def requirements(lines) -> list[tuple[str, str]]:
    out = []
    for line in lines:
        if line.strip() and not line.lstrip().startswith(("#", "-")) and (m := REQUIREMENT.match(line)):
            out.append((m[1], m[2].strip()))
    return out


def table_specs(table: dict) -> list[tuple[str, str]]:
    return [(k, v if isinstance(v, str) else str(v.get("version", "")) if isinstance(v, dict) else "") for k, v in table.items()]


def dependencies(path: str, text: str) -> list[tuple[str, str]]:
    """(name, version_spec) of each dependency; none for files that aren't manifests or don't parse."""
    file = path.rsplit("/", 1)[-1]
    try:
        if file == "pyproject.toml":
            doc = tomllib.loads(text)
            project = doc.get("project", {})
            own = requirements(project.get("dependencies", []))
            for extra in project.get("optional-dependencies", {}).values():
                own += requirements(extra)
            return own + [d for d in table_specs(doc.get("tool", {}).get("poetry", {}).get("dependencies", {})) if d[0] != "python"]
        if file == "Cargo.toml":
            doc = tomllib.loads(text)
            return [d for t in ("dependencies", "dev-dependencies", "build-dependencies") for d in table_specs(doc.get(t, {}))]
        if re.fullmatch(r"requirements.*\.txt", file):
            return requirements(text.splitlines())
        if file in ("package.json", "composer.json"):
            doc = json.loads(text)
            return [d for t in ("dependencies", "devDependencies", "peerDependencies", "require", "require-dev") for d in table_specs(doc.get(t, {})) if d[0] != "php"]
        if file == "go.mod":
            return re.findall(r"^\s*(?:require\s+)?([\w.-]+\.[\w./~-]+)\s+(v\S+)", text, re.M)
        if file == "Gemfile":
            return [(a, b or "") for a, b in re.findall(r"^\s*gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?", text, re.M)]
        if file.endswith(".csproj"):
            return [(x.get("Include", ""), x.get("Version", "")) for x in ElementTree.fromstring(text).iter() if x.tag.endswith("PackageReference")]
    except (ValueError, AttributeError, TypeError, ElementTree.ParseError):
        return []
    return []


def declared(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, name, version_spec of the dependencies in every manifest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, n, v) for p, t in zip(pdf[path], pdf[text], strict=True) for n, v in dependencies(p, t or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "version_spec"])

    names = F.element_at(F.split(path, "/"), -1)
    wanted = names.rlike(r"^(pyproject\.toml|Cargo\.toml|requirements.*\.txt|package\.json|composer\.json|go\.mod|Gemfile|.*\.csproj)$")
    return files.where(wanted).select(path, text).mapInPandas(run, SCHEMA)


def external_packages(found: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Package nodes, and edges to them with their versions."""
    nodes = found.select(F.lit("ExternalPackage").alias("label"), F.col("name").alias("qualified_name"), "name").distinct()
    edges = found.groupBy("name").agg(F.max("version_spec").alias("version_spec")).select(F.lit("DEPENDS_ON_EXTERNAL").alias("rel"), F.lit(project).alias("src"), F.col("name").alias("dst"), "version_spec")
    return nodes, edges


def identities(files: DataFrame, slug: str = "slug", path: str = "path", text: str = "text") -> DataFrame:
    """slug, npm_name, python_name, python_top_level of each repository, from the manifests at its root."""
    t = F.col(text)
    npm = F.when(F.col(path) == "package.json", F.get_json_object(t, "$.name"))
    name = r"(?s)\[(?:project|tool\.poetry)\].*?^\s*name\s*=\s*['\"]([^'\"]+)['\"]"
    py = F.when(F.col(path) == "pyproject.toml", F.nullif(F.regexp_extract(t, "(?m)" + name, 1), F.lit(""))).when(F.col(path) == "setup.py", F.nullif(F.regexp_extract(t, r"name\s*=\s*['\"]([^'\"]+)['\"]", 1), F.lit("")))
    top = F.when(F.col(path).rlike(r"^(src/)?[^/]+/__init__\.py$"), F.element_at(F.split(path, "/"), -2))
    return files.groupBy(slug).agg(F.max(npm).alias("npm_name"), F.max(py).alias("python_name"), F.min(top).alias("python_top_level"))
