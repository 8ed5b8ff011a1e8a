"""Predicates over names, paths and query texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segments of fixtures.
FIXTURE_SEGMENTS = ("fixtures", "large-file", "__fixtures__")

# Marks of tests and scripts in lower-case names.
DOTTED_MARKERS = (".test.", ".spec.", ".tests.", ".scripts.", ".stories.", ".bench.", ".benchmark.")
LEADING_MARKERS = ("tests.", "scripts.", "__tests__", "__mocks__", "conftest.")

# Paths whose symbols are not embedded.
SKIPPED_PATHS = (
    r"(^|/)tests?/",
    r"_test\.(py|go|rs|js|ts|tsx)$",
    r"\.test\.(js|ts|tsx|jsx)$",
    r"\.spec\.(js|ts|tsx|jsx)$",
    r"(^|/)__tests__/",
    r"(^|/)test_[^/]+\.py$",
    r"(^|/)conftest\.py$",
    r"\.pb\.(go|py|cc|h)$",
    r"_pb2\.py$",
    r"_pb2_grpc\.py$",
    r"(^|/)generated/",
    r"_generated\.(go|py|ts|tsx)$",
    r"(^|/)vendor/",
    r"(^|/)node_modules/",
    r"(^|/)\.venv/",
    r"(^|/)dist/",
    r"(^|/)build/",
)

# Names of folders that are never read.
IGNORED_NAMES = (
    ".cache", ".claude", ".eclipse", ".eggs", ".env", ".git", ".gradle", ".hg", ".idea", ".maven", ".mypy_cache", ".next", ".nox", ".npm",
    ".nyc_output", ".pnpm-store", ".pytest_cache", ".qdrant_code_embeddings", ".ruff_cache", ".svn", ".tantivy", ".tmp", ".tox", ".turbo",
    ".venv", ".vs", ".vscode", ".yarn", "__pycache__", "bin", "bower_components", "build", "coverage", "dist", "env", "htmlcov",
    "node_modules", "obj", "out", "Pods", "site-packages", "target", "temp", "tmp", "vendor", "venv",
)

# Endings of files that are never read.
IGNORED_SUFFIXES = (".tmp", "~", ".pyc", ".pyo", ".o", ".a", ".so", ".dll", ".class")

# Markdown files that are read.
MARKDOWN_FOLDERS = (".planning", "docs")
MARKDOWN_ROOT = ("README.md", "CLAUDE.md", "CONTEXT.md", "AGENTS.md", "ROADMAP.md", "CONTRIBUTING.md", "SECURITY.md", "ARCHITECTURE.md")
MARKDOWN_EXCLUDED = ("node_modules/", ".venv/", "vendor/", "dist/", "build/", ".git/")

# Words that a query may not have outside its quoted strings.
QUERY_WORDS = ("CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP", "COPY", "CALL", "LOAD")
# Words that a generated query may not have anywhere; comments may stand between two.
GENERATED_WORDS = ("DELETE", "DETACH", "DROP", "CREATE INDEX", "CREATE CONSTRAINT", "REMOVE", "SET", "MERGE", "CREATE", "CALL", "LOAD CSV", "FOREACH")
#: Words of this engine's own statements that change data or settings, or run other code.
STATEMENT_WORDS = ("INSERT", "UPDATE", "ALTER", "TRUNCATE", "REPLACE", "CACHE", "UNCACHE", "REFRESH", "ANALYZE", "MSCK", "USE", "ADD", "EXECUTE", "DECLARE", "REPAIR", "CLEAR", "RESET", "KILL", "java_method", "reflect", "try_reflect")
QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
BETWEEN = r"(?:\s|//[^\n]*|/\*(?s:.*?)\*/)+"
WRITES = r"(?i)\b(?:" + "|".join(QUERY_WORDS) + r")\b"
GENERATED_WRITES = r"(?i)\b(?:" + "|".join(w.replace(" ", BETWEEN) for w in GENERATED_WORDS) + r")\b"
# Formats whose files a query can name as relations.
FILE_FORMATS = ("avro", "binaryFile", "csv", "json", "orc", "parquet", "text", "xml")
COMMENTS = r"/\*(?:[^*]|\*+[^*/])*\*+/|--[^\n]*"
FILE_RELATION = r"(?i)(?:\b(?:FROM|JOIN|TABLE)\b|,)[\s(]*`?(?:" + "|".join(FILE_FORMATS) + r")`?\s*\.\s*[`\w]"


def is_noise(name: Column) -> Column:
    """Fixtures, anonymous functions, and names whose last two parts are equal."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    twin = (n >= 2) & (F.get(parts, n - 1) == F.get(parts, n - 2))
    return F.arrays_overlap(parts, F.array(*map(F.lit, FIXTURE_SEGMENTS))) | F.exists(parts, lambda p: p.rlike(r"^anonymous_[0-9]+_[0-9]+$")) | twin


def any_of(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def is_test_or_script(name: Column) -> Column:
    low = F.lower(name)
    return any_of([low.contains(m) for m in DOTTED_MARKERS] + [low.startswith(m) | low.contains("." + m) for m in LEADING_MARKERS])


def is_test_symbol(name: Column) -> Column:
    return name.rlike(r"\.tests\.|\.test\.|\.spec\.|\.test$")


def skip_embedding(path: Column) -> Column:
    return path.rlike("|".join(f"(?:{p})" for p in SKIPPED_PATHS))


def is_markdown_source(path: Column) -> Column:
    first = F.split(path, "/")[0]
    placed = F.when(path.contains("/"), first.isin(*MARKDOWN_FOLDERS)).otherwise(path.isin(*MARKDOWN_ROOT))
    return path.endswith(".md") & ~any_of([path.contains(x) for x in MARKDOWN_EXCLUDED]) & placed


def glob_pattern(glob: str) -> str:
    """Regular expression of a file-name glob."""
    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
    return f"^(?:{out})$"


def skip_path(path: Column, exclude: tuple[str, ...] = (), unignore: tuple[str, ...] = ()) -> Column:
    """Whether a file's path is left out: excluded folders, then names let in, then excluded names,
    then folders let in, then the folders that are never read."""
    parts = F.split(path, "/")
    folders, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    under = lambda ps: any_of([(path == p) | path.startswith(p + "/") for p in ps])
    named = lambda ps: any_of([name.rlike(glob_pattern(p)) for p in ps])
    has = lambda ps: F.arrays_overlap(folders, F.array(*map(F.lit, ps))) if ps else F.lit(False)
    ended = any_of([name.endswith(s) for s in IGNORED_SUFFIXES])
    return F.when(ended | has(exclude) | under(exclude), True).when(named(unignore), False).when(named(exclude), True).when(under(unignore), False).otherwise(has(IGNORED_NAMES))


def prune_folder(path: Column, exclude: tuple[str, ...] = (), unignore: tuple[str, ...] = ()) -> Column:
    """Whether a folder is left out with all below it; never one above a folder that is let in."""
    parts = F.split(path, "/")
    above = any_of([F.lit(p).startswith(F.concat(path, F.lit("/"))) | (path == p) | path.startswith(p + "/") for p in unignore])
    has = lambda ps: F.arrays_overlap(parts, F.array(*map(F.lit, ps))) if ps else F.lit(False)
    under = any_of([(path == p) | path.startswith(p + "/") for p in exclude])
    return F.when(has(exclude) | under, True).when(above, False).otherwise(has(IGNORED_NAMES))


def is_trivial(name: Column, source: Column) -> Column:
    """Anonymous or repeated names, and sources of few characters or lines."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    lines = F.filter(F.split(source, "\n"), lambda x: F.trim(x) != "")
    return name.rlike(r"(^|\.)anonymous_[0-9]+_[0-9]+(\.|$)") | ((n >= 2) & (F.get(parts, n - 1) == F.get(parts, n - 2))) | (F.length(F.regexp_replace(source, r"\s", "")) < 150) | (F.size(lines) < 5)


def has_write_word(query: Column) -> Column:
    """Whether a query text has a word that writes, outside its quoted strings."""
    return F.regexp_replace(query, QUOTED, "''").rlike(WRITES)


def has_generated_write_word(query: Column) -> Column:
    """Whether a generated query has a word that writes anywhere, strings and comments included."""
    return query.rlike(GENERATED_WRITES)


def names_file(query: Column) -> Column:
    """Whether a query text reads a relation that is a file, not a table: a format and a path after FROM,
    JOIN, TABLE or a comma, outside quoted strings and comments."""
    bare = F.regexp_replace(F.regexp_replace(query, QUOTED, "''"), COMMENTS, " ")
    return bare.rlike(FILE_RELATION)


def is_read_only(query: str) -> bool:
    """Whether a query text has no word that writes, in the query language or in this engine's,
    outside its quoted strings and comments."""
    bare = re.sub(QUOTED, "''", query)
    bare = re.sub(r"/\*.*?\*/|--[^\n]*", " ", bare, flags=re.S)
    return not re.search(WRITES, bare) and not re.search(r"(?i)\b(?:" + "|".join(STATEMENT_WORDS) + r")\b", bare)


def has_name_shape(text: Column) -> Column:
    """A dotted name rather than a sentence."""
    return text.rlike(r"^\w[\w.]*\w$") & text.contains(".")
