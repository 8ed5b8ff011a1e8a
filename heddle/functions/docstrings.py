"""Docstrings of the common styles in one shape, and what of a dotted name is a standard module."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTIONS = {"args": "Args", "arguments": "Args", "parameters": "Args", "params": "Args", "returns": "Returns", "return": "Returns", "yields": "Returns", "raises": "Raises", "raise": "Raises", "except": "Raises"}


def _items(lines: list[str]) -> list[tuple[str, str]]:
    """(name, description) of the entries of a section: 'name (type): text' or, underlined style,
    'name : type' with its text indented below."""
    first = next((x for x in lines if x.strip()), "")
    indent = len(first) - len(first.lstrip())
    out: list[tuple[str, str]] = []
    for x in lines:
        if not x.strip():
            continue
        deep = len(x) - len(x.lstrip()) > indent
        m = re.match(r"([*\w.]+)\s*(?:\([^)]*\))?\s*:\s*(.*)$", x.strip())
        if deep and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {x.strip()}".strip())
        elif m:
            out.append((m[1], m[2].strip()))
        else:
            out.append((x.strip() if re.fullmatch(r"[*\w.]+", x.strip()) else "", "" if re.fullmatch(r"[*\w.]+", x.strip()) else x.strip()))
    return out


def formatted(raw: str | None) -> str:
    """Description, Args, Returns and Raises of a docstring with headed sections, underlined ones or
    fields such as ':param x:'; other texts are a description alone."""
    text = (raw or "").strip()
    if not text:
        return ""
    head: list[str] = []
    parts: dict[str, list[tuple[str, str]]] = {"Args": [], "Returns": [], "Raises": []}
    block: list[str] | None = None
    blocks: list[tuple[str, bool, list[str]]] = []
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        x = lines[i].strip()
        underlined = i + 1 < len(lines) and re.fullmatch(r"-{3,}", lines[i + 1].strip()) is not None
        name = SECTIONS.get(x.rstrip(":").lower())
        if name and (x.endswith(":") or underlined):
            block = []
            blocks.append((name, underlined, block))
            i += 2 if underlined else 1
            continue
        if m := re.match(r":(param|arg|raises?|returns?|type|rtype)\s*(?:[\w.\[\]]+\s+)?([\w.*]*)\s*:\s*(.*)$", x):
            kind = {"p": "Args", "a": "Args"}.get(m[1][0]) or ("Returns" if m[1].startswith("ret") else "Raises" if m[1].startswith("rai") else "")
            if kind:
                parts[kind].append((m[2] if kind != "Returns" else "", m[3].strip()))
            block = None
        elif block is not None and (not x or lines[i][:1].isspace() or blocks[-1][1]):
            block.append(lines[i])
        else:
            block = None
            head.append(x)
        i += 1
    for name, underlined, rows in blocks:
        if name == "Returns":
            said = " ".join(r.strip() for r in rows if r.strip())
            kind = re.match(r"[\w.\[\], |]+:\s*(.*)$", said)
            if underlined:  # the first line is the type
                own = [r for r in rows if r.strip()]
                said = " ".join(r.strip() for r in own[1:]) or said
                kind = None
            parts[name].append(("", kind[1] if kind else said))
        else:
            parts[name] += _items(rows)
    description = "\n".join(head).strip()
    short, _, long = description.partition("\n\n") if "\n\n" in description else description.partition("\n")
    out = [f"Description: {short.strip()}"] if short.strip() else []
    out += [long.strip()] if long.strip() else []
    shown = lambda n, d: f"  {n}: {d}" if n and d else f"  {n}:" if n else f"  {d}"
    if any(n or d for n, d in parts["Args"]):
        out.append("Args:\n" + "\n".join(shown(n, d) for n, d in parts["Args"] if n or d))
    if any(d for _, d in parts["Returns"]):
        out.append("Returns: " + next(d for _, d in parts["Returns"] if d))
    if any(n or d for n, d in parts["Raises"]):
        out.append("Raises:\n" + "\n".join(shown(n, d).removesuffix(":") if not d else shown(n, d) for n, d in parts["Raises"] if n or d))
    return "\n".join(out) or text


@F.pandas_udf(T.StringType())
def formatted_docstring(raw: pd.Series) -> pd.Series:
    return raw.map(lambda t: formatted(t if isinstance(t, str) else None))


def standard_module(name: Column) -> Column:
    """Module part of a dotted name of Python's standard library: all but a last part that is capital,
    or that stands behind a module known to have no submodules; null for other names."""
    parts = F.split(name, r"\.")
    known = F.array(*map(F.lit, sorted(m for m in sys.stdlib_module_names if not m.startswith("_"))))
    packages = F.array(*map(F.lit, STANDARD_PACKAGES))
    n = F.size(parts)
    whole = (n == 1) | (F.array_contains(packages, F.array_join(F.slice(parts, F.lit(1), n), ".")))
    return F.when(F.array_contains(known, parts[0]), F.when(whole, name).otherwise(F.when(F.array_contains(packages, F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), n)), ".")), F.array_join(F.slice(parts, F.lit(1), F.lit(2)), ".")).otherwise(parts[0])))


# Modules of the standard library below others.
STANDARD_PACKAGES = (
    "collections.abc", "concurrent.futures", "email.message", "email.mime", "html.parser", "http.client", "http.server", "importlib.metadata", "importlib.resources", "importlib.util",
    "json.decoder", "json.encoder", "logging.config", "logging.handlers", "multiprocessing.pool", "os.path", "unittest.mock", "urllib.error", "urllib.parse", "urllib.request", "wsgiref.simple_server", "xml.dom", "xml.etree", "xml.sax",
)
