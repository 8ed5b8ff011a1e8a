"""Declarations of source files in other languages, by pattern, to the columns of ``python_source``.

There is no grammar at hand for these languages, so what is read is what their declarations say:
comments and strings are blanked, declarations matched, and bodies found by their braces.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.sources.python_source import ARROW, SCHEMA

#: Languages by the endings of their files.
ENDINGS = {
    "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "ts", "tsx": "ts", "java": "java", "go": "go", "rs": "rust", "lua": "lua",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp", "ixx": "cpp", "cppm": "cpp", "c": "cpp", "cs": "csharp", "php": "php", "scala": "scala",
}

NAME = r"[A-Za-z_$][\w$]*"
KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return", "constructor_", "else", "do", "new", "await", "typeof", "foreach", "using", "lock", "match"}
GENERIC = r"(?:\s*<[^{};()]*>)?"
WORDS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|virtual|override|synchronized|async|readonly|inline|constexpr|extern|default)\s+)"

#: Of each language: kind and pattern, with the groups name, base (extends), face (implements), own (the
#: type that a method is declared outside of) and flags.
SHAPES: dict[str, list[tuple[str, str]]] = {
    "js": [
        ("Class", rf"\bclass\s+(?P<name>{NAME}){GENERIC}(?:\s+extends\s+(?P<base>[\w$.]+))?{GENERIC}(?:\s+implements\s+(?P<face>[\w$.,\s<>]+?))?\s*(?={{)"),
        ("Interface", rf"\binterface\s+(?P<name>{NAME}){GENERIC}(?:\s+extends\s+(?P<base>[\w$.,\s]+?))?\s*(?={{)"),
        ("Enum", rf"\benum\s+(?P<name>{NAME})\s*(?={{)"),
        ("Type", rf"(?m)^\s*(?:export\s+)?type\s+(?P<name>{NAME}){GENERIC}\s*="),
        ("Function", rf"(?P<flags>\basync\s+)?\bfunction\s*(?P<star>\*)?\s*(?P<name>{NAME})\s*{GENERIC}\("),
        ("Function", rf"\b(?:const|let|var)\s+(?P<name>{NAME})\s*(?::[^=;]+)?=\s*(?P<flags>async\s+)?(?:function\s*(?P<star>\*)?\s*\(|(?:\([^()]*\)|{NAME})\s*(?::[^=;{{]+)?=>)"),
        ("Method", rf"\b(?P<own>{NAME})\.prototype\.(?P<name>{NAME})\s*=\s*(?P<flags>async\s+)?function\b"),
        ("Method", rf"(?m)(?:^|[,{{])[ \t]*(?:(?:public|private|protected|static|readonly|override|get|set)\s+)*(?P<flags>async\s+)?(?P<star>\*)?\s*(?P<name>#?{NAME})\s*{GENERIC}\([^;{{}}()]*\)\s*(?::[^;{{}}=]+)?(?={{)"),
        ("Method", rf"(?P<name>{NAME})\s*:\s*(?P<flags>async\s+)?(?:function\s*(?P<star>\*)?\s*\(|\([^()]*\)\s*=>)"),
        ("object", rf"\b(?:const|let|var)\s+(?P<name>{NAME})\s*(?::[^=;]+)?=\s*(?={{)"),
        ("Function", r"\((?P<flags>async\s+)?(?P<iife_func>function)\s*\("),
        ("Function", r"\((?P<flags>async\s+)?(?P<iife_arrow>\([^()]*\)\s*=>)"),
    ],
    "java": [
        ("Class", rf"\b(?:class|record)\s+(?P<name>\w+){GENERIC}(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<base>[\w.]+))?{GENERIC}(?:\s+implements\s+(?P<face>[\w.,\s<>]+?))?\s*(?={{)"),
        ("Interface", rf"\binterface\s+(?P<name>\w+){GENERIC}(?:\s+extends\s+(?P<base>[\w.,\s]+?))?\s*(?={{)"),
        ("Enum", r"\benum\s+(?P<name>\w+)[^{;]*(?={)"),
        ("Method", rf"(?m)^[ \t]*{WORDS}*(?:<[^>]+>\s+)?(?:[\w.]+{GENERIC}(?:\[\])*\s+)?(?P<name>\w+)\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?(?={{)"),
    ],
    "go": [
        ("Method", r"(?m)^func\s+\(\s*\w*\s*\*?(?P<own>\w+)[^)]*\)\s*(?P<name>\w+)\s*\("),
        ("Function", r"(?m)^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\("),
        ("Class", r"(?m)^type\s+(?P<name>\w+)\s+struct\s*(?={)"),
        ("Interface", r"(?m)^type\s+(?P<name>\w+)\s+interface\s*(?={)"),
        ("Type", r"(?m)^type\s+(?P<name>\w+)\s+=?\s*(?!struct\b|interface\b)[\w\[\]*.]+"),
    ],
    "rust": [
        ("impl", rf"\bimpl{GENERIC}\s+(?:(?P<face>[\w:]+){GENERIC}\s+for\s+)?(?P<name>\w+){GENERIC}[^{{;]*(?={{)"),
        ("Class", r"\bstruct\s+(?P<name>\w+)"),
        ("Enum", r"\benum\s+(?P<name>\w+)"),
        ("Union", r"\bunion\s+(?P<name>\w+)\s*(?={)"),
        ("Interface", r"\btrait\s+(?P<name>\w+)"),
        ("Type", r"(?m)^\s*(?:pub\s+)?type\s+(?P<name>\w+)\s*="),
        ("Function", r"(?P<flags>\basync\s+)?\bfn\s+(?P<name>\w+)"),
    ],
    "cpp": [
        ("Class", rf"\b(?:class|struct)\s+(?P<name>\w+)(?:\s+final)?(?:\s*:\s*(?:(?:public|private|protected|virtual)\s+)*(?P<base>[\w:]+){GENERIC}[^{{;]*)?\s*(?={{)"),
        ("Enum", r"\benum\s+(?:class\s+|struct\s+)?(?P<name>\w+)[^{;]*(?={)"),
        ("Union", r"\bunion\s+(?P<name>\w+)\s*(?={)"),
        ("Function", rf"(?m)^[ \t]*(?:export\s+)?{WORDS}*(?:[\w:]+{GENERIC}[\s*&]+)?(?:(?P<own>\w+)::)?(?P<name>~?\w+|operator\s*[^\s\w(]+)\s*\([^;{{}}]*\)\s*(?:const\s*|noexcept\s*|override\s*)*(?={{)"),
    ],
    "lua": [
        ("Function", r"(?m)^\s*(?:local\s+)?function\s+(?:(?P<own>[\w.]+)[.:])?(?P<name>\w+)\s*\("),
        ("Function", r"(?m)^\s*(?:local\s+)?(?:(?P<own>[\w.]+)\.)?(?P<name>\w+)\s*=\s*function\s*\("),
    ],
}
SHAPES["ts"] = SHAPES["js"]
SHAPES["csharp"] = SHAPES["scala"] = SHAPES["java"]
SHAPES["php"] = [*SHAPES["java"], ("Function", r"\bfunction\s+(?P<name>\w+)\s*\(")]

#: Imports: patterns with the groups target, and name, all (a namespace) or names (a list with renames).
IMPORTS: dict[str, list[str]] = {
    "js": [
        rf"\bimport\s+(?:type\s+)?(?P<name>{NAME})?\s*,?\s*(?:\*\s+as\s+(?P<all>{NAME})|\{{(?P<names>[^}}]*)\}})?\s*from\s*['\"](?P<target>[^'\"]+)['\"]",
        rf"\b(?:const|let|var)\s+(?:(?P<all>{NAME})|\{{(?P<names>[^}}]*)\}})\s*=\s*require\(\s*['\"](?P<target>[^'\"]+)['\"]\s*\)",
    ],
    "java": [r"(?m)^\s*(?:import|using|use)\s+(?:static\s+)?(?P<target>[\w.\\]+(?:\.\*)?)\s*;"],
    "go": [r"(?m)^\s*(?:import\s+)?(?:(?P<all>[\w.]+)\s+)?\"(?P<target>[^\"\s]+)\"\s*$"],
    "rust": [r"(?m)^\s*(?:pub\s+)?use\s+(?P<target>[\w:]+(?:::\*)?)(?:\s+as\s+(?P<all>\w+))?\s*;", r"(?m)^\s*(?:pub\s+)?use\s+(?P<target>[\w:]+)::\{(?P<names>[^}]*)\}\s*;"],
    "cpp": [r"(?m)^\s*#\s*include\s*[<\"](?P<target>[^>\"]+)[>\"]", r"(?m)^\s*(?:export\s+)?import\s+(?P<target>[\w.:<>]+)\s*;"],
    "lua": [r"(?m)(?:local\s+(?P<all>\w+)\s*=\s*)?\brequire\s*\(?\s*['\"](?P<target>[^'\"]+)['\"]"],
}
IMPORTS["ts"] = IMPORTS["js"]
IMPORTS["csharp"] = IMPORTS["scala"] = IMPORTS["php"] = IMPORTS["java"]

#: Exports of JavaScript: what a module gives under a name, of its own or from elsewhere.
EXPORTS = [
    rf"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class|const|let|var|enum|interface|type)\s+(?P<name>{NAME})",
    r"\bexport\s*\{(?P<names>[^}]*)\}(?:\s*from\s*['\"](?P<target>[^'\"]+)['\"])?",
    r"\bexport\s*(?P<star>\*)\s*from\s*['\"](?P<target>[^'\"]+)['\"]",
    rf"(?m)\bmodule\.exports\s*=\s*(?:(?P<name>{NAME})\s*;?$|\{{(?P<names>[^}}]*)\}})",
    rf"\b(?:module\.)?exports\.(?P<name>{NAME})\s*=",
]
PROTOTYPE = rf"\b(?P<name>{NAME})\.prototype\s*=\s*(?:Object\.create\(\s*|new\s+)(?P<base>{NAME})"


def blanked(text: str, language: str, strings: bool) -> str:
    """The text with comments, and strings if asked for, as spaces of the same length."""
    comment = r"--\[\[.*?\]\]|--[^\n]*" if language == "lua" else r"//[^\n]*|/\*.*?\*/" + (r"|#[^\n\[][^\n]*" if language == "php" else "")
    string = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'" + (r"|`(?:[^`\\]|\\.)*`" if language in ("js", "ts", "go") else "")
    if language == "rust":
        string = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)'"
    empty = lambda s: re.sub(r"[^\n]", " ", s)
    return re.sub(f"(?s:(?P<c>{comment})|(?P<s>{string}))", lambda m: empty(m[0]) if m["c"] is not None or strings else m[0], text)


def bodies(code: str) -> dict[int, int]:
    """Where each opening brace closes."""
    out, stack = {}, []
    for m in re.finditer("[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def module_of(project: str, path: str) -> str:
    parts = path.rsplit(".", 1)[0].split("/")
    if parts[-1] == "index":
        parts.pop()
    return ".".join([project, *parts])


def imported(project: str, path: str, target: str) -> str:
    """Module that an import names: relative ones by the file's folder, others as they are said."""
    if not target.startswith("."):
        return target.replace("::", ".").replace("\\", ".")
    parts = path.split("/")[:-1]
    for p in target.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p != ".":
            parts.append(re.sub(r"\.(?:[cm]?[jt]sx?)$", "", p))
    return ".".join([project, *[p for p in parts if p != "index"]])


def renamed(names: str) -> list[tuple[str, str]]:
    """(name outside, name here) of a list such as 'a, b as c, d: e'."""
    pairs = [re.split(r"\s+as\s+|\s*:\s*", x.strip()) for x in names.split(",")]
    return [(p[0].removeprefix("type "), p[-1]) for p in pairs if re.fullmatch(rf"{NAME}|self|\*", p[0].removeprefix("type "))]


def facts(project: str, path: str, text: str) -> list[dict]:
    """Rows of one file; none if its language isn't known."""
    language = ENDINGS.get(path.rsplit(".", 1)[-1])
    if language is None:
        return []
    module = module_of(project, path)
    code, said = blanked(text, language, True), blanked(text, language, False)
    close = bodies(code)
    opens = sorted(close)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    row = lambda at: bisect_right(lines, at)
    base = {"path": path, "module": module}
    rows = [{"kind": "Module", "qualified_name": module, "name": module.rsplit(".", 1)[-1], "seq": -1} | base]
    found: dict[int, tuple] = {}  # end of the name: start, end, kind, name, match
    starts: set[int] = set()
    for kind, pattern in SHAPES[language]:
        for m in re.finditer(pattern, code):
            g = m.groupdict()
            iife = next((k for k in ("iife_func", "iife_arrow") if g.get(k)), None)
            at = m.start(iife) if iife else m.start("name")
            name = f"{iife}_{row(at) - 1}_{at - lines[row(at) - 1]}" if iife else g["name"]
            if name in KEYWORDS or at in starts:
                continue
            starts.add(at)
            found.setdefault(m.end() if iife else m.end("name"), (at, m.end(), kind, name, m))
    scopes: list[tuple[int, int, str, str]] = []  # bodies open so far: start, end, name, kind
    for at, end, kind, name, m in sorted(found.values(), key=lambda x: x[0]):
        g = m.groupdict()
        i = bisect_right(opens, end - 1)
        body = opens[i] if i < len(opens) and not re.search(r"[;}]", code[end : opens[i]]) else None
        last = close[body] if body is not None else (code.find("\n", end) if code.find("\n", end) >= 0 else len(code))
        while scopes and scopes[-1][1] <= at:
            scopes.pop()
        owner, owner_kind = next(((q, k) for a, b, q, k in reversed(scopes) if a <= at < b), (module, "Module"))
        in_class = owner_kind in ("Class", "Interface", "Enum", "impl")
        if kind == "Method" and not g.get("own") and language in ("js", "ts") and not in_class and owner_kind != "object":
            continue  # a call with a block, or nothing that is a class's or an object's
        if kind in ("Function", "Method"):
            in_class = in_class or bool(g.get("own"))
            kind = "Method" if in_class or kind == "Method" else "Function"
        if g.get("own"):
            owner = f"{module}.{g['own']}"
        q = f"{owner}.{name}"
        if kind == "impl":
            q = f"{module}.{name}"
            if g.get("face"):
                rows.append({"kind": "implements", "qualified_name": q, "target": g["face"].split("::")[-1], "seq": 0} | base)
        elif kind != "object":
            place = {"start_line": row(at), "end_line": row(last), "col": at - lines[row(at) - 1]}
            rows.append({"kind": kind, "qualified_name": q, "name": name, "parent": owner, "is_async": bool(g.get("flags")), "is_generator": bool(g.get("star")), "seq": len(rows)} | base | place)
            for how, group in (("inherits", "base"), ("implements", "face")):
                for j, x in enumerate(re.split(r"\s*,\s*", re.sub(r"<[^<>]*>", "", g.get(group) or ""))):
                    if x.strip():
                        rows.append({"kind": how, "qualified_name": q, "target": x.strip().split("::")[-1], "seq": j} | base)
        if body is not None:
            scopes.append((body, last, q, kind))
    if language in ("js", "ts"):
        for m in re.finditer(PROTOTYPE, code):
            rows.append({"kind": "inherits", "qualified_name": f"{module}.{m['name']}", "target": m["base"], "seq": 0} | base)
        for pattern in EXPORTS:
            for m in re.finditer(pattern, said):
                g = m.groupdict()
                source = imported(project, path, g["target"]) if g.get("target") else module
                pairs = [("*", "*")] if g.get("star") else renamed(g["names"]) if g.get("names") else [(g["name"], g["name"])] if g.get("name") else []
                rows += [{"kind": "re_export" if g.get("target") else "export", "name": b, "target": source if a == "*" else f"{source}.{a}", "seq": len(rows) + i} | base for i, (a, b) in enumerate(pairs)]
    for pattern in IMPORTS[language]:
        for m in re.finditer(pattern, said):
            g = m.groupdict()
            target = imported(project, path, g["target"])
            if language == "cpp":
                target = g["target"]
            pairs = [(f"{target}.{a}", b) for a, b in renamed(g["names"])] if g.get("names") else []
            pairs += [(f"{target}.default", g["name"])] if g.get("name") else []
            pairs += [(target, g["all"])] if g.get("all") else []
            if not pairs:
                pairs = [(target[:-2], "*")] if target.endswith(".*") else [(target, re.split(r"[./]", target)[-1])]
            rows += [{"kind": "import", "name": b, "target": a, "start_line": row(m.start("target")), "seq": len(rows) + i} | base for i, (a, b) in enumerate(pairs)]
    if language == "cpp":
        for m in re.finditer(r"(?m)^\s*(?P<out>export\s+)?module\s+(?P<name>[\w.:]+)\s*;", code):
            rows.append({"kind": "module_interface" if m["out"] else "module_implementation", "name": m["name"], "target": m["name"], "seq": len(rows)} | base)
    return rows


def parsed(files: DataFrame, project: str, path: str = "path", text: str = "text") -> DataFrame:
    """Declarations of every file of a known language; files are read where they lie, no shuffle: a
    caller whose files lie in few partitions deals them out first (``tables.dealt``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t is not None for r in facts(project, p, t)]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    known = F.element_at(F.split(path, r"\."), -1).isin(*ENDINGS)
    return files.where(known).select(path, text).mapInArrow(run, SCHEMA)
