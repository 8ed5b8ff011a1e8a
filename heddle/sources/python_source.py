"""Python files to symbol tables: definitions, calls, imports, re-exports, rebindings and types.

Other languages are read by their declarations (``other_sources``), to the same columns.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.sources.tables import few

#: One row for each fact; ``kind`` says which columns hold what.
SCHEMA = "kind string, path string, module string, qualified_name string, name string, parent string, target string, start_line int, end_line int, col int, docstring string, decorators array<string>, is_async boolean, is_generator boolean, seq int"
ARROW = pa.schema([(c.split(" ")[0], {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}.get(c.split(" ")[1], pa.list_(pa.string()))) for c in SCHEMA.split(", ")])


def module_name(project: str, path: str) -> str:
    """Dotted name of a file; a package's __init__ is the package."""
    parts = path.removesuffix(".py").split("/")
    if parts[-1] == "__init__":
        parts.pop()
    return ".".join([project, *parts])


def relative_import(module: str, is_package: bool, level: int, target: str | None) -> str:
    """Module that an import with ``level`` dots names."""
    if level == 0:
        return target or ""
    parts = module.split(".")
    base = parts[: len(parts) - level + (1 if is_package else 0)]
    return ".".join(base + ([target] if target else []))


def dotted(node: ast.AST) -> str | None:
    """Name of a plain or dotted expression, ``super().m`` included."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    if isinstance(node, ast.Call) and (head := dotted(node.func)):
        return f"{head}()"
    return None


def annotated(node: ast.AST | None) -> str | None:
    """Class that an annotation names: itself, quoted, or what is optional."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value.split("[")[0].strip() or None
    if isinstance(node, ast.BinOp):  # X | None
        return annotated(node.left)
    if isinstance(node, ast.Subscript):
        return annotated(node.slice) if dotted(node.value) in ("Optional", "typing.Optional") else dotted(node.value)
    said = dotted(node) if node is not None else None
    return said if said and not said.endswith(")") else None


def made(node: ast.AST | None) -> str | None:
    """Class whose constructor a call is, by its name's capital."""
    said = dotted(node.func) if isinstance(node, ast.Call) else None
    return said if said and said.rsplit(".", 1)[-1][:1].isupper() else None


#: Nodes that hold no fact and no node that could.
LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)


def inside(node: ast.AST) -> list[ast.AST]:
    """A node's children in order, without leaves."""
    out = []
    for field in node._fields:
        value = getattr(node, field, None)
        for n in value if isinstance(value, list) else (value,):
            if isinstance(n, ast.AST) and not isinstance(n, LEAVES):
                out.append(n)
    return out


def yields(node: ast.AST) -> bool:
    """Whether a function yields itself, not one within it."""
    left = inside(node)
    while left:
        n = left.pop()
        if isinstance(n, ast.Yield | ast.YieldFrom):
            return True
        if not isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
            left.extend(inside(n))
    return False


class Facts(ast.NodeVisitor):
    """Collects the facts of one file."""

    def __init__(self, project: str, path: str):
        self.path, self.module, self.package = path, module_name(project, path), path.endswith("__init__.py")
        self.rows: list[dict] = []
        self.stack: list[tuple[str, bool]] = [(self.module, False)]
        self.public: set[str] | None = None

    def add(self, kind: str, node: ast.AST | None = None, **values) -> None:
        place = {"start_line": getattr(node, "lineno", None), "end_line": getattr(node, "end_lineno", None), "col": getattr(node, "col_offset", None)} if node is not None else {}
        self.rows.append({"kind": kind, "path": self.path, "module": self.module, "seq": len(self.rows)} | place | values)

    def generic_visit(self, node: ast.AST) -> None:
        for n in inside(node):
            self.visit(n)

    def define(self, node, kind: str) -> None:
        owner, in_class = self.stack[-1]
        name = f"{owner}.{node.name}"
        self.add("Method" if in_class and kind == "Function" else kind, node, qualified_name=name, name=node.name, parent=owner, docstring=ast.get_docstring(node), decorators=[d for d in map(lambda d: dotted(d.func if isinstance(d, ast.Call) else d), node.decorator_list) if d], is_async=isinstance(node, ast.AsyncFunctionDef), is_generator=not isinstance(node, ast.ClassDef) and yields(node))
        if isinstance(node, ast.ClassDef):
            for i, base in enumerate(node.bases):
                if said := dotted(base.value if isinstance(base, ast.Subscript) else base):
                    self.rows.append({"kind": "inherits", "path": self.path, "module": self.module, "qualified_name": name, "target": said, "seq": i})
        self.stack.append((name, isinstance(node, ast.ClassDef)))
        if not isinstance(node, ast.ClassDef):
            for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
                self.typed(a.arg, annotated(a.annotation))
            given = annotated(node.returns) or next((c for n in ast.walk(node) if isinstance(n, ast.Return) and (c := made(n.value))), None)
            if given:
                self.rows.append({"kind": "returns", "path": self.path, "module": self.module, "qualified_name": name, "target": given, "seq": len(self.rows)})
        self.generic_visit(node)
        self.stack.pop()

    def typed(self, variable: str, cls: str | None) -> None:
        if cls:
            self.rows.append({"kind": "type", "path": self.path, "module": self.module, "qualified_name": self.stack[-1][0], "name": variable, "target": cls, "seq": len(self.rows)})

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = {dotted(b) for b in node.bases}
        self.define(node, "Enum" if bases & {"Enum", "IntEnum", "StrEnum", "Flag", "enum.Enum", "enum.IntEnum", "enum.StrEnum"} else "Interface" if bases & {"Protocol", "typing.Protocol"} else "Class")

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self.define(node, "Function")

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:
        self.define(node, "Function")

    def visit_Call(self, node: ast.Call) -> None:
        if said := dotted(node.func):
            cls = next((n for n, is_class in reversed(self.stack) if is_class), None)
            self.add("call", node, qualified_name=self.stack[-1][0], name=said, parent=cls)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", node, name=a.asname or a.name.split(".")[0], target=a.name if a.asname else a.name.split(".")[0])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = relative_import(self.module, self.package, node.level, node.module)
        for a in node.names:
            self.add("import", node, name="*" if a.name == "*" else a.asname or a.name, target=base if a.name == "*" else f"{base}.{a.name}")
            if self.package and len(self.stack) == 1:
                self.add("re_export", node, name="*" if a.name == "*" else a.asname or a.name, target=base if a.name == "*" else f"{base}.{a.name}")

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if isinstance(node.target, ast.Name):
            self.typed(node.target.id, annotated(node.annotation))
        self.generic_visit(node)

    def visit_With(self, node: ast.With) -> None:
        for item in node.items:
            if isinstance(item.optional_vars, ast.Name):
                self.typed(item.optional_vars.id, made(item.context_expr))
        self.generic_visit(node)

    def visit_For(self, node: ast.For) -> None:
        if isinstance(node.target, ast.Name) and isinstance(node.iter, ast.List | ast.Tuple):
            kinds = {made(e) for e in node.iter.elts}
            if len(kinds) == 1:
                self.typed(node.target.id, kinds.pop())
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            if isinstance(t, ast.Name):
                self.typed(t.id, made(node.value))
        if len(self.stack) == 1:
            for t in node.targets:
                if isinstance(t, ast.Name) and t.id == "__all__" and isinstance(node.value, ast.List | ast.Tuple):
                    self.public = {e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
                elif isinstance(t, ast.Attribute) and (a := dotted(t)) and (b := dotted(node.value)):
                    self.add("rebind", node, name=a, target=b)
        self.generic_visit(node)


def facts(project: str, path: str, text: str) -> list[dict]:
    """Rows of one file; one of kind ``error`` if it can't be parsed."""
    f = Facts(project, path)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"kind": "error", "path": path, "module": f.module, "name": type(e).__name__, "seq": 0}]
    f.visit(tree)
    if f.public is not None:
        f.rows = [r for r in f.rows if r["kind"] != "re_export" or r["name"] == "*" or r["name"] in f.public]
    names = sorted(f.public) if f.public is not None else [n.name for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and not n.name.startswith("_")]
    return [{"kind": "Module", "path": path, "module": f.module, "qualified_name": f.module, "name": f.module.rsplit(".", 1)[-1], "docstring": ast.get_docstring(tree), "decorators": names, "seq": -1}, *f.rows]


def parsed(files: DataFrame, project: str, path: str = "path", text: str = "text", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Facts of every Python file, or those of some kinds; files are parsed where they lie, no shuffle: a
    caller whose files lie in few partitions deals them out first (``tables.dealt``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t is not None for r in facts(project, p, t) if kinds is None or r["kind"] in kinds]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return files.where(F.col(path).endswith(".py")).select(path, text).mapInArrow(run, SCHEMA)


def symbols(rows: DataFrame) -> DataFrame:
    """qualified_name, name, module, class, as ``resolve.resolved`` takes them."""
    own = F.when(F.col("kind") == "Method", F.col("parent"))
    return rows.where(F.col("kind").isin("Function", "Method", "Class", "Interface", "Enum")).select("qualified_name", "name", "module", own.alias("class"))


def calls(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'call'").select(F.col("qualified_name").alias("caller"), "module", F.col("parent").alias("class"), F.col("name").alias("call_name"), F.col("start_line").alias("line"), "col")


def imports(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'import'").select("module", F.col("name").alias("alias"), "target")


def exports(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 're_export'").select("module", F.col("name").alias("symbol"), "target")


def _classes(rows: DataFrame, kind: str) -> DataFrame:
    """Facts of a kind with the qualified name of the class they name: imported, or the module's own."""
    own = rows.where(F.col("kind") == kind).select("qualified_name", "name", "module", "target", F.split("target", r"\.")[0].alias("_head"))
    named = few(imports(rows).where("alias <> '*'").select(F.col("module").alias("_m"), F.col("alias").alias("_a"), F.col("target").alias("_t")))
    both = own.join(named, (F.col("module") == F.col("_m")) & (F.col("_head") == F.col("_a")), "left")
    rest = F.expr("substring(target, length(_head) + 1)")
    return both.select("qualified_name", "name", F.when(F.col("_t").isNotNull(), F.concat("_t", rest)).otherwise(F.concat_ws(".", "module", "target")).alias("class"))


def local_types(rows: DataFrame) -> DataFrame:
    """caller, variable, class of parameters, assignments, with and for targets whose class is said."""
    return _classes(rows, "type").select(F.col("qualified_name").alias("caller"), F.col("name").alias("variable"), "class").distinct()


def returned(rows: DataFrame) -> DataFrame:
    """qualified_name, class: what functions give, and classes, whose constructors give themselves."""
    itself = rows.where(F.col("kind").isin("Class", "Interface", "Enum")).select("qualified_name", F.col("qualified_name").alias("class"))
    return _classes(rows, "returns").select("qualified_name", "class").unionByName(itself).distinct()


def inheritance(rows: DataFrame) -> DataFrame:
    """class, parent, position: INHERITS edges between classes that are known; names are resolved by
    imports, then in the class's module."""
    named = rows.where("kind = 'inherits'").withColumn("name", F.col("seq").cast("string"))
    known = few(symbols(rows).select(F.col("qualified_name").alias("parent")))
    both = _classes(named.unionByName(rows.where("kind = 'import'")), "inherits")
    return both.select(F.col("qualified_name").alias("class"), F.col("class").alias("parent"), F.col("name").cast("int").alias("position")).join(known, "parent", "left_semi").select("class", "parent", "position")


def rebindings(rows: DataFrame) -> DataFrame:
    """original, target, seq of module-level assignments to attributes, with names resolved as classes are."""
    keyed = rows.where("kind = 'rebind'").select("module", "seq", "name", "target")
    named = few(imports(rows).where("alias <> '*'").select(F.col("module").alias("_m"), F.col("alias").alias("_a"), F.col("target").alias("_t")))

    def full(df: DataFrame, c: str) -> DataFrame:
        head = F.split(c, r"\.")[0]
        both = df.join(named, (F.col("module") == F.col("_m")) & (head == F.col("_a")), "left")
        rest = F.expr(f"substring({c}, length(split({c}, '\\\\.')[0]) + 1)")
        return both.withColumn(c, F.when(F.col("_t").isNotNull(), F.concat("_t", rest)).otherwise(F.concat_ws(".", "module", c))).drop("_m", "_a", "_t")

    return full(full(keyed, "name"), "target").select(F.col("name").alias("original"), "target", "seq")


def structure(paths: DataFrame, project: str, path: str = "path") -> DataFrame:
    """CONTAINS edges from every folder to what lies in it; a folder with __init__.py is a package."""
    parts = F.split(F.col(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("parent"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), (i == F.size(parts)).alias("is_file")))
    rows = paths.select(F.explode(up).alias("e")).select("e.*").distinct()
    packages = paths.where(F.col(path).endswith("/__init__.py")).select(F.regexp_replace(path, "/__init__.py$", "").alias("_p")).distinct()
    named = rows.join(packages, rows["path"] == packages["_p"], "left")
    label = F.when(F.col("is_file"), "File").when(F.col("_p").isNotNull(), "Package").otherwise("Folder")
    return named.select(F.concat(F.lit("CONTAINS_"), F.upper(label)).alias("rel"), F.when(F.col("parent") == "", project).otherwise(F.col("parent")).alias("src"), F.col("path").alias("dst"), label.alias("label"))
