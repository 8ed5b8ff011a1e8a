"""Queries on source files, made of the parts: what readers find in them, and how names are resolved."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import docstrings
from heddle.functions import text as T
from heddle.operators import chunks, incremental, rank, resolve
from heddle.plans.registry import Registry, quoted, sql_array, table
from heddle.sources import manifests, other_sources, python_source
from heddle.sources.tables import dealt, settled

R = Registry()

PYTHON = '''"""Doc of {k}."""
from . import base
from ..pkg0.m0 import f0 as g
import os.path as p


class C{k}(base.B, Other):
    """Class {k}."""

    @staticmethod
    def s(x: Other) -> "C{k}":
        x.go()
        return C{k}()

    async def a(self):
        self.s(1)
        yield super().a()


def f{k}(y):
    c = C{k}()
    c.s(y).a()
    for z in [C{k}(), C{k}()]:
        z.s(y)
    return g(p.join(y))


class Other:
    def go(self): pass


base.B.old = f{k}
'''
INIT = "from .m{k} import C{k}, f{k} as renamed\nfrom .base import *\n__all__ = ['C{k}']\n"


def filled(template: str, key):
    """The template with a key in the places {k}."""
    return F.replace(F.lit(template), F.lit("{k}"), key.cast("string"))


def python_files(spark, sf_dir):
    k = F.col("p_partkey")
    folder = F.concat(F.lit("pkg"), (F.col("p_size") % 5).cast("string"))
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    files = p.select(F.concat(folder, F.lit("/m"), k.cast("string"), F.lit(".py")).alias("path"), filled(PYTHON, k).alias("text"))
    first = table(spark, sf_dir, "part").groupBy(folder.alias("f")).agg(F.min("p_partkey").alias("k"))
    inits = first.select(F.concat("f", F.lit("/__init__.py")).alias("path"), filled(INIT, F.col("k")).alias("text"))
    return files.unionByName(inits)


MODULES = "m AS MATERIALIZED (SELECT p_partkey AS k, 'pkg' || (p_size % 5) AS f, 'proj.pkg' || (p_size % 5) || '.m' || p_partkey AS m FROM part)"


@R.query(f"""WITH {MODULES}
SELECT 'Class' AS kind, m || '.C' || k AS qualified_name, m AS parent, 7 AS start_line, 17 AS end_line, 'Class ' || k || '.' AS docstring, '' AS decorators, false AS is_async, false AS is_generator FROM m
UNION ALL SELECT 'Method', m || '.C' || k || '.s', m || '.C' || k, 11, 13, NULL, 'staticmethod', false, false FROM m
UNION ALL SELECT 'Method', m || '.C' || k || '.a', m || '.C' || k, 15, 17, NULL, '', true, true FROM m
UNION ALL SELECT 'Function', m || '.f' || k, m, 20, 25, NULL, '', false, false FROM m UNION ALL SELECT 'Class', m || '.Other', m, 28, 29, NULL, '', false, false FROM m
UNION ALL SELECT 'Method', m || '.Other.go', m || '.Other', 29, 29, NULL, '', false, false FROM m
UNION ALL SELECT 'Module', m, NULL, 0, 0, 'Doc of ' || k || '.', 'C' || k || ',f' || k || ',Other', false, false FROM m
UNION ALL SELECT 'Module', 'proj.' || f, NULL, 0, 0, NULL, 'C' || min(k), false, false FROM m GROUP BY f""")
def q_python_symbols(spark, sf_dir):
    rows = python_source.parsed(python_files(spark, sf_dir), "proj", kinds=("Class", "Method", "Function", "Module"))
    return rows.select("kind", "qualified_name", "parent", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), "docstring", F.array_join("decorators", ",").alias("decorators"), F.coalesce("is_async", F.lit(False)).alias("is_async"), F.coalesce("is_generator", F.lit(False)).alias("is_generator"))


@R.query(f"""WITH {MODULES} SELECT m AS module, unnest(['base', 'g', 'p']) AS name, unnest(['proj.' || f || '.base', 'proj.pkg0.m0.f0', 'os.path']) AS target, 'import' AS kind FROM m
UNION ALL SELECT 'proj.' || f, unnest(['C' || k, 'renamed', '*', 'C' || k, '*']),
unnest(['proj.' || f || '.m' || k || '.C' || k, 'proj.' || f || '.m' || k || '.f' || k, 'proj.' || f || '.base', 'proj.' || f || '.m' || k || '.C' || k, 'proj.' || f || '.base']),
unnest(['import', 'import', 'import', 're_export', 're_export']) FROM (SELECT f, min(k) AS k FROM m GROUP BY f)""")
def q_python_imports(spark, sf_dir):
    rows = settled(python_source.parsed(python_files(spark, sf_dir), "proj", kinds=("import", "re_export")))
    a = python_source.imports(rows).select("module", F.col("alias").alias("name"), "target", F.lit("import").alias("kind"))
    return a.unionByName(python_source.exports(rows).select("module", F.col("symbol").alias("name"), "target", F.lit("re_export").alias("kind")))


@R.query(f"""WITH {MODULES} SELECT m || c[1] AS caller, replace(c[2], '#', CAST(k AS VARCHAR)) AS call_name, CAST(c[3] AS INTEGER) AS line, CASE WHEN c[4] = '' THEN NULL ELSE m || '.C' || k END AS class
FROM (SELECT k, m, unnest([['.C' || k || '.s', 'x.go', '12', 'c'], ['.C' || k || '.s', 'C#', '13', 'c'], ['.C' || k || '.a', 'self.s', '16', 'c'], ['.C' || k || '.a', 'super().a', '17', 'c'], ['.C' || k || '.a', 'super', '17', 'c'],
['.f' || k, 'C#', '21', ''], ['.f' || k, 'c.s().a', '22', ''], ['.f' || k, 'c.s', '22', ''], ['.f' || k, 'C#', '23', ''], ['.f' || k, 'C#', '23', ''], ['.f' || k, 'z.s', '24', ''], ['.f' || k, 'g', '25', ''], ['.f' || k, 'p.join', '25', '']]) AS c FROM m)""")
def q_python_calls(spark, sf_dir):
    return python_source.calls(python_source.parsed(python_files(spark, sf_dir), "proj", kinds=("call",))).select("caller", "call_name", "line", "class")


@R.query(f"""WITH {MODULES} SELECT m || '.C' || k || '.s' AS caller, 'x' AS variable, m || '.Other' AS class FROM m UNION ALL SELECT m || '.f' || k, unnest(['c', 'z']), m || '.C' || k FROM m
UNION ALL SELECT 'returns', m || '.C' || k || '.s', m || '.C' || k FROM m UNION ALL SELECT 'returns', m || '.C' || k, m || '.C' || k FROM m
UNION ALL SELECT 'returns', m || '.Other', m || '.Other' FROM m""")
def q_python_types(spark, sf_dir):
    rows = settled(python_source.parsed(python_files(spark, sf_dir), "proj", kinds=("type", "returns", "import", "Class", "Interface", "Enum")))
    gives = python_source.returned(rows).select(F.lit("returns").alias("caller"), F.col("qualified_name").alias("variable"), "class")
    return python_source.local_types(rows).unionByName(gives)


@R.query(f"""WITH {MODULES} SELECT 'inherits' AS kind, m || '.C' || k AS a, m || '.Other' AS b FROM m UNION ALL SELECT 'rebind', 'proj.' || f || '.base.B.old', m || '.f' || k FROM m""")
def q_python_relations(spark, sf_dir):
    rows = settled(python_source.parsed(python_files(spark, sf_dir), "proj", kinds=("inherits", "rebind", "import", "Function", "Method", "Class", "Interface", "Enum")))
    a = python_source.inheritance(rows).select(F.lit("inherits").alias("kind"), F.col("class").alias("a"), F.col("parent").alias("b"))
    return a.unionByName(python_source.rebindings(rows).select(F.lit("rebind").alias("kind"), F.col("original").alias("a"), F.col("target").alias("b")))


OTHER = {
    "ts": "import A, {b as c} from './x.js';\nexport class D{k} extends Base implements Pet {\n  async bark(n: number) { if (n) { go(); } }\n}\nconst add{k} = (a, b) => a + b;\nCat.prototype.meow = function () {};\nCat.prototype = Object.create(D{k}.prototype);\nconst o = {\n  fly{k}: () => 1,\n};\nexport { c as plus } from '../z';\nmodule.exports = { add{k} };\n(function () { })();\n",
    "go": 'package m\nimport (\n\t"fmt"\n)\ntype T{k} struct {\n a int\n}\nfunc (t *T{k}) Run(x int) error {\n return nil\n}\nfunc Free{k}() {}\n',
    "rs": "use a::b::{C, D as E};\nstruct S{k} { x: i32 }\ntrait Tr { fn f(&self); }\nimpl Tr for S{k} {\n    async fn f(&self) {}\n}\n",
    "java": "import a.b.C;\npublic class J{k} extends E implements F, G<H> {\n  public int m(int a) throws X { return 1; }\n}\n",
    "cpp": "#include <v>\nexport module m.n{k};\nclass A{k} : public B {\n  int f() { return 1; }\n};\nvoid A{k}::g(int x) {\n}\n",
    "lua": 'local m = require("a.b")\nfunction M.f{k}(x)\nend\nM.h = function(a) end\n',
}
# kind, qualified name below the module, name, target; # is the key, ^ the module
FOUND = {
    "ts": [("Class", ".D#", "D#", ""), ("inherits", ".D#", "", "Base"), ("implements", ".D#", "", "Pet"), ("Method", ".D#.bark", "bark", ""), ("Function", ".add#", "add#", ""), ("Method", ".Cat.meow", "meow", ""), ("inherits", ".Cat", "", "D#"), ("Method", ".o.fly#", "fly#", ""),
           ("Function", ".iife_func_12_1", "iife_func_12_1", ""), ("export", "", "D#", "^.D#"), ("export", "", "add#", "^.add#"), ("re_export", "", "plus", "proj.z.c"), ("import", "", "c", "proj.s.x.b"), ("import", "", "A", "proj.s.x.default")],
    "go": [("Class", ".T#", "T#", ""), ("Method", ".T#.Run", "Run", ""), ("Function", ".Free#", "Free#", ""), ("import", "", "fmt", "fmt")],
    "rs": [("Class", ".S#", "S#", ""), ("Interface", ".Tr", "Tr", ""), ("Method", ".Tr.f", "f", ""), ("implements", ".S#", "", "Tr"), ("Method", ".S#.f", "f", ""), ("import", "", "C", "a.b.C"), ("import", "", "E", "a.b.D")],
    "java": [("Class", ".J#", "J#", ""), ("inherits", ".J#", "", "E"), ("implements", ".J#", "", "F"), ("implements", ".J#", "", "G"), ("Method", ".J#.m", "m", ""), ("import", "", "C", "a.b.C")],
    "cpp": [("Class", ".A#", "A#", ""), ("inherits", ".A#", "", "B"), ("Method", ".A#.f", "f", ""), ("Method", ".A#.g", "g", ""), ("import", "", "v", "v"), ("module_interface", "", "m.n#", "m.n#")],
    "lua": [("Method", ".M.f#", "f#", ""), ("Method", ".M.h", "h", ""), ("import", "", "m", "a.b")],
}


def other_files(spark, sf_dir):
    k = F.col("p_partkey")
    language = F.get(F.array(*map(F.lit, OTHER)), (k % len(OTHER)).cast("int"))
    text = F.lit(None).cast("string")
    for ending, template in OTHER.items():
        text = F.when(F.col("e") == ending, filled(template, k)).otherwise(text)
    p = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").withColumn("e", language)
    return p.select(F.concat(F.lit("s/m"), k.cast("string"), F.lit("."), "e").alias("path"), text.alias("text"))


@R.query("WITH p AS (SELECT p_partkey AS k, 'proj.s.m' || p_partkey AS m, " + sql_array(OTHER) + f"[1 + p_partkey % {len(OTHER)}] AS e FROM part), f AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(e)}, {', '.join(quoted(x) for x in row)})" for e, rows in FOUND.items() for row in rows) + """) t(e, kind, q, name, target))
SELECT kind, CASE WHEN q = '' THEN '' ELSE m || replace(q, '#', CAST(k AS VARCHAR)) END AS qualified_name, replace(name, '#', CAST(k AS VARCHAR)) AS name, replace(replace(target, '#', CAST(k AS VARCHAR)), '^', m) AS target FROM p JOIN f USING (e)
UNION ALL SELECT 'Module', m, 'm' || k, '' FROM p""")
def q_other_languages(spark, sf_dir):
    rows = other_sources.parsed(other_files(spark, sf_dir), "proj")
    said = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("kind", said("qualified_name"), said("name"), said("target"))


DOC = "CASE p_partkey % 4 WHEN 0 THEN 'Make ' || p_name || '.' || chr(10) || chr(10) || 'Longer text.' || chr(10) || chr(10) || 'Args:' || chr(10) || '    a (int): the ' || p_brand || chr(10) || '        goes on.' || chr(10) || '    b: other' || chr(10) || 'Returns:' || chr(10) || '    str: the name' || chr(10) || 'Raises:' || chr(10) || '    ValueError: if not.' WHEN 1 THEN p_name WHEN 2 THEN '  ' ELSE 'Do ' || p_name || '.' || chr(10) || chr(10) || ':param x: first' || chr(10) || ':returns: nothing' || chr(10) || ':raises KeyError: never' END"


@R.query("""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Description: Make ' || p_name || '.' || chr(10) || 'Longer text.' || chr(10) || 'Args:' || chr(10) || '  a: the ' || p_brand || ' goes on.' || chr(10) || '  b: other' || chr(10) || 'Returns: the name' || chr(10) || 'Raises:' || chr(10) || '  ValueError: if not.'
WHEN 1 THEN 'Description: ' || p_name WHEN 2 THEN '' ELSE 'Description: Do ' || p_name || '.' || chr(10) || 'Args:' || chr(10) || '  x: first' || chr(10) || 'Returns: nothing' || chr(10) || 'Raises:' || chr(10) || '  KeyError: never' END AS text FROM part""")
def q_docstrings(spark, sf_dir):
    doc = F.expr(DOC)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), docstrings.formatted_docstring(doc).alias("text"))


NAMES = {"os.path.join": "os.path", "json.loads": "json", "collections.OrderedDict": "collections", "urllib.parse.quote": "urllib.parse", "sys": "sys", "numpy.array": None, "logging.handlers": "logging.handlers", "re.sub": "re"}


@R.query(f"SELECT event_id, n AS name, MAP {{{', '.join(f'{quoted(a)}: {quoted(b)}' for a, b in NAMES.items() if b)}}}[n] AS module FROM (SELECT event_id, {sql_array(NAMES)}[1 + event_id % {len(NAMES)}] AS n FROM events)")
def q_standard_modules(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", name.alias("name"), docstrings.standard_module(name).alias("module"))


@R.query("""WITH s AS (SELECT p_partkey AS k, md5(p_name) AS h FROM part WHERE p_size > 20),
n AS (SELECT p_partkey AS k, CASE WHEN p_brand = 'Brand#3' THEN md5(p_name || '!') ELSE md5(p_name) END AS h, p_name FROM part)
SELECT n.k, CASE WHEN s.h = n.h THEN 'kept' ELSE 'card of ' || p_name END AS card FROM n LEFT JOIN s USING (k)""")
def q_cards(spark, sf_dir):
    """Cards written anew only where a symbol's source has changed."""
    p = table(spark, sf_dir, "part")
    stored = p.where("p_size > 20").select(F.col("p_partkey").alias("k"), F.md5("p_name").alias("content_hash"), F.lit("kept").alias("card"))
    now = p.select(F.col("p_partkey").alias("k"), F.md5(F.when(F.col("p_brand") == "Brand#3", F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))).alias("content_hash"), "p_name")
    return incremental.described(now, stored, "k", "card", F.concat(F.lit("card of "), "p_name")).select("k", "card")


# --- resolution -----------------------------------------------------------------------------------------

# Symbols: f<k % 40> of modules p.a<size>, methods m<k % 7> of classes C<k % 3> in them.
SYMBOLS_SQL = """s AS MATERIALIZED (SELECT DISTINCT q, n, m, c FROM (SELECT 'p.a' || p_size || '.f' || (p_partkey % 40) AS q, 'f' || (p_partkey % 40) AS n, 'p.a' || p_size AS m, NULL AS c FROM part
UNION ALL SELECT 'p.a' || p_size || '.C' || (p_partkey % 3) || '.m' || (p_partkey % 7), 'm' || (p_partkey % 7), 'p.a' || p_size, 'p.a' || p_size || '.C' || (p_partkey % 3) FROM part))"""
# Calls: one for each order, of eight kinds.
CALLS_SQL = """c AS MATERIALIZED (SELECT o_orderkey AS id, 'p.a' || (1 + o_custkey % 50) AS m, 'p.a' || (1 + o_custkey % 50) || '.C' || (o_orderkey % 3) AS c, o_custkey % 50 AS s, 'f' || (o_orderkey % 55) AS f, 'm' || (o_orderkey % 9) AS t,
CASE o_orderkey % 9 WHEN 0 THEN 'f' || (o_orderkey % 55) WHEN 1 THEN 'self.m' || (o_orderkey % 9) WHEN 2 THEN 'alias' WHEN 3 THEN 'mod.f' || (o_orderkey % 55) WHEN 4 THEN 'super().m' || (o_orderkey % 9) WHEN 5 THEN 'v.m' || (o_orderkey % 9) WHEN 6 THEN 'C1().m' || (o_orderkey % 9) WHEN 7 THEN 'print' ELSE 'wild' || (o_orderkey % 5) END AS n FROM orders)"""


@R.query(f"""WITH {SYMBOLS_SQL}, {CALLS_SQL},
imp AS (SELECT DISTINCT m, 'alias' AS a, 'p.a' || (1 + (s + 7) % 50) || '.f' || (s % 45) AS t FROM c UNION SELECT DISTINCT m, 'mod', 'p.a' || (1 + (s + 3) % 50) FROM c),
star AS (SELECT DISTINCT m, 'p.a' || (1 + (s + 11) % 50) AS t FROM c),
par AS (SELECT DISTINCT m || '.C0' AS k, m || '.C1' AS p FROM s UNION SELECT DISTINCT m || '.C1', m || '.C2' FROM s),
anc AS (SELECT k, p AS a, 1 AS d FROM par UNION ALL SELECT x.k, y.p, 2 FROM par x JOIN par y ON y.k = x.p),
leg AS (SELECT id, s.q, 2 AS r, 'exact' AS via, 1.0 AS conf, d FROM c JOIN anc ON anc.k = c.c JOIN s ON s.c = anc.a AND s.n = c.t WHERE c.n LIKE 'super%'
UNION ALL SELECT id, s.q, 3, 'exact', 1.0, 0 FROM c JOIN imp ON imp.m = c.m AND imp.a = c.n JOIN s ON s.q = imp.t
UNION ALL SELECT id, s.q, 4, 'exact', 1.0, 0 FROM c JOIN s ON s.c = c.c AND s.n = c.t WHERE c.n LIKE 'self.%'
UNION ALL SELECT id, s.q, 4, 'exact', 1.0, 0 FROM c JOIN imp ON imp.m = c.m AND imp.a = 'mod' JOIN s ON s.q = imp.t || '.' || c.f WHERE c.n LIKE 'mod.%'
UNION ALL SELECT id, s.q, 4, 'exact', 1.0, 0 FROM c JOIN s ON s.c = c.m || '.C2' AND s.n = c.t WHERE c.n LIKE 'v.%'
UNION ALL SELECT id, s.q, 5, 'wildcard', 0.5, 0 FROM c JOIN star ON star.m = c.m JOIN s ON s.m = star.t AND s.n = c.n
UNION ALL SELECT id, s.q, 6, 'exact', 1.0, 0 FROM c JOIN s ON s.m = c.m AND s.n = c.n AND s.c IS NULL
UNION ALL SELECT id, s.q, 7, 'heuristic', 0.6, 0 FROM c JOIN s ON s.c = c.m || '.C1' AND s.n = c.t WHERE c.n LIKE 'C1().%'),
near AS (SELECT id, s.q, 8 AS r, 'heuristic' AS via, 0.6 AS conf, len(string_split(s.q, '.')) - CASE WHEN s.m = c.m THEN 2 ELSE 1 END - 1 AS d FROM c
JOIN s ON s.n = string_split(c.n, '.')[-1] WHERE id NOT IN (SELECT id FROM leg)),
al AS (SELECT * FROM leg UNION ALL SELECT * FROM near UNION ALL SELECT id, 'builtins.print', 9, 'exact', 1.0, 0 FROM c WHERE n = 'print'),
best AS (SELECT id, q, via, conf FROM al QUALIFY row_number() OVER (PARTITION BY id ORDER BY r, conf DESC, d, q) = 1),
reb AS (SELECT DISTINCT q AS o, m || '.f0' AS n FROM s WHERE n = 'm3' AND c LIKE '%C1')
SELECT c.id, c.n AS call_name, coalesce(reb.n, best.q) AS callee, CASE WHEN reb.n IS NOT NULL THEN 'rebound' ELSE via END AS resolved_via, CAST(conf AS DOUBLE) AS confidence FROM c
LEFT JOIN best USING (id) LEFT JOIN reb ON reb.o = best.q""")
def q_resolve(spark, sf_dir):
    s = lambda x: x.cast("string")
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    home = F.concat(F.lit("p.a"), s(F.col("p_size")))
    plain = part.select(home.alias("module"), F.concat(F.lit("f"), s(k % 40)).alias("name"), F.lit(None).cast("string").alias("class"))
    own = part.select(home.alias("module"), F.concat(F.lit("m"), s(k % 7)).alias("name"), F.concat(home, F.lit(".C"), s(k % 3)).alias("class"))
    symbols = plain.unionByName(own).withColumn("qualified_name", F.concat_ws(".", F.coalesce("class", "module"), "name")).distinct()
    o, c = F.col("o_orderkey"), F.col("o_custkey") % 50
    module = F.concat(F.lit("p.a"), s(1 + c))
    f, m = F.concat(F.lit("f"), s(o % 55)), F.concat(F.lit("m"), s(o % 9))
    said = [f, F.concat(F.lit("self."), m), F.lit("alias"), F.concat(F.lit("mod."), f), F.concat(F.lit("super()."), m), F.concat(F.lit("v."), m), F.concat(F.lit("C1()."), m), F.lit("print"), F.concat(F.lit("wild"), s(o % 5))]
    orders = table(spark, sf_dir, "orders").withColumn("_s", c)
    calls = orders.select(o.alias("id"), F.concat(module, F.lit(".run")).alias("caller"), module.alias("module"), F.concat(module, F.lit(".C"), s(o % 3)).alias("class"), F.get(F.array(*said), (o % 9).cast("int")).alias("call_name"), o.cast("int").alias("line"), F.lit(0).alias("col"))
    there = lambda n: F.concat(F.lit("p.a"), s(1 + (F.col("_s") + n) % 50))
    modules = orders.select(module.alias("module"), "_s").distinct()
    imports = modules.select("module", F.lit("alias").alias("alias"), F.concat(there(7), F.lit(".f"), s(F.col("_s") % 45)).alias("target"))
    imports = imports.unionByName(modules.select("module", F.lit("mod").alias("alias"), there(3).alias("target"))).unionByName(modules.select("module", F.lit("*").alias("alias"), there(11).alias("target")))
    types = modules.select(F.concat("module", F.lit(".run")).alias("caller"), F.lit("v").alias("variable"), F.concat("module", F.lit(".C2")).alias("class"))
    returns = modules.select(F.concat("module", F.lit(".C1")).alias("qualified_name"), F.concat("module", F.lit(".C1")).alias("class"))
    homes = symbols.select("module").distinct()
    parents = homes.select(F.explode(F.array(*[F.struct(F.concat("module", F.lit(f".C{i}")).alias("class"), F.concat("module", F.lit(f".C{i + 1}")).alias("parent"), F.lit(0).alias("position")) for i in range(2)])).alias("x")).select("x.*")
    exports = spark.createDataFrame([], "module string, symbol string, target string")
    rebinds = symbols.where("name = 'm3' AND class LIKE '%C1'").select(F.col("qualified_name").alias("original"), F.concat("module", F.lit(".f0")).alias("target"), F.lit(1).alias("seq"))
    builtins = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("print").alias("name"))
    out = resolve.resolved(calls, symbols, imports, exports, rebinds, builtins, parents, types, returns)
    return out.select("id", "call_name", "callee", "resolved_via", "confidence")


@R.query("""WITH RECURSIVE x AS (SELECT 'pkg' || p_partkey AS m, CASE WHEN p_partkey % 4 = 0 THEN '*' ELSE 'h' END AS s, CASE WHEN p_partkey % 4 = 0 THEN 'pkg' || (p_partkey // 2) ELSE 'pkg' || (p_partkey // 3) || '.h' END AS t FROM part WHERE p_partkey > 0), k AS (SELECT 'pkg' || p_partkey || '.h' AS q FROM part WHERE p_size % 9 = 0 OR p_partkey < 2),
r AS (SELECT m || '.h' AS start, m || '.h' AS now, [m || '.h'] AS path, false AS wild, 0 AS hops FROM x UNION ALL
SELECT r.start, CASE WHEN x.s = '*' THEN x.t || '.h' ELSE x.t END, list_append(r.path, CASE WHEN x.s = '*' THEN x.t || '.h' ELSE x.t END), r.wild OR x.s = '*', r.hops + 1 FROM r
JOIN x ON x.m || '.h' = r.now WHERE r.hops < 16 AND NOT list_contains(r.path, CASE WHEN x.s = '*' THEN x.t || '.h' ELSE x.t END))
SELECT start, now AS target, wild AS via_wildcard, CAST(hops AS INTEGER) AS hops FROM r JOIN k ON now = q WHERE hops > 0 QUALIFY row_number() OVER (PARTITION BY start
ORDER BY wild, hops, now) = 1""")
def q_reexport(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("pkg"), x.cast("string"))
    p = table(spark, sf_dir, "part")
    exports = p.where("p_partkey > 0").select(name(k).alias("module"), F.when(k % 4 == 0, "*").otherwise("h").alias("symbol"), F.when(k % 4 == 0, name(F.floor(k / 2))).otherwise(F.concat(name(F.floor(k / 3)), F.lit(".h"))).alias("target"))
    symbols = p.where("p_size % 9 = 0 OR p_partkey < 2").select(F.concat(name(k), F.lit(".h")).alias("qualified_name"))
    starts = exports.select(F.concat("module", F.lit(".h")).alias("qualified_name"))
    return resolve.re_exports(starts, exports, symbols)


@R.query("""WITH RECURSIVE p AS (SELECT 'K' || p_partkey AS c, 'K' || (p_partkey // 2) AS parent, 0 AS pos FROM part WHERE p_partkey > 1 UNION ALL SELECT 'K' || p_partkey, 'K' || (p_partkey // 5),
1 FROM part WHERE p_partkey > 9), m AS (SELECT 'K' || p_partkey AS c, 'm' || (p_size % 4) AS method FROM part),
a AS (SELECT c, parent AS anc, 1 AS depth, [pos] AS pos FROM p UNION ALL SELECT a.c, p.parent, depth + 1, list_append(a.pos, p.pos) FROM a JOIN p ON p.c = a.anc
WHERE depth < 12 AND a.c <> p.parent)
SELECT m.c AS class, m.method, x.c AS ancestor FROM m JOIN a ON a.c = m.c JOIN m x ON x.c = a.anc AND x.method = m.method QUALIFY row_number() OVER (PARTITION BY m.c, m.method
ORDER BY depth, a.pos, x.c) = 1""")
def q_override(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("K"), x.cast("string"))
    p = table(spark, sf_dir, "part")
    first = p.where("p_partkey > 1").select(name(k).alias("class"), name(F.floor(k / 2)).alias("parent"), F.lit(0).alias("position"))
    second = p.where("p_partkey > 9").select(name(k).alias("class"), name(F.floor(k / 5)).alias("parent"), F.lit(1).alias("position"))
    methods = p.select(name(k).alias("class"), F.concat(F.lit("m"), (F.col("p_size") % 4).cast("string")).alias("method"))
    return resolve.overrides(first.unionByName(second), methods)


@R.query("SELECT 'm' || user_id || '.' || event_type AS original, arg_max('t' || (event_id % 50), event_id) AS target FROM events GROUP BY 1")
def q_rebind_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("m"), F.col("user_id").cast("string"), F.lit("."), "event_type").alias("original"), F.concat(F.lit("t"), (F.col("event_id") % 50).cast("string")).alias("target"), F.col("event_id").alias("seq"))
    return resolve.latest_rebinds(e)


NORM = lambda c: f"lower(trim(regexp_replace({c}, '[-_.]+', '_', 'g'), '_'))"


@R.query(f"""WITH i AS (SELECT s_suppkey AS seq, 'org__r' || s_suppkey AS slug, CASE WHEN s_suppkey % 2 = 0 THEN '@Org/R' || (s_suppkey % 40) END AS npm, CASE WHEN s_suppkey % 3 = 0 THEN 'Py-Pkg.' || (s_suppkey % 60) END AS py, CASE WHEN s_suppkey % 5 = 0 THEN 'top' || s_suppkey END AS top FROM supplier),
m AS (SELECT CASE c_custkey % 4 WHEN 0 THEN '@org/r' || (c_custkey % 50) WHEN 1 THEN 'py_pkg_' || (c_custkey % 70) || '.core' WHEN 2 THEN 'top' || (c_custkey % 30) || '.x' ELSE 'none' || c_custkey END AS qualified_name, 'm' || c_custkey AS path FROM customer),
n AS (SELECT DISTINCT qualified_name, min(path) AS path FROM m GROUP BY 1),
a AS (SELECT qualified_name, 0 AS p, seq, slug FROM n JOIN i ON lower(npm) IN (lower(qualified_name), lower(path))),
b AS (SELECT qualified_name, 1 AS p, seq, slug FROM n JOIN i ON {NORM('py')} IN ({NORM("string_split(qualified_name, '.')[1]")}, {NORM("string_split(path, '.')[1]")}) OR {NORM('top')} IN ({NORM("string_split(qualified_name, '.')[1]")}, {NORM("string_split(path, '.')[1]")}))
SELECT n.qualified_name, n.path, arg_min(slug, (p, seq)) AS slug FROM n LEFT JOIN (SELECT * FROM a UNION ALL SELECT * FROM b) u USING (qualified_name) GROUP BY ALL""")
def q_repo_match(spark, sf_dir):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    s = lambda x: x.cast("string")
    i = table(spark, sf_dir, "supplier").select(k.alias("seq"), F.concat(F.lit("org__r"), s(k)).alias("slug"), F.when(k % 2 == 0, F.concat(F.lit("@Org/R"), s(k % 40))).alias("npm_name"), F.when(k % 3 == 0, F.concat(F.lit("Py-Pkg."), s(k % 60))).alias("python_name"), F.when(k % 5 == 0, F.concat(F.lit("top"), s(k))).alias("python_top_level"))
    name = F.when(c % 4 == 0, F.concat(F.lit("@org/r"), s(c % 50))).when(c % 4 == 1, F.concat(F.lit("py_pkg_"), s(c % 70), F.lit(".core"))).when(c % 4 == 2, F.concat(F.lit("top"), s(c % 30), F.lit(".x"))).otherwise(F.concat(F.lit("none"), s(c)))
    m = table(spark, sf_dir, "customer").groupBy(name.alias("qualified_name")).agg(F.min(F.concat(F.lit("m"), s(c))).alias("path"))
    return resolve.repository_of(m, i).select("qualified_name", "path", "slug")


@R.query("SELECT p_partkey AS k, 'pkg-' || p_partkey AS npm_name, CAST(NULL AS VARCHAR) AS python_name FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, NULL, 'py-' || p_partkey FROM part WHERE p_partkey % 2 = 1")
def q_identities(spark, sf_dir):
    k = F.col("p_partkey")
    s = k.cast("string")
    path = F.when(k % 2 == 0, "package.json").otherwise("pyproject.toml")
    text = F.when(k % 2 == 0, F.concat(F.lit('{"name": "pkg-'), s, F.lit('"}'))).otherwise(F.concat(F.lit('[project]\nname = "py-'), s, F.lit('"\n')))
    files = table(spark, sf_dir, "part").select(s.alias("slug"), path.alias("path"), text.alias("text"))
    return manifests.identities(files).select(F.col("slug").cast("long").alias("k"), "npm_name", "python_name")


# --- texts and measures from tables -----------------------------------------------------------------------

MARKDOWN = "'intro ' || doc_id || chr(10) || '# ' || lang || chr(10) || replace(text, '#', ' ') || chr(10) || '## Two words!' || chr(10) || 'x' || chr(10) || '# ' || lang || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || '#### deep' END"


@R.query(f"""WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS path, {MARKDOWN} AS content FROM documents),
l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS no, len(string_split(content, chr(10))) AS n FROM f),
h AS (SELECT path, no, n, regexp_extract(line, '^(#{{1,3}})\\s+(.*)$', 2) AS title FROM l WHERE regexp_matches(line, '^#{{1,3}}\\s+\\S')),
s AS (SELECT path, no AS start_line, coalesce(lead(no) OVER (PARTITION BY path ORDER BY no) - 1, n) AS end_line, CASE WHEN slug = '' THEN 'section' ELSE slug END AS slug
FROM (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM h)),
k AS (SELECT *, row_number() OVER (PARTITION BY path, slug ORDER BY start_line) AS k FROM s),
pre AS (SELECT l.path, 1 AS start_line, min(h.no) - 1 AS end_line, 'preamble' AS slug FROM l JOIN h ON l.path = h.path GROUP BY l.path HAVING min(h.no) > 1)
SELECT path, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, slug || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS slug FROM k
UNION ALL SELECT path, CAST(start_line AS INTEGER), CAST(end_line AS INTEGER), slug FROM pre""")
def q_heading_chunks(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.expr(MARKDOWN).alias("content"))
    return chunks.heading_chunks(files, "path", "content").select("path", "start_line", "end_line", "slug")


LEADS = ["Walk me through ", "Add ", "how does ", "", "What tools ", "re-implement ", "Overview of ", "please trace the "]


@R.query(f"""SELECT conv_id, turn, CASE {' '.join(f"WHEN regexp_matches(t, {quoted('(?i)' + '|'.join(f'(?:{p})' for p in ps))}) THEN {quoted(n)}" for n, ps in T.INTENTS)} ELSE 'symbol' END AS intent FROM (SELECT conv_id, turn, {sql_array(LEADS)}[1 + (conv_id + turn) % {len(LEADS)}] || text AS t FROM conversations)""")
def q_intent(spark, sf_dir):
    lead = F.get(F.array(*map(F.lit, LEADS)), ((F.col("conv_id") + F.col("turn")) % len(LEADS)).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.intent(F.concat(lead, "text")).alias("intent"))


@R.query("SELECT l_orderkey AS task, l_linenumber AS line, CASE WHEN l_discount > l_tax THEN round((l_quantity / 100.0 - l_tax) / (l_discount - l_tax), 4) END AS lift FROM lineitem")
def q_lift(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("line"), F.col("l_tax").alias("none"), (F.col("l_quantity") / 100.0).alias("composed"), F.col("l_discount").alias("oracle"))
    return df.select("task", "line", rank.lift_capture(df).alias("lift"))


@R.query("""SELECT c_custkey AS repo, CASE WHEN c_custkey % 7 = 0 THEN 'unindexed' WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a = b THEN 'fresh' ELSE 'stale' END WHEN a IS NULL AND b IS NULL THEN 'indexed' ELSE 'stale' END AS verdict
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 's' || (c_custkey % 2) END AS a, CASE WHEN c_custkey % 5 > 0 THEN 's' || (c_custkey % 4) END AS b FROM customer)""")
def q_freshness(spark, sf_dir):
    k = F.col("c_custkey")
    sha = lambda m, n: F.when(k % m > 0, F.concat(F.lit("s"), (k % n).cast("string")))
    r = table(spark, sf_dir, "customer").select(k.alias("repo"), F.when(k % 7 != 0, 1.0).alias("last_indexed_at"), sha(3, 2).alias("last_indexed_sha"), sha(5, 4).alias("current_head"))
    return incremental.freshness(r).select("repo", "verdict")


@R.query("""WITH e AS (SELECT user_id AS job, event_id AS id, CAST(event_id AS DOUBLE) AS ts, CAST(CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 5 + (event_id % 40) / 40.0 * 60 WHEN 'signup' THEN 65 WHEN 'error' THEN 70 ELSE 98 END AS DOUBLE) AS pct FROM events), m AS (SELECT *, max(pct) OVER w AS p, ts - min(ts) OVER (PARTITION BY job) AS t FROM e WINDOW w AS (PARTITION BY job ORDER BY ts))
SELECT job, id, round(p, 4) AS progress_pct, CASE WHEN p > 10 AND p < 100 THEN round(t * (100 - p) / p, 4) END AS eta_sec FROM m""")
def q_progress(spark, sf_dir):
    phase = F.create_map(*[F.lit(x) for kv in {"view": "discovering", "click": "parsing", "signup": "writing", "error": "embedding", "purchase": "finalizing"}.items() for x in kv])
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), F.col("event_id").cast("double").alias("ts"), phase[F.col("event_type")].alias("phase"), (F.col("event_id") % 40).alias("files_done"), F.lit(40).alias("files_total"))
    return incremental.progress(e, "job", "ts").select("job", "id", F.round("progress_pct", 4).alias("progress_pct"), F.round("eta_sec", 4).alias("eta_sec"))


ALIASES = {"@app/*": "src/app/*", "lib": "src/lib/index", "~*.css": "styles/*", "a*b*c": "never"}


@R.query("""WITH n AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN '@app/' || p_name WHEN 1 THEN 'lib' WHEN 2 THEN '~' || p_name || '.css' WHEN 3 THEN 'axbxc' ELSE '@app' END AS n FROM part)
SELECT k, CASE k % 5 WHEN 0 THEN 'src/app/' || substring(n, 6) WHEN 1 THEN 'src/lib/index' WHEN 2 THEN 'styles/' || substring(n, 2, length(n) - 5) END AS path FROM n""")
def q_path_alias(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    n = F.when(k % 5 == 0, F.concat(F.lit("@app/"), name)).when(k % 5 == 1, "lib").when(k % 5 == 2, F.concat(F.lit("~"), name, F.lit(".css"))).when(k % 5 == 3, "axbxc").otherwise("@app")
    return table(spark, sf_dir, "part").select(k.alias("k"), T.path_alias(n, ALIASES).alias("path"))


@R.query("""WITH o AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'local ' || l_linenumber WHEN 1 THEN 'scip-x npm pkg' || (l_partkey % 9) || ' 1.0 src/`a b.ts`/F' || l_suppkey || '().' ELSE 'odd symbol' END AS symbol, l_orderkey % 64 AS roles FROM lineitem)
SELECT CASE WHEN symbol LIKE 'local %' THEN 'local' WHEN symbol LIKE 'odd%' THEN 'odd' ELSE string_split(symbol, ' ')[3] END AS package, count(*) AS occurrences, count(*) FILTER (roles & 1 <> 0) AS definitions, count(*) FILTER (roles & 1 = 0) AS references, count(*) FILTER (roles & 2 <> 0) AS imports, count(DISTINCT symbol) AS symbols FROM o GROUP BY 1""")
def q_index_summary(spark, sf_dir):
    from heddle.sources import tables

    n, s = F.col("l_linenumber"), lambda c: F.col(c).cast("string")
    symbol = F.when(n % 3 == 0, F.concat(F.lit("local "), s("l_linenumber"))).when(n % 3 == 1, F.concat(F.lit("scip-x npm pkg"), (F.col("l_partkey") % 9).cast("string"), F.lit(" 1.0 src/`a b.ts`/F"), s("l_suppkey"), F.lit("()."))).otherwise("odd symbol")
    return tables.index_summary(table(spark, sf_dir, "lineitem").select(symbol.alias("symbol"), (F.col("l_orderkey") % 64).alias("roles")))


@R.query("""WITH e AS (SELECT event_id, event_id % 64 AS b FROM events), r AS (SELECT event_id, b, list_filter(['definition', 'import', 'write', 'read', 'generated', 'test'], lambda n, i: (b // CAST(2 ** (i - 1) AS BIGINT)) % 2 = 1) AS names FROM e) SELECT event_id, CASE WHEN b = 0 THEN 'reference' ELSE array_to_string(names, ',') END AS roles FROM r""")
def q_index_roles(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.array_join(T.index_roles(F.col("event_id") % 64), ",").alias("roles"))


@R.query("""SELECT p_partkey AS k, '# Class: C' || p_partkey || CASE WHEN p_size > 9 THEN chr(10) || '# Module: ' || p_type ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '# Members: a, ' || p_name ELSE '' END || chr(10) || '# ---' || chr(10) || 'class C' || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || p_brand ELSE '' END AS class_text,
'# Module: ' || p_type || chr(10) || '# Path: ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '# Public: a, ' || p_name ELSE '' END || chr(10) || '# ---' || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || p_brand ELSE '' END AS module_text,
'Summarise the file ' || p_name || ':' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN repeat('é', 20) ELSE repeat('é', p_size % 20) END AS file_text FROM part""")
def q_chunk_texts(spark, sf_dir):
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    members = F.when(k % 2 == 0, F.array(F.lit("a"), F.col("p_name"))).otherwise(F.array().cast("array<string>"))
    doc = F.when(k % 3 == 0, F.col("p_brand")).otherwise(none)
    text = F.when(k % 2 == 0, F.repeat(F.lit("é"), 30)).otherwise(F.expr("repeat('é', cast(p_size % 20 as int))"))
    return table(spark, sf_dir, "part").select(
        k.alias("k"), chunks.class_chunk(F.concat(F.lit("C"), k.cast("string")), F.lit("class C"), members, doc, F.when(F.col("p_size") > 9, F.col("p_type")).otherwise("")).alias("class_text"),
        chunks.module_chunk(F.col("p_type"), F.col("p_name"), doc, members).alias("module_text"), chunks.file_chunk(F.col("p_name"), text, most=41).alias("file_text"),
    )


@R.query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 1 END AS start, CASE doc_id % 3 WHEN 0 THEN '# one' || chr(10) || '// ' || lang WHEN 1 THEN '' ELSE '' END AS head FROM documents""")
def q_comment_blocks(spark, sf_dir):
    i = F.col("doc_id")
    text = F.when(i % 3 == 0, F.concat(F.lit("# one\n// "), "lang", F.lit("\nx = 1\n# two\n@dec\ndef f():\n    pass"))).when(i % 3 == 1, F.concat(F.lit("y\n\n# a\n\nz\ndef g(): pass\n"), "lang")).otherwise("def h(): pass")
    start = F.when(i % 3 == 0, 6).when(i % 3 == 1, 6).otherwise(1)
    return table(spark, sf_dir, "documents").select("doc_id", chunks.extended_start(text, start).alias("start"), chunks.leading_comments(text).alias("head"))


@R.query("""WITH s AS (SELECT 'r.' || source || CASE WHEN doc_id % 2 = 0 THEN '::module::summary' ELSE '.x.md::part' END AS q, text FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY source)) SELECT q AS qualified_name, array_to_string(string_split(text, chr(10))[1:40], chr(10)) AS snippet FROM s WHERE q NOT LIKE 'r.src1%' """)
def q_summary_snippets(spark, sf_dir):
    from heddle.plans import search

    d = table(spark, sf_dir, "documents")
    first = d.groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text"))
    stored = first.select(F.concat(F.lit("r."), "source", F.when(F.col("doc_id") % 2 == 0, "::module::summary").otherwise(".x.md::part")).alias("qualified_name"), "text")
    wanted = stored.where("qualified_name NOT LIKE 'r.src1%'").select("qualified_name").unionByName(stored.select(F.lit("r.other").alias("qualified_name")))
    return search.summary_snippets(wanted, stored)


@R.query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY score DESC, q) AS rank
FROM (SELECT 's' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '::module::summary' ELSE '' END AS q, c_acctbal AS score FROM customer) QUALIFY rank <= 100),
k AS (SELECT *, sum(CASE WHEN ends_with(q, '::summary') THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS n FROM r) SELECT q AS qualified_name, score FROM k
WHERE NOT ends_with(q, '::summary') OR n <= 4 ORDER BY rank LIMIT 24""")
def q_summary_quota(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), k.cast("string"), F.when(k % 3 == 0, "::module::summary").otherwise("")).alias("qualified_name"), F.col("c_acctbal").alias("score"))
    best = c.orderBy(F.desc("score"), "qualified_name").limit(100)
    return rank.summary_quota(best, 24, F.col("qualified_name").endswith("::summary"), "qualified_name")


@R.query("""SELECT page_id FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'node_modules/b.py' WHEN 2 THEN 'web/c.css' ELSE 'x/' || page_id || '.ts' END AS path FROM pages) WHERE regexp_matches(path, '\\.(py|ts)$') AND NOT contains(path, 'node_modules/')""")
def q_relevant_events(spark, sf_dir):
    from heddle.streaming import watch

    m = F.col("page_id") % 4
    path = F.when(m == 0, "src/a.py").when(m == 1, "node_modules/b.py").when(m == 2, "web/c.css").otherwise(F.concat(F.lit("x/"), F.col("page_id").cast("string"), F.lit(".ts")))
    return watch.relevant(table(spark, sf_dir, "pages").withColumn("path", path), (".py", ".ts")).select("page_id")


@R.query("""WITH m AS (SELECT 'star.Customer.' || o_custkey AS src, 'star.Order.' || o_orderkey AS dst, CASE WHEN o_orderstatus = 'F' THEN 'Function' ELSE 'Method' END AS label FROM orders)
SELECT label, src, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT DISTINCT 'External', 'pkg:' || p_brand, 1 FROM part""")
def q_branches(spark, sf_dir):
    """Branches of two labels in one list, and the packages that manifests name."""
    o = table(spark, sf_dir, "orders").withColumn("src", F.concat(F.lit("star.Customer."), F.col("o_custkey").cast("string")))
    f = o.where("o_orderstatus = 'F'").select(F.lit("Function").alias("label"), "src")
    m = o.where("o_orderstatus <> 'F'").select(F.lit("Method").alias("label"), "src")
    counts = f.unionByName(m).groupBy("label", "src").agg(F.count("*").alias("n"))
    found = table(spark, sf_dir, "part").select(F.lit("r/requirements.txt").alias("path"), F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("version_spec")).distinct()
    _, edges = manifests.external_packages(found, "proj")
    packages = edges.groupBy(F.concat(F.lit("pkg:"), F.col("dst")).alias("src")).agg(F.countDistinct("version_spec").alias("n"))
    return counts.unionByName(packages.select(F.lit("External").alias("label"), "src", "n"))


SCHEMAS = ("nation", "region", "part", "customer")
FILLED = " UNION ALL ".join(f"SELECT '{n}' AS t, k, v, (SELECT count(*) FROM {n}) AS n FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {n}) ON COLUMNS(*) INTO NAME k VALUE v)" for n in SCHEMAS)


@R.query(f"WITH f AS ({FILLED}) SELECT table_name AS label, '- ' || table_name || ': ' || string_agg(column_name || ' (' || CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END || ')', ', ' ORDER BY ordinal_position) AS line, CAST(any_value(n) AS BIGINT) AS n FROM information_schema.columns JOIN f ON t = table_name AND k = column_name AND v > 0 GROUP BY table_name")
def q_schema_text(spark, sf_dir):
    from heddle.sources import tables

    return tables.described({n: table(spark, sf_dir, n) for n in SCHEMAS})
