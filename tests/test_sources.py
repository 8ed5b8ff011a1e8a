"""Sources of symbols and manifests, and searches over them."""

import pytest
from pyspark.sql import functions as F

from heddle.operators import resolve
from heddle.plans import search
from heddle.sources import manifests, python_source

FILES = [
    ("pkg/__init__.py", "from .a import f\nfrom .b import *\n"),
    ("pkg/a.py", '"""Doc."""\nimport os.path as p\nfrom . import b\n\ndef f():\n    """F."""\n    g()\n    return b.h()\n\ndef g():\n    yield 1\n\nclass A:\n    def m(self):\n        return self.n()\n    async def n(self):\n        pass\n'),
    ("pkg/b.py", "from .a import A\nclass B(A):\n    def m(self):\n        return super().m()\ndef h():\n    return [x for x in (lambda: (yield))()]\nA.n = h\n"),
    ("bad.py", "def ("),
    ("x.js", "f()"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return python_source.parsed(spark.createDataFrame(FILES, "path string, text string"), "proj").cache()


def test_definitions(rows):
    got = {r["qualified_name"]: r for r in rows.where("kind in ('Function', 'Method', 'Class', 'Module')").collect()}
    assert set(got) >= {"proj.pkg", "proj.pkg.a.f", "proj.pkg.a.A", "proj.pkg.a.A.m", "proj.pkg.b.B.m"}
    assert got["proj.pkg.a.A.n"]["is_async"] and got["proj.pkg.a.g"]["is_generator"] and not got["proj.pkg.b.h"]["is_generator"]
    assert got["proj.pkg.a.f"]["docstring"] == "F." and got["proj.pkg.a"]["decorators"] == ["f", "g", "A"]
    assert rows.where("kind = 'error'").first()["path"] == "bad.py"


def test_calls_resolve(spark, rows):
    rebinds = rows.where("kind = 'rebind'").select(F.lit("proj.pkg.a.A.n").alias("original"), F.lit("proj.pkg.b.h").alias("target"), "seq")
    parents = spark.createDataFrame([("proj.pkg.b.B", "proj.pkg.a.A", 0)], "class string, parent string, position int")
    out = resolve.resolved(python_source.calls(rows), python_source.symbols(rows), python_source.imports(rows), python_source.exports(rows), rebinds, parents=parents)
    got = {r["call_name"]: (r["callee"], r["resolved_via"]) for r in out.collect()}
    assert got["g"] == ("proj.pkg.a.g", "exact") and got["b.h"] == ("proj.pkg.b.h", "exact")
    assert got["self.n"] == ("proj.pkg.b.h", "rebound") and got["super().m"] == ("proj.pkg.a.A.m", "exact")


def test_structure(spark, rows):
    got = {(r["rel"], r["src"], r["dst"]) for r in python_source.structure(spark.createDataFrame([(p,) for p, _ in FILES], "path string"), "proj").collect()}
    assert ("CONTAINS_PACKAGE", "proj", "pkg") in got and ("CONTAINS_FILE", "pkg", "pkg/a.py") in got and ("CONTAINS_FILE", "proj", "x.js") in got


@pytest.mark.parametrize("level,target,package,want", [(1, "a", False, "p.q.a"), (1, "a", True, "p.q.m.a"), (2, None, False, "p"), (0, "z.y", False, "z.y")])
def test_relative_imports(level, target, package, want):
    assert python_source.relative_import("p.q.m", package, level, target) == want


def test_manifests(spark):
    files = [
        ("pyproject.toml", '[project]\nname = "Foo-Bar"\ndependencies = ["requests>=2 ; python_version>\'3\'", "numpy"]\n'),
        ("a/package.json", '{"name": "@o/x", "dependencies": {"left": "^1.0"}}'),
        ("requirements-dev.txt", "# c\npytest==8\n-r x\n"),
        ("go.mod", "module m\nrequire github.com/a/b v1.2.3\n"),
        ("Gemfile", "gem 'rails', '~> 7'\n"),
        ("Cargo.toml", '[dependencies]\nserde = { version = "1" }\n'),
        ("x.csproj", '<Project><ItemGroup><PackageReference Include="N" Version="3"/></ItemGroup></Project>'),
        ("b/package.json", "{broken"),
        ("a.txt", "requests"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    got = {(r["name"], r["version_spec"]) for r in manifests.declared(df).collect()}
    assert got == {("requests", ">=2"), ("numpy", ""), ("left", "^1.0"), ("pytest", "==8"), ("github.com/a/b", "v1.2.3"), ("rails", "~> 7"), ("serde", "1"), ("N", "3")}
    ident = manifests.identities(df.withColumn("slug", F.lit("s"))).first()
    assert ident["python_name"] == "Foo-Bar" and ident["npm_name"] is None


def test_semantic_search_and_bundle(spark):
    names = ["a.fixtures.x", "a.login", "a.session", "a.tests.login_test", "a.login::Symbol::card"]
    emb = spark.createDataFrame([(n, v) for n, v in zip(names, [[1.0, 0.0], [0.9, 0.1], [0.5, 0.5], [0.8, 0.2], [0.95, 0.05]], strict=True)], "qualified_name string, embedding array<float>")
    store = search.Store(
        emb,
        spark.createDataFrame([("a.session", 1.0)], "qualified_name string, pagerank double"),
        spark.createDataFrame([("a.login", "login user"), ("a.session", "session token")], "qualified_name string, content string"),
        spark.createDataFrame([("a.login", "a.session"), ("a.session", "a.store")], "src string, dst string"),
        spark.createDataFrame([("a.login", "x" * 400), ("a.session", "y" * 40)], "qualified_name string, source string"),
    )
    best = [r["qualified_name"] for r in search.semantic(store, [1.0, 0.0], ["login"], 3).collect()]
    assert best[0] == "a.login" and "a.fixtures.x" not in best and "a.login::Symbol::card" not in best
    seeds = spark.createDataFrame([("a.login", 0.9)], "qualified_name string, score double")
    got = {r["qualified_name"]: (r["depth"], round(r["score"], 4), r["kept"]) for r in search.bundle(store, seeds, 2, budget=10_000).collect()}
    assert got == {"a.login": (0, 0.9, True), "a.session": (1, 0.45, True), "a.store": (2, 0.225, True)}


def test_guarded_sql(spark):
    spark.range(10).createOrReplaceTempView("ten")
    page, more = search.guarded_sql(spark, "SELECT id FROM ten", 2, 3)
    assert [r["id"] for r in page.collect()] == [2, 3, 4] and more
    for q in ("DROP VIEW ten", "CREATE TABLE x AS SELECT 1"):
        with pytest.raises(PermissionError):
            search.guarded_sql(spark, q)
