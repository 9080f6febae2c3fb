import pytest
from pyspark.sql import functions as F

from codeloom.engine import Engine
from codeloom.operators import linking
from codeloom.sources import extract

FILES = {
    "src/greeter.ts": '/** Says it. */\nexport interface Greeter { greet(name: string): string }\nexport class Loud implements Greeter {\n  static make() { return new Loud(); }\n  get size() { return 1 }\n  set size(v) {}\n  greet(name: string) { return shout(name) }\n}\nfunction shout(s: string) { return fmt(s) }\nimport { fmt as fmt } from "./lib";\nexport const limit = 3;\n',
    "src/lib/index.ts": 'export * from "./impl";\nexport { hidden as shown } from "./impl.js";\nimport React from "react";\n',
    "src/lib/impl.ts": "export function fmt(s: string): string;\nexport function fmt(s: number): string;\nexport function fmt(s: any) { return helper(s) }\nfunction helper(x) { return x }\nexport function hidden() {}\nconst pick = (f) => f(helper);\n",
    "src/use.ts": 'import * as lib from "./lib";\nimport { shown, fmt } from "./lib";\nexport function main() {\n  lib.fmt("a"); shown();\n  [1].map(x => fmt(x));\n  const hidden = 1; hidden;\n}\nmain();\nconst base = "./li";\nconst m = require(`${base}b`);\n',
    "src/broken.ts": "export function ok() { return 1 }\nfunction bad( {\n",
}


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame([(p, t.encode()) for p, t in FILES.items()], "filePath string, content binary")
    nodes, edges, declarations = extract.build(extract.default_registry().extract(files))
    return nodes.cache(), edges.cache(), declarations


def test_nodes(graph):
    nodes, _, _ = graph
    got = {(r["kind"], r["qualifiedName"], r["nativeKind"]) for r in nodes.where("filePath = 'src/greeter.ts' and kind != 'Module'").collect()}
    assert {("Type", "Greeter", None), ("Type", "Loud", None), ("Function", "Loud.make", None), ("Function", "Loud#size", "getter"), ("Function", "Loud#size", "setter"), ("Function", "Loud#greet", None), ("Function", "shout", None), ("Variable", "limit", None)} <= got
    assert nodes.where("name = 'Greeter'").first()["docComment"] == "Says it."


def test_overloads_are_one_symbol(graph):
    nodes, _, declarations = graph
    fmt = nodes.where("name = 'fmt' and kind = 'Function'").collect()
    assert len(fmt) == 1 and fmt[0]["startLine"] == 2 and fmt[0]["signature"].endswith("fmt(s: string): string")
    assert declarations.where(F.col("nodeId") == fmt[0]["id"]).count() == 3


def test_syntax_errors_flag_the_file(graph):
    nodes, _, _ = graph
    assert {r["hasSyntaxErrors"] for r in nodes.where("filePath = 'src/broken.ts'").collect()} == {True}
    assert nodes.where("name = 'ok'").count() == 1


def named(nodes, edges):
    a = nodes.select(F.col("id").alias("fromId"), F.col("qualifiedName").alias("a"))
    b = nodes.select(F.col("id").alias("toId"), F.col("qualifiedName").alias("b"))
    return {(r["a"], r["kind"], r["b"]) for r in edges.join(a, "fromId").join(b, "toId").collect()}


def test_edges(graph):
    nodes, edges, _ = graph
    got = named(nodes, edges)
    assert ("Loud", "SUPERTYPE_OF", "Greeter") in got and ("Loud#greet", "CALLS", "shout") in got and ("fmt", "CALLS", "helper") in got
    assert ("src/use.ts", "REFERENCES", "main") in got and ("src/greeter.ts", "EXPORTS", "Loud") in got and ("src/greeter.ts", "EXPORTS", "shout") not in got
    assert ("src/lib/index.ts", "IMPORTS", "react") in got and ("src/use.ts", "IMPORTS", "src/lib/index.ts") in got


def test_links_through_the_barrel(graph):
    nodes, edges, _ = graph
    nodes, edges = linking.link_imports(nodes, edges)
    edges = linking.link_symbols(nodes, edges).cache()
    got = named(nodes, edges)
    assert ("shout", "CALLS", "fmt") in got and ("main", "CALLS", "hidden") in got and ("main", "CALLS", "fmt") in got
    callers = Engine(nodes, edges).find_callers(symbol_name="fmt").page.results
    assert {r["name"] for r in callers} == {"shout", "main"}


def test_ids_survive_edits_elsewhere():
    a = {r["id"] for r in extract.read_script("a.ts", "function f() {}\n") if r["record"] == "node"}
    b = {r["id"] for r in extract.read_script("a.ts", "// more\n\nconst x = 1\nfunction f() {}\n") if r["record"] == "node"}
    assert a < b


def test_conflicting_readers():
    with pytest.raises(ValueError):
        extract.default_registry().add([".ts"], extract.read_script)
