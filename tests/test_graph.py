import random
import re

import graphs
import pytest
from pyspark.sql import functions as F

from codeloom import model
from codeloom.engine import Engine, NotFound
from codeloom.operators import changes, linking, lookup, neighbors, paging, rank, resolve, similarity, walk


def test_ids_keep_their_layout(spark):
    row = spark.range(1).select(model.edge_id(F.lit("from-node"), F.lit("CALLS"), F.lit("to-node")).alias("e"), model.edge_id(F.lit("from-node"), F.lit("CALLS"), F.lit("to-node"), F.lit(0)).alias("b")).first()
    assert row["e"] == "271ad00f31b2f4a8d240120d5e5104a2"
    assert row["b"] != row["e"]


def test_diamond(spark):
    e = graphs.edges(spark, [graphs.edge(a, b) for a, b in graphs.DIAMOND])
    w = walk.path_walk(e, "a", "outgoing", "CALLS")
    assert w.nodes == [("a", 0), ("b", 1), ("d", 1), ("c", 2), ("e", 3)]
    assert w.visited_rows == 7 and w.truncated_by is None


def test_direction_and_kind(spark):
    e = graphs.edges(spark, [graphs.edge("a", "b"), graphs.edge("b", "c"), graphs.edge("x", "b", "REFERENCES")])
    assert [n for n, _ in walk.path_walk(e, "c", "incoming", "CALLS").nodes] == ["c", "b", "a"]
    assert {n for n, _ in walk.path_walk(e, "c", "incoming").nodes} == {"c", "b", "a", "x"}


def test_cycle_ends(spark):
    e = graphs.edges(spark, [graphs.edge("a", "b"), graphs.edge("b", "a"), graphs.edge("a", "a")])
    assert walk.path_walk(e, "a", "outgoing").nodes == [("a", 0), ("b", 1)]


def test_truncation_causes(spark):
    rows = [graphs.edge("r", f"p{i:03}") for i in range(6)] + [graphs.edge("p000", "q"), graphs.edge("q", "z")]
    e = graphs.edges(spark, rows)
    assert walk.path_walk(e, "r", "outgoing", max_fanout=3).truncated_by == "maxFanout"
    assert walk.path_walk(e, "r", "outgoing", budget=3).truncated_by == "budget"
    deep = walk.path_walk(e, "r", "outgoing", max_depth=2)
    assert deep.truncated_by == "maxDepth" and deep.frontier == ["q"]
    assert walk.path_walk(e, "r", "outgoing").truncated_by is None


def test_resume_gives_everything_once(spark):
    rows = [graphs.edge("r", f"p{i}") for i in range(5)] + [graphs.edge(f"p{i}", f"c{i}{j}") for i in range(5) for j in range(4)]
    e = graphs.edges(spark, rows)
    part, got, walked = walk.path_walk(e, "r", "outgoing", budget=8), [], []
    for _ in range(20):
        got += [n for n, _ in part.nodes]
        walked += part.edges
        if part.resume_token is None:
            break
        part = walk.resume_walk(e, part.resume_token, budget=8)
    assert len(got) == len(set(got)) == 26
    assert sorted(walked) == sorted(r[0] for r in rows)


def test_reach_equals_path_walk(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = list({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(16)})
        e = graphs.edges(spark, [graphs.edge(a, b, resolved=rng.random() < 0.5) for a, b in rows])
        w = walk.path_walk(e, "n0", "outgoing", max_depth=3, max_fanout=2)
        r = walk.reach(e, spark.createDataFrame([("n0",)], "id string"), "outgoing", None, 3, 2)
        assert sorted(w.nodes) == sorted((x["id"], x["depth"]) for x in r.collect())
        assert w.truncated_by == walk.truncation(e, r, "outgoing", None, 3, 2)


def test_hub_expands_its_fanout_only(spark):
    e = spark.range(20_000).select(F.format_string("e%08d", "id").alias("id"), F.lit("hub").alias("fromId"), F.format_string("n%08d", "id").alias("toId"), F.lit("CALLS").alias("kind"), F.lit("tree-sitter").alias("source"), F.lit(True).alias("resolved"), F.lit(None).cast("int").alias("toDeclaration"))
    w = walk.path_walk(e, "hub", "outgoing", max_fanout=50)
    assert w.visited_rows == 51 and w.truncated_by == "maxFanout"
    assert walk.path_walk(e, "hub", "outgoing", max_fanout=1_000_000, budget=100).visited_rows == 100


def test_bad_tokens():
    for token in ("", "x", "e30="):
        with pytest.raises(ValueError):
            walk.State.read(token)
    with pytest.raises(ValueError):
        paging.decode_cursor("nonsense", paging.STRUCTURAL)


def test_pages_show_every_row_once(spark):
    n = graphs.nodes(spark, [graphs.node("t")] + [graphs.node(f"c{i:02}", file="a.ts" if i % 3 else "b.ts") for i in range(23)])
    e = graphs.edges(spark, [graphs.edge(f"c{i:02}", "t", resolved=i % 2 == 0) for i in range(23)] + [graphs.edge("ghost", "t")])
    engine, seen, cursor = Engine(n, e), [], None
    while True:
        page = engine.find_callers(symbol_id="t", limit=5, cursor=cursor).page
        seen += [(not r["resolved"], r["filePath"] != "a.ts", r["id"]) for r in page.results]
        cursor = page.next_cursor
        if not page.has_more:
            break
    assert len(seen) == 23 and seen == sorted(seen)


def test_byte_budget_keeps_one_row(spark):
    df = spark.createDataFrame([("a" * 50, 1), ("b" * 50, 2)], "id string, n int")
    keys = (paging.Key("id"),)
    assert paging.budget_frame(df, keys, ["id"], 10).count() == 1
    page = paging.paginate(df, keys, budget=10)
    assert len(page.results) == 1 and page.has_more and paging.decode_cursor(page.next_cursor, keys) == ["a" * 50]


def test_limits():
    assert [paging.clamp(x) for x in (None, 0, 7, 999)] == [20, 1, 7, 200]


def test_definition_and_anchor(spark):
    rows = [graphs.node("f1", "File", "src/a.ts"), graphs.node("x", name="go", line=3, end=9, qualified="A.go"), graphs.node("y", name="go", file="b.ts", qualified="B.go"), graphs.node("p", "Module", native="pending_symbol", name="go")]
    engine = Engine(graphs.nodes(spark, rows), graphs.edges(spark, [graphs.edge("x", "y"), graphs.edge("f1", "y", "REFERENCES")]))
    assert engine.find_definition("A.go").node["id"] == "x"
    several = engine.find_definition("go")
    assert several.ambiguous and [(r["id"], r["score"]) for r in several.candidates.results] == [("y", 2.0), ("x", 0.0)]
    assert engine.find_definition("ignored", "a.ts", (5, 1)).node["id"] == "x"
    with pytest.raises(NotFound):
        engine.find_definition("nothing")
    with pytest.raises(ValueError):
        engine.anchor(symbol_id="f1")
    with pytest.raises(ValueError):
        engine.anchor()


def test_tally_gate():
    assert neighbors.tally_wanted(True, 1, 1) and neighbors.tally_wanted(False, 3, 2) and not neighbors.tally_wanted(False, 2, 2)


def test_dependencies(spark):
    n = graphs.nodes(spark, [graphs.node(x, "File", f"src/{x}.ts") for x in "abc"])
    e = graphs.edges(spark, [graphs.edge("a", "b", "IMPORTS"), graphs.edge("b", "c", "IMPORTS")])
    rows, w = Engine(n, e).get_dependencies("src/a.ts")
    assert [r["id"] for r in rows] == ["b", "c"] and rows[0]["qualifiedName"] is None and w.truncated_by is None
    with pytest.raises(NotFound) as err:
        Engine(n, e).get_dependencies("src")
    assert err.value.hints == ["src/a.ts", "src/b.ts", "src/c.ts"]


def test_import_link_is_idempotent(spark):
    n = graphs.nodes(spark, [graphs.node("F", "File", "lib/x.ts"), graphs.node("M", "Module", "a.ts", qualified="lib/x.ts", native="resolved_module"), graphs.node("E", "Module", "a.ts", qualified="react", native="external_module")])
    e = graphs.edges(spark, [graphs.edge("A", "M", "IMPORTS", "1", False), graphs.edge("A", "E", "IMPORTS", "2", False)])
    n1, e1 = linking.link_imports(n, e)
    assert {(r["id"], r["toId"], r["resolved"]) for r in e1.collect()} == {("1", "F", True), ("2", "E", False)}
    assert {r["id"] for r in n1.collect()} == {"F", "E"}
    n2, e2 = linking.link_imports(n1, e1)
    assert changes.diff(e1, e2).isEmpty() and changes.diff(n1, n2).isEmpty()


def barrels(spark):
    r = lambda i, file, name, to: graphs.node(i, "Module", file, name=name, qualified=to, native="reexport", exported=False)
    p = lambda i, to: graphs.node(i, "Module", "use.ts", name=to.rpartition("#")[2], qualified=to, native="pending_symbol", exported=False)
    return graphs.nodes(
        spark,
        [
            graphs.node("f", file="x.ts", name="f"), graphs.node("T", "Type", "x.ts", name="T"), graphs.node("d", file="x.ts", name="default"),
            graphs.node("m1", file="m1.ts", name="mutate"), graphs.node("m2", file="m2.ts", name="mutate"), graphs.node("h", file="x.ts", name="hidden", exported=False),
            r("r1", "index.ts", "*", "x.ts#*"), r("r2", "index.ts", "g", "x.ts#f"), r("r3", "top.ts", "*", "index.ts#*"), r("r4", "x.ts", "*", "top.ts#*"),
            r("r5", "both.ts", "*", "m1.ts#*"), r("r6", "both.ts", "*", "m2.ts#*"),
            p("p1", "top.ts#f"), p("p2", "top.ts#g"), p("p3", "top.ts#default"), p("p4", "both.ts#mutate"), p("p5", "index.ts#T"), p("p6", "x.ts#hidden"),
        ],
    )


def test_symbols_through_barrels(spark):
    e = graphs.edges(spark, [graphs.edge("u", f"p{i}", "CALLS", f"e{i}", False) for i in range(1, 7)] + [graphs.edge("u", "p5", "SUPERTYPE_OF", "s5", False)])
    linked = {r["id"]: r["toId"] for r in linking.link_symbols(barrels(spark), e).collect()}
    assert linked == {"e1": "f", "e2": "f", "e3": "p3", "e4": "p4", "e5": "p5", "e6": "p6", "s5": "T"}


def test_symbols_that_share_an_address_are_not_multiplied(spark):
    k = 40
    rows = [graphs.node(f"f{i}", file="x.ts", name="f") for i in range(k)] + [graphs.node("t", "Type", "x.ts", name="f"), graphs.node("r", "Module", "top.ts", name="*", qualified="x.ts#*", native="reexport", exported=False)]
    rows += [graphs.node(f"p{i}", "Module", "use.ts", name="f", qualified=("x.ts#f", "top.ts#f")[i % 2], native="pending_symbol", exported=False) for i in range(k)]
    n, e = graphs.nodes(spark, rows), graphs.edges(spark, [graphs.edge("u", f"p{i}", kind, f"{kind}{i}", False) for i in range(k) for kind in ("CALLS", "SUPERTYPE_OF", "REFERENCES")])
    found = linking.resolve_addresses(linking.pending(n), n)
    assert sorted((r["o_file"], r["target_kind"], r["hops"]) for r in found.collect()) == [("top.ts", "Function", 1), ("top.ts", "Type", 1), ("x.ts", "Function", 0), ("x.ts", "Type", 0)]
    linked = {r["id"]: (r["toId"], r["resolved"]) for r in linking.link_symbols(n, e).collect()}
    assert linked == {f"{kind}{i}": ("t", True) if kind == "SUPERTYPE_OF" else (f"p{i}", False) for i in range(k) for kind in ("CALLS", "SUPERTYPE_OF", "REFERENCES")}


def test_diff_link_equals_full_link(spark):
    n = barrels(spark)
    e = graphs.edges(spark, [graphs.edge("u", f"p{i}", "REFERENCES", f"e{i}", False) for i in range(1, 7)])
    before = n.where("id != 'f'")
    stale = linking.link_symbols(before, e)
    scope = linking.symbols_in_diff(n, n.where("id = 'f'"), e.limit(0))
    assert {r["id"] for r in scope.collect()} == {"p1", "p2"}
    assert changes.diff(linking.link_symbols(n, stale, scope), linking.link_symbols(n, e)).isEmpty()


def test_overload_binding(spark):
    n = graphs.nodes(spark, [graphs.node("P", file="x.ts", name="parse")])
    d = spark.createDataFrame([("P", i, 10 * i, 0, 10 * i + 5, 80, f"s{i}", i == 2) for i in range(3)], model.DECLARATIONS)
    e = graphs.edges(spark, [graphs.edge("a", "P", i="e1"), graphs.edge("b", "P", i="e2")])
    sites = spark.createDataFrame([("e1", "x.ts", 1, 0), ("e1", "x.ts", 12, 0), ("e2", "x.ts", 1, 0), ("e2", None, None, None)], "edgeId string, filePath string, line int, col int")
    out = linking.bind_overloads(e, sites, d, n).collect()
    assert sorted((r["fromId"], r["toDeclaration"]) for r in out if r["toDeclaration"] is not None) == [("a", 0), ("a", 1)]
    assert [r["id"] for r in out if r["toDeclaration"] is None] == ["e2"]


def test_diffs(spark):
    a = spark.createDataFrame([("1", "x", None), ("2", "y", 1), ("3", "z", 1)], "id string, v string, n int")
    b = spark.createDataFrame([("1", "x", None), ("2", "y", 2), ("4", "w", 1)], "id string, v string, n int")
    assert {(r[0], r[1]) for r in changes.diff(a, b).collect()} == {("2", "changed"), ("3", "removed"), ("4", "added")}
    kept = changes.apply(a, b.where("id = '2'"), a.where("id in ('2', '3')"))
    assert {(r["id"], r["n"]) for r in kept.collect()} == {("1", None), ("2", 2)}


def test_declarations_are_replaced(spark):
    n = graphs.nodes(spark, [graphs.node("P")])
    d = spark.createDataFrame([("P", 0, 1, 0, 2, 0, "old", False), ("Q", 0, 1, 0, 2, 0, "q", False)], model.DECLARATIONS)
    new = spark.createDataFrame([("P", 0, 5, 0, 6, 0, "new", True)], model.DECLARATIONS)
    none = graphs.edges(spark, [])
    _, _, out = changes.apply_graph(n, none, d, n, n.limit(0), none, none, new)
    assert {r["signature"] for r in out.collect()} == {"new", "q"}


def test_specifiers(spark):
    i = spark.createDataFrame([("src/a.ts", s) for s in ("./b", "./b.js", "..", "../../x", "react", "./s.css", "./c.ts", ".")], "importer string, specifier string")
    f = spark.createDataFrame([(p,) for p in ("src/b.tsx", "index.js", "src/c.ts", "src/c.ts.ts", "src/index.ts", "src/s.css")], "filePath string")
    got = {r["specifier"]: r["path"] for r in resolve.resolve(i, f).collect()}
    assert got == {"./b": "src/b.tsx", "./b.js": "src/b.tsx", "..": None, "../../x": None, "react": None, "./s.css": None, "./c.ts": "src/c.ts", ".": "src/index.ts"}


def test_package_exports_and_paths():
    rules = resolve.package_rules("p/lib", {"name": "lib", "exports": {".": {"types": "./t.d.ts", "import": "./src/i.ts"}, "./*": "./src/*.ts"}})
    assert rules[0].targets[:2] == ("p/lib/src/i.ts", "p/lib/t.d.ts")
    assert (rules[1].prefix, rules[1].suffix, rules[1].targets) == ("lib/", "", ("p/lib/src/*.ts",))
    files = {"t/tsconfig.json": '{"extends": "./base", /* c */ }', "t/base.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*",]}}}'}
    assert resolve.tsconfig_rules("t/tsconfig.json", files.get)[0].targets == ("t/src/*",)
    assert resolve.strip_jsonc("{\"a\": \"// no\"}// yes") == "{\"a\": \"// no\"}"


def test_vectors(spark):
    v = spark.createDataFrame([("alpha", [1.0, 0.0, 0.0]), ("beta", [0.0, 1.0, 0.0]), ("gamma", [0.0, 0.0, 1.0]), ("zero", [0.0, 0.0, 0.0])], "nodeId string, embedding array<float>")
    assert [r["id"] for r in similarity.nearest(v, [0.9, 0.05, 0.05], 4).collect()] == ["alpha", "beta", "gamma"]
    with pytest.raises(Exception, match="different length"):
        similarity.nearest(v, [1.0], 1).collect()


def test_embedding_refresh(spark):
    n = graphs.nodes(spark, [graphs.node("a", doc=" some words ", signature="f()"), graphs.node("b")])
    new = similarity.embed_nodes(n, similarity.hashing_embedder, "v1")
    rows = new.collect()
    assert [r["nodeId"] for r in rows] == ["a"] and abs(sum(x * x for x in rows[0]["embedding"]) - 1) < 1e-5
    old = spark.createDataFrame([("b", [1.0], "v0"), ("c", [1.0], "v0")], model.VECTORS)
    assert {r["nodeId"] for r in similarity.refresh_vectors(old, n, new).collect()} == {"a", "c"}


def test_pagerank_sums_to_one(spark):
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("a", "d", 2.0)], "src string, dst string, weight double")
    assert abs(sum(r["rank"] for r in rank.pagerank(links).collect()) - 1) < 1e-9
    assert rank.pagerank(links.limit(0)).count() == 0


def test_pagerank_makes_its_links_once(spark):
    made = spark.sparkContext.accumulator(0)
    weight = F.udf(lambda w: made.add(1) or w, "double").asNondeterministic()
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("a", "d", 2.0)], "src string, dst string, weight double")
    got = {r["id"]: r["rank"] for r in rank.pagerank(links.withColumn("weight", weight("weight")), rounds=6).collect()}
    assert made.value == 4
    assert got == pytest.approx({r["id"]: r["rank"] for r in rank.pagerank(links, rounds=6).collect()})


def test_resolved_edges_are_those_of_all_that_are_resolved(spark, tmp_path):
    from codeloom.plans import star

    tables = {
        "orders": ([(1, 7, "F"), (2, 7, "O"), (3, 8, None)], "o_orderkey long, o_custkey long, o_orderstatus string"),
        "lineitem": ([(1, 5, 9, "N"), (2, 5, 9, "R"), (2, 6, 9, "N"), (3, 5, 4, None), (1, 6, 4, "A"), (3, 6, 4, "N")], "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for kind in ("CALLS", "REFERENCES"):
        some = star.edges(spark, str(tmp_path), [kind], resolved=True)
        assert sorted(some.collect()) == sorted(star.edges(spark, str(tmp_path), [kind]).where("resolved").collect())
        assert some.count() == 2


def test_tasks_hold_so_many_pairs_whatever_the_tables_size(spark, tmp_path, monkeypatch):
    from codeloom.plans import star

    lines = spark.range(4000).selectExpr("id % 1000 l_orderkey", "cast(id * 7 % 90 as long) l_partkey", "cast(id % 11 % 4 as long) l_suppkey", "case when id % 3 = 0 then 'R' else 'N' end l_returnflag")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1000).selectExpr("id o_orderkey", "id % 5 o_custkey", "case when id % 2 = 0 then 'F' else 'O' end o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(star, "TASK_ROWS", 100, raising=False)
    for kind, rows in (("CALLS", lines.selectExpr("concat('c|', l_suppkey, '|', l_partkey) id", "l_returnflag = 'R' ok")), ("REFERENCES", lines.selectExpr("concat('r|', l_orderkey % 5, '|', l_partkey) id", "l_orderkey % 2 = 0 ok"))):
        edges = star.edges(spark, str(tmp_path), [kind])
        want = {r["id"]: r["ok"] for r in rows.groupBy("id").agg(F.max("ok").alias("ok")).collect()}
        assert {r["id"]: r["resolved"] for r in edges.collect()} == want and edges.count() == len(want)
        held = edges.groupBy(F.spark_partition_id()).count().collect()
        assert len(held) > 20 and max(r["count"] for r in held) < len(want) / 6


def test_ladder(spark):
    n = graphs.nodes(spark, [graphs.node("a", name="x"), graphs.node("x", name="q"), graphs.node("s", file="src/stem.ts")])
    assert [(r["id"], r["rung"]) for r in rank.ladder(n, "x").collect()] == [("x", 0)]
    assert [(r["id"], r["rung"]) for r in rank.ladder(n, "STEM").collect()] == [("s", 3)]


def test_empty_scopes_are_no_scopes(spark):
    n = graphs.nodes(spark, [graphs.node("a"), graphs.node("b")])
    assert lookup.within(n, "id", []).count() == 2 and lookup.within(n, "id", None).count() == 2


def test_checks_at_ingest(spark):
    good, bad = model.valid_edges(graphs.edges(spark, [graphs.edge("a", "b"), graphs.edge("a", "b", "NOT_A_KIND")]))
    assert (good.count(), bad.count()) == (1, 1)


def test_budget_looks_further_until_it_is_spent(spark):
    ranked = spark.createDataFrame([(i, 1, 1000 - i // 2) for i in range(300)], "id long, cost long, rank long")
    assert sorted(r["id"] for r in rank.within_budget(ranked, "cost", 50, first=4).collect()) == list(range(50))
    assert rank.within_budget(ranked, "cost", 1000, first=4).count() == 300 and rank.within_budget(ranked.limit(0), "cost", 5).count() == 0


def test_zero_vectors_are_like_nothing(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0])], "nodeId string, embedding array<float>")
    scored = rows.select("nodeId", similarity.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(1.0))).alias("s")).collect()
    assert {(r["nodeId"], round(r["s"], 6)) for r in scored} == {("a", 0.0), ("b", 1.0)}
    assert [r["id"] for r in similarity.nearest(rows, [1.0, 1.0], 2).collect()] == ["b"]


def test_long_and_circular_extends_and_one_character_globs():
    files = {f"c{i}.json": '{"extends": "./c%d.json"}' % (i + 1) for i in range(20)} | {"c20.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}'}
    assert len(resolve.tsconfig_rules("c0.json", files.get)) == 1
    assert resolve.tsconfig_rules("a.json", {"a.json": '{"extends": "./b.json"}', "b.json": '{"extends": "./a.json"}'}.get) == []
    assert re.match(resolve.glob_pattern("packages/lib?"), "packages/lib1") and not re.match(resolve.glob_pattern("packages/lib?"), "packages/lib")
