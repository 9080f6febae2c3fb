"""One query for each operator over the star-schema graph, with its SQL for DuckDB beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import changes, linking, lookup, neighbors, paging, rank, resolve, similarity, status, walk
from codeloom.plans import star
from codeloom.sources import ndjson, tree
from codeloom.streaming import changes as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True) -> Callable[[Query], Query]:
    """Registers a query under its function's name; its SQL may use nodes and edges if ``graph``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            if graph and text.startswith("WITH RECURSIVE"):
                text = "WITH RECURSIVE " + star.SQL.strip() + "," + text.removeprefix("WITH RECURSIVE")
            elif graph:
                text = "WITH " + star.SQL.strip() + ("," + text.removeprefix("WITH") if text.startswith("WITH") else " " + text)
            ORACLES[f.__name__] = text
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


NODE = ["id", "kind", "name", "qualifiedName", "filePath", "startLine"]
_PART, _CUST, _SUPP = "P1", "C1", "S1"

# lookups


@query("SELECT id, kind, name, qualifiedName, filePath, startLine FROM nodes WHERE id = 'P1'")
def lookup_by_id(spark, sf):
    return lookup.by_id(star.nodes(spark, sf), _PART).select(*NODE)


@query("SELECT id, kind, name, qualifiedName, filePath, startLine FROM nodes WHERE name = (SELECT p_name FROM part WHERE p_partkey = 1) AND nativeKind IS DISTINCT FROM 'pending_symbol' AND nativeKind IS DISTINCT FROM 'reexport'")
def lookup_by_name(spark, sf):
    name = _t(spark, sf, "part").where("p_partkey = 1").select("p_name").first()[0]
    return lookup.by_name(star.nodes(spark, sf), name).select(*NODE)


@query("SELECT id, kind, name, qualifiedName, filePath, startLine FROM nodes WHERE qualifiedName = 'nation/3'")
def lookup_by_qualified_name(spark, sf):
    return lookup.by_qualified_name(star.nodes(spark, sf), "nation/3").select(*NODE)


@query("SELECT id, kind, name, qualifiedName, filePath, startLine FROM nodes WHERE kind = 'File' AND filePath = 'nation/7'")
def lookup_file_node(spark, sf):
    return lookup.file_node(star.nodes(spark, sf), "nation/7").select(*NODE)


@query("SELECT id, kind, name, qualifiedName, filePath, startLine FROM nodes WHERE filePath = 'nation/2' AND startLine <= 30 AND endLine >= 30 ORDER BY endLine - startLine, id LIMIT 1")
def lookup_position_innermost(spark, sf):
    return lookup.by_position(star.nodes(spark, sf), "nation/2", 30, 0).select(*NODE)


@query("SELECT id, kind, name, qualifiedName, filePath, startLine FROM nodes WHERE (filePath ILIKE '%/BRAND#12.%' OR filePath ILIKE 'BRAND#12.%' OR filePath ILIKE '%/BRAND#12/index.%' OR filePath ILIKE '%/Brand#12') AND kind NOT IN ('File', 'Module') ORDER BY exported::INT DESC, startLine, id LIMIT 5")
def lookup_file_stem_ilike(spark, sf):
    nodes = star.nodes(spark, sf)
    named = nodes.withColumn("filePath", F.when(F.col("filePath").ilike("%/Brand#12"), F.concat("filePath", F.lit(".ts"))).otherwise(F.col("filePath")))
    found = lookup.in_file_named(named, "BRAND#12")
    return found.withColumn("filePath", F.regexp_replace("filePath", r"\.ts$", "")).select(*NODE)


@query("SELECT id, filePath FROM nodes WHERE kind = 'File' AND filePath ILIKE 'NATION/%' ORDER BY length(filePath), filePath LIMIT 5")
def files_under_prefix(spark, sf):
    return lookup.files_under(star.nodes(spark, sf), "NATION/").select("id", "filePath")


@query("SELECT id, filePath FROM nodes WHERE kind = 'File' AND (filePath ILIKE 'nation/%' OR filePath ILIKE '%/nation/%') ORDER BY length(filePath), filePath LIMIT 5")
def files_in_dir(spark, sf):
    return lookup.files_in_dir(star.nodes(spark, sf), "nation").select("id", "filePath")


@query("SELECT kind, count(*) AS n FROM nodes WHERE kind IN ('Type', 'Variable') AND filePath IN ('nation/1', 'nation/2') GROUP BY kind")
def set_scopes(spark, sf):
    nodes = lookup.within(star.nodes(spark, sf), "kind", ["Type", "Variable"])
    nodes = lookup.within(lookup.within(nodes, "filePath", ["nation/1", "nation/2"]), "language", [])
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, kind, name, CASE WHEN kind <> 'File' THEN qualifiedName END AS qualifiedName, CASE WHEN kind <> 'Module' THEN filePath END AS filePath, CASE WHEN kind <> 'File' THEN startLine END AS startLine, coalesce(signature, docComment) AS preview FROM nodes")
def published_rows(spark, sf):
    return lookup.published(star.nodes(spark, sf), for_dependency=True)


@query(r"WITH t AS (SELECT id, nullif(trim(docComment), '') AS d, nullif(trim(signature), '') AS s FROM nodes) SELECT id, concat_ws(chr(10) || chr(10), d, s) AS text FROM t WHERE d IS NOT NULL OR s IS NOT NULL")
def text_to_embed(spark, sf):
    return star.nodes(spark, sf).select("id", lookup.text_to_embed().alias("text")).where("text is not null")


@query("SELECT DISTINCT filePath FROM nodes WHERE hasSyntaxErrors")
def syntax_error_files(spark, sf):
    return lookup.syntax_error_files(star.nodes(spark, sf))


@query("WITH q AS (SELECT 'nation/' || c_nationkey AS f, c_custkey::INT AS line FROM customer), m AS (SELECT f, line, id, row_number() OVER (PARTITION BY f, line ORDER BY endLine - startLine, id) AS r FROM (SELECT DISTINCT f, line FROM q) JOIN nodes ON filePath = f AND startLine <= line AND endLine >= line WHERE kind <> 'Variable') SELECT f AS filePath, line, id FROM m WHERE r = 1")
def interval_tightest(spark, sf):
    asked = _t(spark, sf, "customer").selectExpr("concat('nation/', c_nationkey) filePath", "cast(c_custkey as int) line", "40 col")
    nodes = star.nodes(spark, sf).where("kind <> 'Variable'")
    return lookup.at_positions(nodes, asked).select("filePath", "line", "id")


# neighbours and pages

_PAGE_SQL = "SELECT e.id, e.kind AS edgeKind, resolved, CASE WHEN n.filePath = a.filePath THEN 0 ELSE 1 END AS locality, n.id AS nodeId, n.filePath FROM edges e JOIN nodes n ON n.id = e.{far} JOIN nodes a ON a.id = '{at}' WHERE e.{own} = '{at}' AND e.kind IN ({kinds}){more} ORDER BY resolved::INT DESC, locality, e.id LIMIT {n}"


def _page_sql(at: str, own: str, kinds: str, n: int, more: str = "") -> str:
    return _PAGE_SQL.format(at=at, own=own, far="fromId" if own == "toId" else "toId", kinds=kinds, n=n, more=more)


def _found(spark, sf, at, direction, kinds):
    nodes = star.nodes(spark, sf)
    path = lookup.by_id(nodes, at).first()["filePath"]
    return neighbors.neighbors(nodes, star.edges(spark, sf, kinds, (neighbors.ends(direction)[0], at)), at, path, direction, kinds)


def _paged(spark, sf, at, direction, kinds, n, cursor=None):
    found = _found(spark, sf, at, direction, kinds)
    return paging.page_frame(found, paging.STRUCTURAL, n, cursor).select("id", "edgeKind", "resolved", "locality", "nodeId", "filePath")


@query(_page_sql(_PART, "toId", "'CALLS', 'REFERENCES', 'SUPERTYPE_OF'", 21))
def page_references(spark, sf):
    return _paged(spark, sf, _PART, neighbors.INCOMING, neighbors.REFERENCE_KINDS, 21)


@query(_page_sql(_PART, "toId", "'CALLS'", 21))
def page_callers(spark, sf):
    return _paged(spark, sf, _PART, neighbors.INCOMING, ["CALLS"], 21)


@query(_page_sql(_SUPP, "fromId", "'CALLS'", 21))
def page_callees(spark, sf):
    return _paged(spark, sf, _SUPP, neighbors.OUTGOING, ["CALLS"], 21)


@query(_page_sql(_SUPP, "toId", "'SUPERTYPE_OF'", 21))
def page_implementations(spark, sf):
    return _paged(spark, sf, _SUPP, neighbors.INCOMING, ["SUPERTYPE_OF"], 21)


@query(_page_sql(_SUPP, "fromId", "'CALLS'", 11, " AND (resolved::INT < 1 OR (resolved::INT = 1 AND (CASE WHEN n.filePath = a.filePath THEN 0 ELSE 1 END > 1 OR (CASE WHEN n.filePath = a.filePath THEN 0 ELSE 1 END = 1 AND e.id > 'c|1|1200'))))"))
def keyset_next_page(spark, sf):
    return _paged(spark, sf, _SUPP, neighbors.OUTGOING, ["CALLS"], 11, [1, 1, "c|1|1200"])


@query("SELECT n.filePath, count(*) AS refs FROM edges e JOIN nodes n ON n.id = e.toId WHERE e.fromId = 'S1' AND e.kind = 'CALLS' GROUP BY n.filePath ORDER BY refs DESC, n.filePath LIMIT 200")
def file_tally(spark, sf):
    return neighbors.tally(_found(spark, sf, _SUPP, neighbors.OUTGOING, ["CALLS"]))


@query("WITH c AS (SELECT id FROM nodes WHERE name = (SELECT p_name FROM part WHERE p_partkey = 1)) SELECT c.id, (SELECT count(*) FROM edges e WHERE e.toId = c.id AND e.kind IN ('REFERENCES', 'CALLS'))::DOUBLE AS score FROM c ORDER BY score DESC, c.id LIMIT 21")
def candidate_rank(spark, sf):
    name = _t(spark, sf, "part").where("p_partkey = 1").select("p_name").first()[0]
    named = lookup.by_name(star.nodes(spark, sf), name)
    ranked = neighbors.with_popularity(named, star.edges(spark, sf, ["REFERENCES", "CALLS"]))
    return paging.page_frame(ranked, paging.SCORE, 21).select("id", "score")


@query("SELECT n.id, n.startLine FROM edges e JOIN nodes n ON n.id = e.toId WHERE e.fromId = 'N3' AND e.kind = 'DEFINES' ORDER BY n.startLine, n.id LIMIT 201")
def file_outline(spark, sf):
    rows = neighbors.outline(star.nodes(spark, sf), star.edges(spark, sf, ["DEFINES"], ("fromId", "N3")), "N3")
    return paging.page_frame(rows, paging.OUTLINE, 201).select("id", "startLine")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id > 3 OR (conv_id = 3 AND turn > 1) ORDER BY conv_id, turn, role LIMIT 40", graph=False)
def outline_conversation(spark, sf):
    keys = (paging.Key("conv_id"), paging.Key("turn"), paging.Key("role"))
    df = _t(spark, sf, "conversations").select("conv_id", "turn", "role")
    return df.where((F.col("conv_id") > 3) | ((F.col("conv_id") == 3) & (F.col("turn") > 1))).orderBy(*[k.order() for k in keys]).limit(40)


@query("""WITH f AS (SELECT * FROM (SELECT e.id, n.id AS "nodeId", n.filePath AS "filePath" FROM edges e JOIN nodes n ON n.id = e.toId WHERE e.fromId = 'S1' AND e.kind = 'CALLS' ORDER BY e.id LIMIT 200)),
b AS (SELECT *, 1 + sum(strlen('{"id":"' || id || '","nodeId":"' || "nodeId" || '","filePath":"' || "filePath" || '"}')) OVER (ORDER BY id) + row_number() OVER (ORDER BY id) AS bytes, row_number() OVER (ORDER BY id) AS r FROM f)
SELECT id, "nodeId", "filePath" FROM b WHERE bytes <= 2000 OR r = 1""")
def byte_budget_prefix(spark, sf):
    found = _found(spark, sf, _SUPP, neighbors.OUTGOING, ["CALLS"])
    keys = (paging.Key("id"),)
    page = paging.page_frame(found.select("id", "nodeId", "filePath"), keys, 200)
    return paging.budget_frame(page, keys, ["id", "nodeId", "filePath"], 2000)


@query("SELECT toId AS id, kind FROM edges WHERE toId IN (SELECT id FROM nodes WHERE kind IN ('Type', 'Function')) GROUP BY toId, kind")
def distinct_edge_kinds(spark, sf):
    return neighbors.distinct_edge_kinds(star.edges(spark, sf), star.nodes(spark, sf).where("kind in ('Type', 'Function')"))


@query("SELECT n.id, (SELECT count(*) FROM edges e WHERE e.fromId = n.id OR e.toId = n.id) AS edges FROM nodes n WHERE kind IN ('Module', 'File', 'Type')")
def incident_counts(spark, sf):
    return neighbors.incident_counts(star.edges(spark, sf), star.nodes(spark, sf).where("kind in ('Module', 'File', 'Type')"))


@query("WITH b AS (SELECT DISTINCT filePath FROM nodes WHERE hasSyntaxErrors) SELECT id, hasSyntaxErrors OR filePath IN (SELECT filePath FROM b) AS flagged FROM nodes")
def syntax_error_flags(spark, sf):
    nodes = star.nodes(spark, sf)
    return lookup.flag_syntax_errors(nodes, lookup.syntax_error_files(nodes)).select("id", F.col("hasSyntaxErrors").alias("flagged"))


# walks

_STEPS = "s AS (SELECT {own} AS src, {far} AS dst, id, row_number() OVER (PARTITION BY {own} ORDER BY resolved::INT DESC, id) AS r FROM edges WHERE kind IN ({kinds}))"


def _steps(own: str, kinds: str) -> str:
    return _STEPS.format(own=own, far="fromId" if own == "toId" else "toId", kinds=kinds)


@query("WITH " + _steps("fromId", "'CALLS'") + " SELECT src, dst, id, r AS rank FROM s WHERE r <= 5")
def fanout_cap(spark, sf):
    return walk.steps(star.edges(spark, sf, ["CALLS"]), neighbors.OUTGOING, "CALLS", 5).withColumn("rank", F.col("rank").cast("long"))


def _reach_sql(own: str, kinds: str, start: str, fanout: int, depth: int) -> str:
    return f"WITH RECURSIVE {_steps(own, kinds)}, w AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT s.dst, w.depth + 1 FROM w JOIN s ON s.src = w.id AND s.r <= {fanout} WHERE w.depth < {depth}) SELECT id, min(depth) AS depth FROM w GROUP BY id"


@query(_reach_sql("fromId", "'SUPERTYPE_OF', 'CALLS', 'DEFINES'", "N1", 50, 2))
def walk_outgoing_depth2(spark, sf):
    start = spark.createDataFrame([("N1",)], "id string")
    return walk.reach(star.edges(spark, sf, ["SUPERTYPE_OF", "CALLS", "DEFINES"]), start, neighbors.OUTGOING, None, 2)


@query(_reach_sql("toId", "'CALLS', 'DEFINES', 'IMPORTS'", "P3", 50, 3))
def walk_incoming_depth3(spark, sf):
    start = spark.createDataFrame([("P3",)], "id string")
    return walk.reach(star.edges(spark, sf, ["CALLS", "DEFINES", "IMPORTS"]), start, neighbors.INCOMING, None, 3)


@query(_reach_sql("toId", "'SUPERTYPE_OF'", "S1", 50, 9))
def walk_implementations(spark, sf):
    start = spark.createDataFrame([("S1",)], "id string")
    return walk.reach(star.edges(spark, sf, ["SUPERTYPE_OF"]), start, neighbors.INCOMING, "SUPERTYPE_OF", 9)


@query(f"""WITH RECURSIVE {_steps("fromId", "'SUPERTYPE_OF', 'CALLS', 'DEFINES'")}, w AS (SELECT 'N1' AS id, 0 AS depth UNION SELECT s.dst, w.depth + 1 FROM w JOIN s ON s.src = w.id AND s.r <= 20 WHERE w.depth < 1), m AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)
SELECT (SELECT count(*) FROM m WHERE depth < 1 AND (SELECT count(*) FROM s WHERE s.src = m.id) > 20) AS overfull, (SELECT count(*) FROM m WHERE depth = 1 AND EXISTS (SELECT 1 FROM s WHERE s.src = m.id AND s.dst NOT IN (SELECT id FROM m))) AS open""")
def walk_truncation_flags(spark, sf):
    edges = star.edges(spark, sf, ["SUPERTYPE_OF", "CALLS", "DEFINES"])
    seen = walk.reach(edges, spark.createDataFrame([("N1",)], "id string"), neighbors.OUTGOING, None, 1, 20)
    a = walk.overfull(edges, seen.where("depth < 1"), neighbors.OUTGOING, None, 20).agg(F.count(F.lit(1)).alias("overfull"))
    b = walk.frontier_open(edges, seen, neighbors.OUTGOING, None, 1).agg(F.count(F.lit(1)).alias("open"))
    return a.join(F.broadcast(b))


@query(f"""WITH RECURSIVE {_steps("toId", "'SUPERTYPE_OF'")}, w AS (SELECT 'S1' AS id, 0 AS depth UNION SELECT s.dst, w.depth + 1 FROM w JOIN s ON s.src = w.id WHERE w.depth < 3) SELECT id FROM w GROUP BY id HAVING min(depth) = 3""")
def walk_frontier(spark, sf):
    seen = walk.reach(star.edges(spark, sf, ["SUPERTYPE_OF"]), spark.createDataFrame([("S1",)], "id string"), neighbors.INCOMING, "SUPERTYPE_OF", 3)
    return seen.where("depth = 3").select("id")


@query(f"""WITH RECURSIVE {_steps("toId", "'SUPERTYPE_OF', 'DEFINES'")}, w AS (SELECT 'S1' AS id, 0 AS depth, ['S1'] AS path UNION ALL SELECT s.dst, w.depth + 1, list_append(w.path, s.dst) FROM w JOIN s ON s.src = w.id AND s.r <= 10 WHERE w.depth < 3 AND NOT list_contains(w.path, s.dst)) SELECT id, min(depth)::BIGINT AS depth, (SELECT count(*) FROM w) AS visited_rows FROM w GROUP BY id""")
def walk_path_rows(spark, sf):
    found = walk.path_walk(star.edges(spark, sf, ["SUPERTYPE_OF", "DEFINES"]), "S1", neighbors.INCOMING, None, 3, 10)
    return spark.createDataFrame([(i, d, found.visited_rows) for i, d in found.nodes], "id string, depth long, visited_rows long")


# linking


def _placeholders(spark, sf):
    """Customers import their nation by path (a few a path that isn't there), and use suppliers and parts by name."""
    cust = _t(spark, sf, "customer")
    module = cust.selectExpr("concat('M', c_custkey % 30) id", "'Module' kind", "concat('nation/', c_custkey % 30) name", "concat('nation/', c_custkey % 30) qualifiedName", "'x' filePath", "'resolved_module' nativeKind", "false exported", "false hasSyntaxErrors").distinct()
    imports = cust.selectExpr("concat('im|', c_custkey) id", "concat('C', c_custkey) fromId", "concat('M', c_custkey % 30) toId", "'IMPORTS' kind", "'tree-sitter' source", "false resolved")
    return linking.model.conform(module, linking.model.NODES), linking.model.conform(imports, linking.model.EDGES)


@query("WITH m AS (SELECT c_custkey AS k, 'nation/' || (c_custkey % 30) AS p FROM customer) SELECT 'im|' || k AS id, coalesce('N' || n_nationkey, 'M' || (k % 30)) AS toId, n_nationkey IS NOT NULL AS resolved FROM m LEFT JOIN nation ON 'nation/' || n_nationkey = p", graph=False)
def import_link(spark, sf):
    modules, imports = _placeholders(spark, sf)
    files = star.nodes(spark, sf).where("kind = 'File'")
    _, edges = linking.link_imports(files.unionByName(modules), imports)
    return edges.select("id", "toId", "resolved")


@query("WITH m AS (SELECT DISTINCT c_custkey % 30 AS k FROM customer) SELECT 'M' || k AS id FROM m WHERE k NOT IN (SELECT n_nationkey FROM nation)", graph=False)
def import_link_placeholders_left(spark, sf):
    modules, imports = _placeholders(spark, sf)
    nodes, _ = linking.link_imports(star.nodes(spark, sf).where("kind = 'File'").unionByName(modules), imports)
    return nodes.where("kind = 'Module'").select("id")


def _symbols(spark, sf):
    """Each order uses a part by name, from the part's brand or, every fourth, from a barrel that forwards brands."""
    parts = star.nodes(spark, sf).where("kind = 'Function'")
    brands = parts.select("filePath").distinct()
    base = ["'Module' kind", "false exported", "false hasSyntaxErrors"]
    star_export = brands.selectExpr("concat('X|', filePath) id", "'*' name", "concat(filePath, '#*') qualifiedName", "'barrel/b' filePath", "'reexport' nativeKind", *base)
    again = spark.createDataFrame([("X|top",)], "id string").selectExpr("id", "'*' name", "'barrel/b#*' qualifiedName", "'barrel/a' filePath", "'reexport' nativeKind", *base)
    use = _t(spark, sf, "part").selectExpr("p_partkey k", "p_name n", "case when p_partkey % 4 = 0 then 'barrel/a' else concat('brand/', p_brand) end f")
    pend = use.selectExpr("concat('U', k) id", "n name", "concat(f, '#', n) qualifiedName", "concat('use/', k) filePath", "'pending_symbol' nativeKind", *base)
    calls = use.selectExpr("concat('u|', k) id", "concat('C', k) fromId", "concat('U', k) toId", "case when k % 2 = 0 then 'CALLS' else 'SUPERTYPE_OF' end kind", "'tree-sitter' source", "false resolved")
    c = linking.model.conform
    nodes = parts.unionByName(c(star_export, linking.model.NODES)).unionByName(c(again, linking.model.NODES)).unionByName(c(pend, linking.model.NODES))
    return nodes, c(calls, linking.model.EDGES)


@query("""WITH e AS (SELECT p_brand AS b, p_name AS n, count(*) AS k, min('P' || p_partkey) AS t FROM part WHERE p_size > 10 GROUP BY 1, 2),
a AS (SELECT n, sum(k) AS k, min(t) AS t FROM e GROUP BY n),
u AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b FROM part),
r AS (SELECT u.k, CASE WHEN u.k % 4 = 0 THEN CASE WHEN a.k = 1 THEN a.t END ELSE CASE WHEN e.k = 1 THEN e.t END END AS t FROM u LEFT JOIN e ON e.b = u.b AND e.n = u.n LEFT JOIN a ON a.n = u.n)
SELECT 'u|' || k AS id, CASE WHEN k % 2 = 0 AND t IS NOT NULL THEN t ELSE 'U' || k END AS toId, k % 2 = 0 AND t IS NOT NULL AS resolved FROM r""", graph=False)
def symbol_link_unique(spark, sf):
    nodes, edges = _symbols(spark, sf)
    return linking.link_symbols(nodes, edges).select("id", "toId", "resolved")


@query("""WITH b AS (SELECT DISTINCT p_brand, p_name FROM part)
SELECT 'brand/' || p_brand AS file, p_name AS name FROM b UNION SELECT 'barrel/b', p_name FROM b UNION SELECT 'barrel/a', p_name FROM b""", graph=False)
def reexport_closure(spark, sf):
    nodes, _ = _symbols(spark, sf)
    some = _t(spark, sf, "part").selectExpr("concat('brand/', p_brand) file", "p_name name")
    return linking.republished(some, nodes)


@query("""SELECT 'U' || p_partkey AS id FROM part WHERE p_partkey % 4 <> 0 AND p_brand IN (SELECT p_brand FROM part WHERE p_partkey IN (1, 2))""", graph=False)
def prefix_waiting(spark, sf):
    nodes, _ = _symbols(spark, sf)
    files = _t(spark, sf, "part").where("p_partkey in (1, 2)").selectExpr("concat('brand/', p_brand) file").distinct()
    return linking.waiting_under(nodes, files).select("id")


@query("""SELECT 'U' || p_partkey AS id FROM part WHERE ((p_partkey % 4 = 0 AND p_name IN (SELECT p_name FROM part WHERE p_partkey % 100 = 1 AND p_size > 10)) OR (p_partkey % 4 <> 0 AND (p_brand, p_name) IN (SELECT p_brand, p_name FROM part WHERE p_partkey % 100 = 1 AND p_size > 10)))""", graph=False)
def symbol_diff_scope(spark, sf):
    nodes, edges = _symbols(spark, sf)
    changed = nodes.where("id like 'P%' and cast(substring(id, 2) as long) % 100 = 1")
    return linking.symbols_in_diff(nodes, changed, edges.limit(0))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem), a AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS t FROM s GROUP BY 1)
SELECT 'o|' || o_orderkey AS id, CASE WHEN n = 1 THEN 'S' || t ELSE 'unknown' END AS toId, CASE WHEN n = 1 THEN 'ts-compiler' ELSE 'tree-sitter' END AS source, coalesce(n = 1, false) AS resolved FROM orders LEFT JOIN a ON a.k = o_orderkey""", graph=False)
def semantic_upgrade(spark, sf):
    edges = _t(spark, sf, "orders").selectExpr("concat('o|', o_orderkey) id", "concat('C', o_custkey) fromId", "'unknown' toId", "'REFERENCES' kind", "'tree-sitter' source", "false resolved")
    answers = _t(spark, sf, "lineitem").selectExpr("concat('o|', l_orderkey) id", "concat('S', l_suppkey) target")
    return linking.upgrade_edges(edges, answers).select("id", "toId", "source", "resolved")


@query("SELECT 'nation/' || c_nationkey AS filePath, 'C' || c_custkey AS id FROM customer WHERE c_nationkey < 10 AND c_custkey % 7 = 0", graph=False)
def retraction(spark, sf):
    before = star.nodes(spark, sf).where("kind = 'Variable'").select("filePath", "id", F.substring("id", 2, 20).cast("long").alias("k"))
    scope = _t(spark, sf, "nation").where("n_nationkey < 10").selectExpr("concat('nation/', n_nationkey) filePath")
    return linking.retracted(before.select("filePath", "id"), before.where("k % 7 <> 0"), scope)


# resolution


@query(r"""WITH p AS (SELECT page_id AS i, 'src/' || (page_id % 7) || '/a.ts' AS importer, CASE page_id % 4 WHEN 0 THEN './m' || (page_id % 11) WHEN 1 THEN '../' || (page_id % 5) || '/m' || (page_id % 11) || '.js' WHEN 2 THEN '../../../x' ELSE './d' || (page_id % 3) END AS specifier,
 CASE page_id % 4 WHEN 0 THEN 'src/' || (page_id % 7) || '/m' || (page_id % 11) WHEN 1 THEN 'src/' || (page_id % 5) || '/m' || (page_id % 11) WHEN 3 THEN 'src/' || (page_id % 7) || '/d' || (page_id % 3) END AS b FROM pages),
f AS (SELECT DISTINCT 'src/' || (page_id % 7) || '/m' || (page_id % 11) || (CASE WHEN page_id % 2 = 0 THEN '.tsx' ELSE '.ts' END) AS f FROM pages WHERE page_id % 3 <> 0 UNION SELECT DISTINCT 'src/' || (page_id % 7) || '/d1/index.ts' FROM pages)
SELECT DISTINCT importer, specifier, coalesce((SELECT min(f) FROM f WHERE f = b || '.ts'), (SELECT min(f) FROM f WHERE f = b || '.tsx'), CASE WHEN specifier NOT LIKE '%.js' THEN (SELECT min(f) FROM f WHERE f = b || '/index.ts') END) AS path FROM p""", graph=False)
def specifier_candidates(spark, sf):
    p = _t(spark, sf, "pages").select("page_id")
    imports = p.selectExpr("concat('src/', page_id % 7, '/a.ts') importer", "case page_id % 4 when 0 then concat('./m', page_id % 11) when 1 then concat('../', page_id % 5, '/m', page_id % 11, '.js') when 2 then '../../../x' else concat('./d', page_id % 3) end specifier")
    files = p.where("page_id % 3 <> 0").selectExpr("concat('src/', page_id % 7, '/m', page_id % 11, case when page_id % 2 = 0 then '.tsx' else '.ts' end) filePath").unionByName(p.selectExpr("concat('src/', page_id % 7, '/d1/index.ts') filePath"))
    return resolve.resolve(imports, files)


@query(r"""WITH p AS (SELECT DISTINCT 'app/' || (page_id % 3) || '/a.ts' AS importer, CASE page_id % 3 WHEN 0 THEN '@lib/u' || (page_id % 5) WHEN 1 THEN '@/u' || (page_id % 5) ELSE '#u' || (page_id % 5) END AS specifier, page_id % 5 AS u, page_id % 3 AS m FROM pages)
SELECT importer, specifier, CASE WHEN m = 0 THEN 'packages/lib/src/u' || u || '.ts' WHEN m = 1 AND importer LIKE 'app/1/%' THEN 'app/1/src/u' || u || '.ts' WHEN m = 2 AND importer LIKE 'app/2/%' THEN 'app/2/in/u' || u || '.ts' END AS path FROM p""", graph=False)
def specifier_rules(spark, sf):
    p = _t(spark, sf, "pages").select("page_id")
    imports = p.selectExpr("concat('app/', page_id % 3, '/a.ts') importer", "case page_id % 3 when 0 then concat('@lib/u', page_id % 5) when 1 then concat('@/u', page_id % 5) else concat('#u', page_id % 5) end specifier")
    five = spark.range(5)
    files = five.selectExpr("explode(array(concat('packages/lib/src/u', id, '.ts'), concat('app/1/src/u', id, '.ts'), concat('app/2/in/u', id, '.ts'))) filePath")
    rules = resolve.package_rules("packages/lib", {"name": "@lib"}) + resolve.package_rules("app/2", {"imports": {"#*": {"default": "./in/*.ts"}}})
    rules += resolve.tsconfig_rules("app/1/tsconfig.json", {"app/1/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./src/*"]}}} // own'}.get)
    return resolve.resolve(imports, files, resolve.rules_frame(spark, rules))


@query("SELECT url AS path, NOT (regexp_matches(url, '(?:^|/)(?:tmp|en)(?:/|$)') AND NOT regexp_matches(url, '\\.html(?:/|$)')) AS kept FROM pages", graph=False)
def ignore_layers(spark, sf):
    pages = _t(spark, sf, "pages").select(F.col("url").alias("path"))
    return pages.select("path", (~tree.ignored(F.col("path"), {"": "# notes\ntmp\nen\n!*.html\n"})).alias("kept"))


@query("WITH f AS (SELECT url AS p, CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '/else/x' ELSE '/r/' || (page_id % 40) END AS r FROM pages) SELECT min(p) AS path FROM f WHERE r LIKE '/r/%' GROUP BY r", graph=False)
def symlink_guard(spark, sf):
    files = _t(spark, sf, "pages").selectExpr("url filePath", "case when page_id % 9 = 0 then null when page_id % 5 = 0 then '/else/x' else concat('/r/', page_id % 40) end realPath")
    return tree.one_of_each(files, "/r").select(F.col("filePath").alias("path"))


# changes


def _orders(spark, sf):
    before = _t(spark, sf, "orders").selectExpr("cast(o_orderkey as string) id", "o_orderstatus", "o_totalprice").where("cast(id as long) % 11 <> 0")
    after = _t(spark, sf, "orders").selectExpr("cast(o_orderkey as string) id", "case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end o_orderstatus", "o_totalprice").where("cast(id as long) % 13 <> 0")
    return before, after


@query("SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'added' WHEN o_orderkey % 13 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE (o_orderkey % 11 = 0) <> (o_orderkey % 13 = 0) OR (o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 7 = 0)", graph=False)
def diff_added_removed(spark, sf):
    return changes.diff(*_orders(spark, sf))


@query("SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'U' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 3 <> 0", graph=False)
def apply_diff_net(spark, sf):
    table = _t(spark, sf, "orders").selectExpr("cast(o_orderkey as string) id", "o_orderstatus status")
    key = F.col("id").cast("long")
    return changes.apply(table, table.where(key % 5 == 0).withColumn("status", F.lit("U")), table.where(key % 3 == 0))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_id, event_type FROM r WHERE r = 1", graph=False)
def upsert_last_wins(spark, sf):
    return changes.last_wins(_t(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""WITH d AS (SELECT p_brand || '.' || p_name AS id, p_partkey::INT AS s, (p_partkey + p_size)::INT AS e, p_type AS sig, p_size > 10 AS ex, p_size > 40 AS body FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS ordinal FROM d)
SELECT id, coalesce(arg_min(s, s) FILTER (body), min(s)) AS "startLine", coalesce(arg_min(e, s) FILTER (body), arg_min(e, s)) AS "endLine", coalesce(arg_min(sig, s) FILTER (NOT body), arg_min(sig, s)) AS signature, bool_or(ex) AS exported, count(*) FILTER (ordinal > 0) + (count(*) > 1)::INT AS declarations FROM o GROUP BY id""", graph=False)
def declarations_group(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("concat(p_brand, '.', p_name) id", "cast(p_partkey as int) startLine", "0 startCol", "cast(p_partkey + p_size as int) endLine", "80 endCol", "p_type signature", "cast(null as string) docComment", "p_size > 10 exported", "p_size > 40 hasBody")
    nodes, child = changes.group_declarations(rows)
    n = child.groupBy("nodeId").agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(n, nodes["id"] == n["nodeId"], "left").select("id", "startLine", "endLine", "signature", "exported", F.coalesce("n", F.lit(0)).alias("declarations"))


@query("SELECT doc_id // 100 AS build, sha256(string_agg('d/' || doc_id || '=' || n_chars, chr(10) ORDER BY 'd/' || doc_id || '=' || n_chars)) AS digest FROM documents GROUP BY 1", graph=False)
def build_digest(spark, sf):
    """Each hundred documents are a build; the sign between path and hash is put where SQL can write it."""
    files = _t(spark, sf, "documents").selectExpr("doc_id div 100 build", "concat('d/', doc_id, '=', n_chars) filePath", "cast(null as string) contentHash")
    return changes.digest(files, "build")


@query("WITH u AS (SELECT toId AS id, count(*) AS uses FROM edges WHERE kind IN ('CALLS', 'REFERENCES') GROUP BY toId), n AS (SELECT id, filePath FROM nodes WHERE kind NOT IN ('File', 'Module')) SELECT n.id, round(2.0 * uses / sum(uses) OVER (PARTITION BY filePath), 8) AS rank FROM n JOIN u USING (id)")
def symbol_ranks(spark, sf):
    nodes = star.nodes(spark, sf)
    files = nodes.select("filePath").distinct().withColumn("rank", F.lit(2.0))
    return rank.symbol_ranks(nodes, star.edges(spark, sf, ["CALLS", "REFERENCES"]), files).select("id", F.round("rank", 8).alias("rank"))


@query("WITH r AS (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_retailprice DESC, p_partkey) AS s FROM part) SELECT p_partkey AS id, p_size AS cost FROM r WHERE s <= 1000", graph=False)
def budgeted_map(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey id", "p_size cost", "p_retailprice rank")
    return rank.within_budget(rows, "cost", 1000).select("id", "cost")


# streams, as batches


def _events(spark, sf):
    return _t(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


_SESSIONS = "WITH l AS (SELECT user_id AS path, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 300 SECOND THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY {out} ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM l)"


@query(_SESSIONS.format(key="user_id", out="path") + " SELECT path, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 300000000 AS fired_us, count(*) AS events FROM s GROUP BY path, s", graph=False)
def debounce_sessions(spark, sf):
    out = stream.debounce(_events(spark, sf), "300 seconds")
    return out.select("path", F.unix_micros("first").alias("first_us"), F.unix_micros("fired").alias("fired_us"), "events")


@query(_SESSIONS.format(key="user_id", out="path") + " SELECT path, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM s GROUP BY path, s", graph=False)
def debounce_by_lag(spark, sf):
    out = stream.sessions_by_lag(_events(spark, sf), 300_000_000)
    return out.select("path", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "events")


@query("WITH l AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 120 SECOND THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT ts, sum(n) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM l) SELECT epoch_us(min(ts)) AS first_us, count(*) AS events FROM s GROUP BY s", graph=False)
def burst_sessions(spark, sf):
    return stream.burst(_events(spark, sf), "120 seconds").select(F.unix_micros("first").alias("first_us"), "events")


@query("SELECT user_id AS path, min(event_id) AS first_seen FROM events GROUP BY user_id", graph=False)
def dirty_first_seen(spark, sf):
    return stream.dirty_queue(_events(spark, sf))


@query(_SESSIONS.format(key="user_id", out="path").replace("300", "3600") + " SELECT path, epoch_us(min(ts)) AS first_us, count(*) AS events FROM s GROUP BY path, s", graph=False)
def idle_sessions(spark, sf):
    out = stream.idle_sessions(_events(spark, sf), "path", "1 hour")
    return out.select("path", F.unix_micros("first").alias("first_us"), "events")


# reports


@query("SELECT 'd/' || doc_id AS \"filePath\", CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 3 <> 0 THEN 'fresh' WHEN doc_id % 2 = 0 THEN 'touched' ELSE 'changed' END AS state FROM documents", graph=False)
def staleness_classify(spark, sf):
    docs = _t(spark, sf, "documents").selectExpr("doc_id k", "concat('d/', doc_id) filePath", "doc_id + case when doc_id % 3 = 0 then 1 else 0 end mtime", "cast(coalesce(text, '') as binary) content")
    then = docs.where("k % 5 <> 0").select("filePath", F.col("k").alias("mtime"), F.when(F.col("k") % 2 == 0, F.sha2("content", 256)).otherwise("other").alias("contentHash"))
    return status.staleness(docs.select("filePath", "mtime", "content"), then)


@query("SELECT count(*) AS discovered, count(*) FILTER (doc_id % 4 <> 0) AS indexed, count(*) FILTER (doc_id % 4 <> 0) / count(*)::DOUBLE AS coverage, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 3 = 0) AS dirty FROM documents", graph=False)
def coverage_report(spark, sf):
    docs = _t(spark, sf, "documents").selectExpr("doc_id k", "concat('d/', doc_id) filePath")
    now = docs.selectExpr("filePath", "k + case when k % 3 = 0 then 1 else 0 end mtime")
    return status.coverage(docs, docs.where("k % 4 <> 0"), now, docs.where("k % 5 <> 0").selectExpr("filePath", "k mtime"))


@query("""WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'r' END AS root, o_orderkey % 2 = 0 AS e, o_orderkey % 3 = 0 AS pe, o_orderdate AS t FROM orders)
SELECT id, CASE WHEN root IS NULL THEN 'legacy' WHEN e THEN 'live' WHEN pe THEN 'orphaned' ELSE 'unreachable' END AS state, epoch_us(TIMESTAMP '1997-01-01') - epoch_us(t) > 90 * 86400000000 AS expired,
 CASE WHEN (epoch_us(TIMESTAMP '1997-01-01') - epoch_us(t)) // 1000000 < 60 THEN 'just now' ELSE 'past' END AS idle FROM p""", graph=False)
def gc_classify(spark, sf):
    now = F.to_timestamp(F.lit("1997-01-01 00:00:00"))
    rows = _t(spark, sf, "orders").selectExpr("o_orderkey id", "case when o_orderkey % 9 = 0 then null else 'r' end root", "o_orderkey % 2 = 0 rootExists", "o_orderkey % 3 = 0 parentExists", "cast(o_orderdate as timestamp) lastUsed")
    idle = status.humanize(F.floor((F.unix_micros(now) - F.unix_micros("lastUsed")) / 1_000_000))
    return status.removal(rows, now).select("id", "state", "expired", F.when(idle == "just now", idle).otherwise("past").alias("idle"))


# vectors


@query("WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id::VARCHAR AS id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 4) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.v) DESC, id LIMIT 10", graph=False)
def knn_cosine(spark, sf):
    vectors = _t(spark, sf, "embeddings")
    ask = vectors.where("vec_id = 0").select("embedding").first()[0]
    found = similarity.nearest(vectors.withColumn("nodeId", F.col("vec_id").cast("string")), ask, 10)
    return found.select("id", F.round("score", 4).alias("score"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3), s AS (SELECT n.id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS score FROM embeddings JOIN nodes n ON n.id = 'P' || vec_id, q) SELECT id, score FROM s WHERE score < 0.25 ORDER BY score DESC, id LIMIT 21")
def score_page(spark, sf):
    vectors = _t(spark, sf, "embeddings")
    ask = vectors.where("vec_id = 3").select("embedding").first()[0]
    scored = similarity.scored_nodes(star.nodes(spark, sf).where("kind = 'Function'"), vectors.select(F.concat(F.lit("P"), "vec_id").alias("nodeId"), "embedding"), ask)
    scored = scored.withColumn("score", F.round("score", 6))
    return paging.page_frame(scored.where("score < 0.25"), paging.SCORE, 21).select("id", "score")


@query("WITH q AS (SELECT vec_id AS \"queryId\", embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (1, 2, 3)), s AS (SELECT \"queryId\", vec_id::VARCHAR AS id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY \"queryId\" ORDER BY score DESC, id) AS r FROM s) SELECT \"queryId\", id, r AS rank FROM r WHERE r <= 5", graph=False)
def knn_batch(spark, sf):
    vectors = _t(spark, sf, "embeddings").withColumn("nodeId", F.col("vec_id").cast("string"))
    asks = vectors.where("vec_id in (1, 2, 3)").select(F.col("vec_id").alias("queryId"), "embedding")
    return similarity.nearest_each(vectors, asks, 5).select(F.col("queryId").cast("long").alias("queryId"), "id", F.col("rank").cast("long").alias("rank"))


@query("WITH t AS (SELECT vec_id % 50 AS id, i, avg(x) AS m FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 7 <> 0) GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(m * m)) AS n FROM t GROUP BY id) SELECT t.id, round(sum(i * m / n), 4) AS checksum FROM t JOIN n USING (id) GROUP BY t.id", graph=False)
def mean_pool(spark, sf):
    tokens = _t(spark, sf, "embeddings").selectExpr("vec_id % 50 id", "cast(vec_id div 50 as int) position", "case when vec_id % 7 <> 0 then 1 else 0 end mask", "embedding vector")
    out = similarity.pool(tokens).select("id", F.posexplode("embedding").alias("i", "x"))
    return out.groupBy("id").agg(F.round(F.sum((F.col("i") + 1) * F.col("x")), 4).alias("checksum"))


# wire form and ranks


@query("SELECT count(*) FILTER (event_id % 10 < 6) AS nodes, count(*) FILTER (event_id % 10 IN (6, 7)) AS edges, count(*) FILTER (event_id % 10 = 8) AS skipped FROM events", graph=False)
def ndjson_classify(spark, sf):
    e = _t(spark, sf, "events")
    node = "concat('{\"id\":\"', event_id, '\",\"kind\":\"Function\",\"name\":\"f\",\"qualifiedName\":\"f\",\"filePath\":\"a\",\"range\":{\"start\":{\"line\":1,\"col\":0},\"end\":{\"line\":2,\"col\":0}},\"exported\":true,\"language\":\"ts\"}')"
    edge = "concat('{\"id\":\"', event_id, '\",\"fromId\":\"a\",\"toId\":\"b\",\"kind\":\"CALLS\",\"source\":\"tree-sitter\",\"resolved\":false}')"
    lines = e.selectExpr(f"case when event_id % 10 < 6 then {node} when event_id % 10 < 8 then {edge} when event_id % 10 = 8 then '{{\"kind\":\"NOT_A_KIND\"' else '  ' end value")
    return ndjson.counters(ndjson.classify(lines))


@query("SELECT id, kind, name, startLine, exported FROM nodes WHERE kind = 'Type'")
def ndjson_round_trip(spark, sf):
    lines = ndjson.node_lines(star.nodes(spark, sf).where("kind = 'Type'"))
    nodes, _, _, _ = ndjson.split(ndjson.classify(lines))
    return nodes.select("id", "kind", "name", "startLine", "exported")


@query("""WITH u AS (SELECT a.filePath AS src, b.filePath AS dst, sqrt(count(*)) AS w FROM edges e JOIN nodes a ON a.id = e.fromId JOIN nodes b ON b.id = e.toId WHERE e.resolved AND e.kind IN ('CALLS', 'REFERENCES', 'IMPORTS') AND a.filePath <> b.filePath GROUP BY 1, 2),
s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM u), i AS (SELECT src AS id FROM u UNION SELECT dst FROM u), c AS (SELECT count(*) AS n FROM i),
d AS (SELECT id FROM i WHERE id NOT IN (SELECT src FROM u)), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM i, c),
""" + ",\n".join(f"r{k} AS (SELECT i.id, 0.15 / c.n + 0.85 * (coalesce(g.x, 0) + (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE id IN (SELECT id FROM d)) / c.n) AS r FROM i CROSS JOIN c LEFT JOIN (SELECT dst AS id, sum(p * r) AS x FROM s JOIN r{k - 1} ON r{k - 1}.id = s.src GROUP BY dst) g ON g.id = i.id)" for k in range(1, 7)) + " SELECT id, round(r, 8) AS rank FROM r6")
def pagerank_files(spark, sf):
    links = rank.file_links(star.nodes(spark, sf), star.edges(spark, sf, ["CALLS", "REFERENCES", "IMPORTS"], resolved=True))
    return rank.pagerank(links, rounds=6).select("id", F.round("rank", 8).alias("rank"))


@query("SELECT id, 1 AS rung FROM nodes WHERE qualifiedName = 'nation/5'")
def symbol_ladder(spark, sf):
    return rank.ladder(star.nodes(spark, sf), "nation/5").select("id", "rung")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a part's callers."""
    return page_callers(spark, sf_dir)
