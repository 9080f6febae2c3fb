"""A property graph over the star schema: regions and nations are modules and files, the rest are symbols in them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import model


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: _table(spark, sf_dir, n)
    one = "0 startCol, 80 endCol, 'star' language"
    parts = [
        t("region").selectExpr("concat('R', r_regionkey) id", "'Module' kind", "r_name name", "concat('region/', r_name) qualifiedName", "concat('region/', r_name) filePath", "0 startLine", "0 endLine", "cast(null as string) signature", "true exported", "cast(null as string) docComment", "'external_module' nativeKind", "false hasSyntaxErrors"),
        t("nation").selectExpr("concat('N', n_nationkey) id", "'File' kind", "n_name name", "concat('nation/', n_nationkey) qualifiedName", "concat('nation/', n_nationkey) filePath", "0 startLine", "1000000000 endLine", "cast(null as string) signature", "true exported", "n_name docComment", "cast(null as string) nativeKind", "false hasSyntaxErrors"),
        t("customer").selectExpr("concat('C', c_custkey) id", "'Variable' kind", "c_name name", "concat('nation/', c_nationkey, '#', c_name) qualifiedName", "concat('nation/', c_nationkey) filePath", "cast(c_custkey as int) startLine", "cast(c_custkey as int) endLine", "c_mktsegment signature", "c_acctbal > 0 exported", "cast(null as string) docComment", "cast(null as string) nativeKind", "c_acctbal < -900 hasSyntaxErrors"),
        t("supplier").selectExpr("concat('S', s_suppkey) id", "'Type' kind", "s_name name", "concat('nation/', s_nationkey, '#', s_name) qualifiedName", "concat('nation/', s_nationkey) filePath", "cast(s_suppkey as int) startLine", "cast(s_suppkey + 40 + s_suppkey % 7 as int) endLine", "cast(null as string) signature", "true exported", "concat('  ', s_name, ' ') docComment", "cast(null as string) nativeKind", "false hasSyntaxErrors"),
        t("part").selectExpr("concat('P', p_partkey) id", "'Function' kind", "p_name name", "concat(p_brand, '.', p_name) qualifiedName", "concat('brand/', p_brand) filePath", "cast(p_partkey as int) startLine", "cast(p_partkey + p_size as int) endLine", "p_type signature", "p_size > 10 exported", "case when p_size > 25 then concat(p_name, ' ', p_type) end docComment", "cast(null as string) nativeKind", "false hasSyntaxErrors"),
    ]
    parts = [model.conform(p.selectExpr("*", *one.split(", ")), model.NODES) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Which key of a table an edge's end is made of, by the end, the edge's kind and the end's letter.
_KEYS = {
    ("fromId", "CALLS", "S"): "l_suppkey", ("toId", "CALLS", "P"): "l_partkey", ("fromId", "REFERENCES", "C"): "o_custkey", ("toId", "REFERENCES", "P"): "l_partkey",
    ("fromId", "SUPERTYPE_OF", "S"): "s_suppkey", ("fromId", "DEFINES", "N"): "nationkey", ("fromId", "EXPORTS", "N"): "s_nationkey", ("fromId", "IMPORTS", "N"): "n_nationkey",
}


def edges(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None, at: tuple[str, str] | None = None, resolved: bool = False) -> DataFrame:
    """The edges of some kinds; tables of other kinds are not read.

    ``resolved`` asks for resolved edges only: a pair is resolved if any of its rows is, so other rows are left out before pairs are formed.
    ``at`` (fromId or toId, an id) asks for one node's edges: the id is also put as a condition on the key that it is
    made of, which the scan takes, unlike one on the id.
    """

    def t(name: str) -> DataFrame:
        df = _table(spark, sf_dir, name)
        for (end, _, letter), key in _KEYS.items() if at else ():
            key = f"{name[0]}_{key}" if key == "nationkey" else key
            if (end, letter) == (at[0], at[1][0]) and key in df.columns and _KEYS.get((end, now[0], letter)) in (key, key[2:]):
                df = df.where(F.col(key) == int(at[1][1:]))
        return df

    now: list[str] = [""]
    source = "'tree-sitter' source", "cast(null as int) toDeclaration"

    def some(df: DataFrame, shown: Column) -> DataFrame:
        return df.where(shown) if resolved else df

    @cache
    def lines() -> int | None:
        return None if at else t("lineitem").count()  # of the files' footers

    def calls() -> DataFrame:
        shown = F.col("l_returnflag") != "N"
        pairs = _pairs(some(t("lineitem"), shown), "l_suppkey", "l_partkey", shown, lines())
        return pairs.selectExpr("concat('c|', l_suppkey, '|', l_partkey) id", "concat('S', l_suppkey) fromId", "concat('P', l_partkey) toId", "'CALLS' kind", "resolved", *source)

    def references() -> DataFrame:
        shown = F.col("o_orderstatus") == "F"
        uses = some(t("orders"), shown).join(t("lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        pairs = _pairs(uses, "o_custkey", "l_partkey", shown, lines())
        return pairs.selectExpr("concat('r|', o_custkey, '|', l_partkey) id", "concat('C', o_custkey) fromId", "concat('P', l_partkey) toId", "'REFERENCES' kind", "resolved", *source)

    made = {
        "IMPORTS": lambda: t("nation").selectExpr("concat('i|', n_nationkey) id", "concat('N', n_nationkey) fromId", "concat('R', n_regionkey) toId", "'IMPORTS' kind", "true resolved", *source),
        "DEFINES": lambda: t("customer")
        .selectExpr("concat('d|C', c_custkey) id", "concat('N', c_nationkey) fromId", "concat('C', c_custkey) toId", "'DEFINES' kind", "true resolved", *source)
        .unionByName(t("supplier").selectExpr("concat('d|S', s_suppkey) id", "concat('N', s_nationkey) fromId", "concat('S', s_suppkey) toId", "'DEFINES' kind", "true resolved", *source)),
        "CALLS": calls,
        "REFERENCES": references,
        "SUPERTYPE_OF": lambda: t("supplier").where("s_suppkey >= 2").selectExpr("concat('s|', s_suppkey) id", "concat('S', s_suppkey) fromId", "concat('S', s_suppkey div 2) toId", "'SUPERTYPE_OF' kind", "s_suppkey % 3 <> 0 resolved", *source),
        "EXPORTS": lambda: t("supplier").where("s_acctbal > 0").selectExpr("concat('e|', s_suppkey) id", "concat('N', s_nationkey) fromId", "concat('S', s_suppkey) toId", "'EXPORTS' kind", "true resolved", *source),
    }
    out = None
    for kind in kinds or model.EDGE_KINDS:
        now[0] = kind
        part = some(model.conform(made[kind](), model.EDGES), F.col("resolved"))
        out = part if out is None else out.unionByName(part)
    return out


#: About so many rows of a table are made into pairs by one task, whatever the table's size.
TASK_ROWS = 500_000
#: One end's rows are dealt to so many tasks at most, so that a hot end isn't left to one, and its pairs still lie close.
_SHARES = 16


def _pairs(rows: DataFrame, own: str, far: str, shown: Column, total: int | None) -> DataFrame:
    """(own, far, resolved) for each pair of keys, resolved if ``shown`` holds for any of its rows.

    ``total`` is about how many rows there are. What a task holds is then bounded by their number in it; Spark's own
    parts grow with the files' and are grouped before and after the shuffle. Without it they are left to Spark.
    """
    if total is None:
        return rows.groupBy(own, far).agg(F.max(shown).alias("resolved"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    dealt = rows.select(own, far, shown.alias("resolved"), F.pmod(F.hash(far), F.lit(_SHARES)).alias("_share")).repartition(tasks, own, "_share")
    return dealt.groupBy(own, far, "_share").agg(F.max("resolved").alias("resolved")).drop("_share")


#: The same views for DuckDB, as common table expressions.
SQL = """
nodes AS (
 SELECT 'R' || r_regionkey AS id, 'Module' AS kind, r_name AS name, 'region/' || r_name AS qualifiedName, 'region/' || r_name AS filePath, 0 AS startLine, 0 AS endLine, NULL::VARCHAR AS signature, true AS exported, NULL::VARCHAR AS docComment, 'external_module' AS nativeKind, false AS hasSyntaxErrors FROM region
 UNION ALL SELECT 'N' || n_nationkey, 'File', n_name, 'nation/' || n_nationkey, 'nation/' || n_nationkey, 0, 1000000000, NULL, true, n_name, NULL, false FROM nation
 UNION ALL SELECT 'C' || c_custkey, 'Variable', c_name, 'nation/' || c_nationkey || '#' || c_name, 'nation/' || c_nationkey, c_custkey::INT, c_custkey::INT, c_mktsegment, c_acctbal > 0, NULL, NULL, c_acctbal < -900 FROM customer
 UNION ALL SELECT 'S' || s_suppkey, 'Type', s_name, 'nation/' || s_nationkey || '#' || s_name, 'nation/' || s_nationkey, s_suppkey::INT, (s_suppkey + 40 + s_suppkey % 7)::INT, NULL, true, '  ' || s_name || ' ', NULL, false FROM supplier
 UNION ALL SELECT 'P' || p_partkey, 'Function', p_name, p_brand || '.' || p_name, 'brand/' || p_brand, p_partkey::INT, (p_partkey + p_size)::INT, p_type, p_size > 10, CASE WHEN p_size > 25 THEN p_name || ' ' || p_type END, NULL, false FROM part),
edges AS (
 SELECT 'i|' || n_nationkey AS id, 'N' || n_nationkey AS fromId, 'R' || n_regionkey AS toId, 'IMPORTS' AS kind, true AS resolved FROM nation
 UNION ALL SELECT 'd|C' || c_custkey, 'N' || c_nationkey, 'C' || c_custkey, 'DEFINES', true FROM customer
 UNION ALL SELECT 'd|S' || s_suppkey, 'N' || s_nationkey, 'S' || s_suppkey, 'DEFINES', true FROM supplier
 UNION ALL SELECT 'c|' || l_suppkey || '|' || l_partkey, 'S' || l_suppkey, 'P' || l_partkey, 'CALLS', bool_or(l_returnflag <> 'N') FROM lineitem GROUP BY l_suppkey, l_partkey
 UNION ALL SELECT 'r|' || o_custkey || '|' || l_partkey, 'C' || o_custkey, 'P' || l_partkey, 'REFERENCES', bool_or(o_orderstatus = 'F') FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey
 UNION ALL SELECT 's|' || s_suppkey, 'S' || s_suppkey, 'S' || (s_suppkey // 2), 'SUPERTYPE_OF', s_suppkey % 3 <> 0 FROM supplier WHERE s_suppkey >= 2
 UNION ALL SELECT 'e|' || s_suppkey, 'N' || s_nationkey, 'S' || s_suppkey, 'EXPORTS', true FROM supplier WHERE s_acctbal > 0)
"""
