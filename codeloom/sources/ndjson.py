"""The wire form: one node or edge object a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import model

_RANGE = "struct<start:struct<line:int,col:int>,end:struct<line:int,col:int>>"
NODE_WIRE = f"id string, kind string, name string, qualifiedName string, filePath string, range {_RANGE}, signature string, exported boolean, docComment string, language string, nativeKind string, hasSyntaxErrors boolean, declarations array<struct<range:{_RANGE},signature:string,hasBody:boolean>>"
EDGE_WIRE = "id string, fromId string, toId string, kind string, source string, resolved boolean, toDeclaration int"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def classify(lines: DataFrame) -> DataFrame:
    """lines (value) with node, edge and bad: each line is a node if it reads as one, else an edge, else bad; blanks go.

    Works on batches and on streams. A column seq, the lines' order, is carried along.
    """
    text = F.regexp_replace("value", r"\r$", "")
    order = [c for c in lines.columns if c == "seq"]
    out = lines.select(text.alias("value"), *order).where(F.trim("value") != "")
    out = out.withColumn("n", F.from_json("value", NODE_WIRE)).withColumn("e", F.from_json("value", EDGE_WIRE))
    n, e = F.col("n"), F.col("e")
    kind_ok = n["kind"].isin(model.NODE_KINDS) & n["id"].isNotNull() & n["name"].isNotNull() & n["filePath"].isNotNull() & n["range"].isNotNull()
    edge_ok = e["kind"].isin(model.EDGE_KINDS) & e["source"].isin(model.EDGE_SOURCES) & e["id"].isNotNull() & e["fromId"].isNotNull() & e["toId"].isNotNull()
    node = F.coalesce(kind_ok, F.lit(False))
    edge = ~node & F.coalesce(edge_ok, F.lit(False))
    return out.select("value", *order, F.when(node, n).alias("node"), F.when(edge, e).alias("edge"), (~node & ~edge).alias("bad"))


def split(classified: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, declarations, bad lines) of classified lines."""
    rows = classified.where("node is not null").select("node.*")
    flat = rows.withColumns({"startLine": F.col("range.start.line"), "startCol": F.col("range.start.col"), "endLine": F.col("range.end.line"), "endCol": F.col("range.end.col"), "hasSyntaxErrors": F.coalesce("hasSyntaxErrors", F.lit(False))})
    child = rows.where(F.size("declarations") > 1).select(F.col("id").alias("nodeId"), F.posexplode("declarations").alias("ordinal", "d"))
    child = child.select("nodeId", "ordinal", F.col("d.range.start.line").alias("startLine"), F.col("d.range.start.col").alias("startCol"), F.col("d.range.end.line").alias("endLine"), F.col("d.range.end.col").alias("endCol"), F.col("d.signature").alias("signature"), F.col("d.hasBody").alias("hasBody"))
    edges = classified.where("edge is not null").select("edge.*")
    return model.conform(flat, model.NODES), model.conform(edges, model.EDGES), model.conform(child, model.DECLARATIONS), classified.where("bad").select("value")


def counters(classified: DataFrame) -> DataFrame:
    """One row: nodes, edges, skipped."""
    return classified.agg(F.count("node").alias("nodes"), F.count("edge").alias("edges"), F.count_if("bad").alias("skipped"))


def _wire_range() -> Column:
    return F.struct(F.struct(F.col("startLine").alias("line"), F.col("startCol").alias("col")).alias("start"), F.struct(F.col("endLine").alias("line"), F.col("endCol").alias("col")).alias("end"))


def node_lines(nodes: DataFrame) -> DataFrame:
    """Compact JSON, a line each; fields without a value are left out."""
    return nodes.select(F.to_json(F.struct("id", "kind", "name", "qualifiedName", "filePath", _wire_range().alias("range"), "signature", "exported", "docComment", "language", "nativeKind", F.when(F.col("hasSyntaxErrors"), True).alias("hasSyntaxErrors"))).alias("value"))


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct(*model.EDGE_COLUMNS)).alias("value"))


def response_json(rows: DataFrame) -> DataFrame:
    """Response objects keep their nulls."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)
