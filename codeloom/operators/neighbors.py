"""Neighbours of a node over one hop: pages, tallies by file, candidate ranking, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.lookup import within

INCOMING, OUTGOING = "incoming", "outgoing"
REFERENCE_KINDS = ["CALLS", "REFERENCES", "SUPERTYPE_OF"]


def ends(direction: str) -> tuple[str, str]:
    """(the anchor's column, the neighbour's column) of an edge."""
    if direction not in (INCOMING, OUTGOING):
        raise ValueError(direction)
    return ("toId", "fromId") if direction == INCOMING else ("fromId", "toId")


def neighbors(nodes: DataFrame, edges: DataFrame, anchor_id: str, anchor_path: str | None, direction: str, kinds: list[str] | None = None, file_paths: list[str] | None = None) -> DataFrame:
    """The edges at an anchor with the node at their other end, ready for structural order.

    Edges to nodes that don't exist don't show. locality is 0 in the anchor's own file.
    """
    own, other = ends(direction)
    near = within(edges.where(F.col(own) == anchor_id), "kind", kinds)
    far = within(nodes, "filePath", file_paths).select(F.col("id").alias("nodeId"), F.col("kind").alias("nodeKind"), "name", "qualifiedName", "filePath", "startLine", "signature", "docComment")
    local = F.when(F.col("filePath").eqNullSafe(F.lit(anchor_path)), 0).otherwise(1)
    return near.join(far, F.col(other) == F.col("nodeId")).select("id", F.col("kind").alias("edgeKind"), "resolved", F.col("resolved").cast("int").alias("resolvedRank"), local.alias("locality"), "nodeId", "nodeKind", "name", "qualifiedName", "filePath", "startLine")


def tally(found: DataFrame, limit: int = 200) -> DataFrame:
    """How many rows each file has, over all of them and not over a page."""
    return found.groupBy("filePath").agg(F.count(F.lit(1)).alias("refs")).orderBy(F.desc("refs"), "filePath").limit(limit)


def tally_wanted(has_more: bool, rows: int, files: int) -> bool:
    """A tally is worth sending if the page isn't all, or files have several rows."""
    return has_more or rows > files


def with_popularity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates with score: how many references and calls come in. The count is made before the join."""
    uses = edges.where(F.col("kind").isin("REFERENCES", "CALLS")).join(nodes.select(F.col("id").alias("toId")), "toId", "left_semi")
    uses = uses.groupBy("toId").agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(uses, nodes["id"] == uses["toId"], "left").withColumn("score", F.coalesce("n", F.lit(0)).cast("double")).drop("toId", "n")


def outline(nodes: DataFrame, edges: DataFrame, file_id: str) -> DataFrame:
    """What a file defines; page it by position."""
    inner = edges.where((F.col("fromId") == file_id) & (F.col("kind") == "DEFINES")).select("toId")
    return nodes.join(inner, nodes["id"] == inner["toId"]).drop("toId")


def incident_counts(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, edges): how many edges touch each id, loops once; ids without edges have 0."""
    ends_of = edges.select(F.col("fromId").alias("id")).unionByName(edges.where("fromId != toId").select(F.col("toId").alias("id")))
    counted = ends_of.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return ids.select("id").distinct().join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("edges"))


def distinct_edge_kinds(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, kind): the kinds of edges that point at each id."""
    return edges.select(F.col("toId").alias("id"), "kind").join(ids.select("id").distinct(), "id", "left_semi").distinct()
