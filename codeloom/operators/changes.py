"""Snapshots, diffs and upserts: how a graph table changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, change): added, removed or changed, by full field equality with nulls equal; equal rows don't show."""
    fields = [c for c in after.columns if c != key]
    a = before.select(key, F.struct(*fields).alias("_a"))
    b = after.select(key, F.struct(*fields).alias("_b"))
    met = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return met.select(key, change.alias("change")).where("change is not null")


def net(deletes: DataFrame, upserts: DataFrame, key: str = "id") -> DataFrame:
    """The deletes that hold: an id that is also upserted survives, whichever came first."""
    return deletes.select(key).distinct().join(upserts.select(key), key, "left_anti")


def last_wins(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Of rows with one key the last by an order column."""
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order))))
    return ranked.where("_r = 1").drop("_r")


def apply(table: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """The table after a diff. One anti-join takes out what goes and what is replaced."""
    out = net(deletes, upserts, key).unionByName(upserts.select(key)).distinct()
    return table.join(out, key, "left_anti").unionByName(upserts.select(*table.columns))


def apply_graph(nodes: DataFrame, edges: DataFrame, declarations: DataFrame, upsert_nodes: DataFrame, delete_nodes: DataFrame, upsert_edges: DataFrame, delete_edges: DataFrame, upsert_declarations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables after a diff. A node that is upserted has its declarations replaced as a whole."""
    touched = upsert_nodes.select(F.col("id").alias("nodeId")).unionByName(net(delete_nodes, upsert_nodes).select(F.col("id").alias("nodeId"))).distinct()
    kept = declarations.join(touched, "nodeId", "left_anti").unionByName(upsert_declarations.select(*declarations.columns))
    return apply(nodes, upsert_nodes, delete_nodes), apply(edges, upsert_edges, delete_edges), kept


def group_declarations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and their declarations from one row a declaration (id, ..., signature, docComment, exported, hasBody, ranges).

    Rows of one id are one symbol: its range is the first body's, else the first declaration's; its signature the
    first that stands without a body, else the first; its comment the first there is; exported if any is.
    Declarations are kept for symbols with several.
    """
    place = F.struct("startLine", "startCol")
    ordered = rows.withColumn("ordinal", F.row_number().over(W.partitionBy("id").orderBy("startLine", "startCol")) - 1)
    span = F.struct("startLine", "startCol", "endLine", "endCol")
    first = lambda c, when: F.min_by(F.when(when, c), F.when(when, place))
    head = ordered.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(first(span, F.col("hasBody")), F.min_by(span, place)).alias("span"),
        F.coalesce(first(F.col("signature"), ~F.col("hasBody") & F.col("signature").isNotNull()), first(F.col("signature"), F.col("signature").isNotNull())).alias("signature"),
        first(F.col("docComment"), F.col("docComment").isNotNull()).alias("docComment"), F.bool_or("exported").alias("exported"),
        *[F.min_by(c, place).alias(c) for c in rows.columns if c not in ("id", "startLine", "startCol", "endLine", "endCol", "signature", "docComment", "exported", "hasBody")],
    )
    several = head.where("n > 1").select(F.col("id").alias("nodeId"))
    child = ordered.withColumnRenamed("id", "nodeId").join(several, "nodeId", "left_semi").select("nodeId", "ordinal", "startLine", "startCol", "endLine", "endCol", "signature", "hasBody")
    return head.select("*", "span.*").drop("span", "n"), child


def union(parts: list[DataFrame]) -> DataFrame:
    """Rows of several plugins in one table."""
    return reduce(DataFrame.unionByName, parts)


def digest(files: DataFrame, *by: str) -> DataFrame:
    """(*by, digest): one hash over the files (filePath, contentHash) of each build in path order; a build's files are few."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("filePath", "contentHash"))), lambda f: F.concat_ws("\u0000", f["filePath"], f["contentHash"]))
    return files.groupBy(*by).agg(F.sha2(F.array_join(line, "\n"), 256).alias("digest"))
