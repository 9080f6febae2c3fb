"""Connected components of an edge table by large-star and small-star rounds (Kiveris et al., 2014).

Each round hooks nodes to the least node they know and shortens paths, so the number of rounds is about the
logarithm of the longest chain. Nothing is collected: a round is two aggregations and two joins on disk. Rounds end as
soon as every node points at a node that points nowhere, which one aggregation tells. While there are few edges a round
is one task and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch, settings

#: Up to so many edges are taken through a round by one task.
FEW = 50_000


def _rows(pairs: DataFrame, *rows: tuple[str, str]) -> DataFrame:
    """(u, v) by other columns of ``pairs``; a union would lose that they lie in one partition."""
    return pairs.select(F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in rows])))


def _hook(pairs: DataFrame, both: bool) -> DataFrame:
    """One half round over pairs (u, v) with u > v."""
    seen = _rows(pairs, ("u", "v"), ("v", "u")) if both else pairs
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = seen.join(least, "u")
    if both:
        return _rows(met.where("v > u"), ("v", "m")).distinct()
    return _rows(met, ("u", "m"), ("v", "m")).where("u > v").distinct()


def _flat(state: DataFrame) -> bool:
    """Whether each u points at one v only, and no v points any further."""
    end = lambda node, out: F.struct(F.col(node).alias("node"), F.lit(out).alias("out"), F.lit(1 - out).alias("into"))
    ends = state.select(F.inline(F.array(end("u", 1), end("v", 0))))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where("out > 1 or (out = 1 and into = 1)").agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    ``edges`` has two columns of one orderable type; loops, repeated edges, either direction and nulls are
    allowed (edges with a null are ignored, loops give no node).
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    state = scratch.keep(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _flat(near := state.coalesce(1) if state.count() <= FEW else state):
        with settings(scratch.spark, {"spark.sql.maxSinglePartitionBytes": str(1 << 62)}):  # sizes of joins are guessed as products
            new = scratch.keep(_hook(_hook(near, True), False))
        scratch.drop(state)
        state = new
    centres = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
