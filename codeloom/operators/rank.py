"""A map of the most central files by PageRank, and the ladder of symbol lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.model import visible
from codeloom.operators.lookup import in_file_named
from codeloom.storage import cut

DAMPING, ROUNDS = 0.85, 20


def file_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, weight): files that use others, by the square root of how often."""
    used = edges.where(F.col("resolved") & F.col("kind").isin("CALLS", "REFERENCES", "IMPORTS")).select("fromId", "toId")
    at = nodes.select("id", "filePath")
    pairs = used.join(at.toDF("fromId", "src"), "fromId").join(at.toDF("toId", "dst"), "toId").where("src != dst")
    return pairs.groupBy("src", "dst").agg(F.sqrt(F.count(F.lit(1)).cast("double")).alias("weight"))


def pagerank(links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, cut_every: int = 5) -> DataFrame:
    """(id, rank) over weighted links (src, dst, weight). Nodes without links out give their rank to all alike.

    Ranks sum to 1. Each round is one join and one aggregation over links that stay partitioned by src. The links are
    cut first, as what they are made from is read and shuffled again at each use.
    """
    links = cut(links.select("src", "dst", "weight"))
    total = links.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = cut(links.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    ids = cut(links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct().join(total.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").withColumn("dangling", F.coalesce("dangling", F.lit(True))))
    n = ids.count()
    if n == 0:
        return ids.select("id", F.lit(0.0).alias("rank"))
    ranks = ids.select("id", "dangling", F.lit(1.0 / n).alias("rank"))
    for turn in range(1, rounds + 1):
        loose = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))  # one row
        given = shares.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        ranks = ids.join(given, "id", "left").join(F.broadcast(loose)).select("id", "dangling", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if turn % cut_every == 0:
            ranks = cut(ranks)
    return ranks.select("id", "rank")


def symbol_ranks(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(id, rank): a file's rank shared among its symbols by how often each is used."""
    uses = edges.where(F.col("kind").isin("CALLS", "REFERENCES")).groupBy(F.col("toId").alias("id")).agg(F.count(F.lit(1)).alias("uses"))
    own = nodes.where(visible() & ~F.col("kind").isin("File", "Module")).select("id", "filePath").join(uses, "id")
    part = F.col("uses") / F.sum("uses").over(W.partitionBy("filePath"))
    return own.withColumn("part", part).join(files.toDF("filePath", "rank"), "filePath").select("id", (F.col("rank") * F.col("part")).alias("rank"))


def within_budget(ranked: DataFrame, cost: str, budget: int, first: int = 1_000) -> DataFrame:
    """The best-ranked rows whose costs, none of them negative, fit a budget together.

    The best ``first`` rows are looked at, and eight times as many again until they cost more than the budget, so
    what is ordered in one task follows the answer's size and not the table's.
    """
    n, order = first, [F.desc("rank"), "id"]
    while True:
        top = ranked.orderBy(*order).limit(n)
        rows, total = top.agg(F.count(F.lit(1)), F.sum(cost)).first()
        if rows < n or total > budget:
            break
        n *= 8
    return top.withColumn("_sum", F.sum(cost).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).where(F.col("_sum") <= budget).drop("_sum")


def ladder(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes by the first of these that answers: id, qualified name, name, stem of their file; with its rung."""
    shown = nodes.where(visible())
    steps = [nodes.where(F.col("id") == name), shown.where(F.col("qualifiedName") == name), shown.where(F.col("name") == name), in_file_named(nodes, name)]
    found = reduce(DataFrame.unionByName, [s.withColumn("rung", F.lit(i)) for i, s in enumerate(steps)])
    return found.withColumn("_best", F.min("rung").over(W.partitionBy(F.lit(1)))).where("rung = _best").drop("_best").dropDuplicates(["id"])
