"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A document of more bytes isn't taken as an example, so a sample's size is bounded in bytes too.
MOST_BYTES = 64 << 10


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo a divisor: a fold that any engine can tell."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def sample(docs: DataFrame, labels: DataFrame, label: str, bounds: dict[int, int], divisor: int, held: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``bounds[value]`` documents for each label value, none of the held-out fold or over MOST_BYTES.

    Which ones: those of least hash of the id, so the sample doesn't depend on the order of rows. Ids that are
    labelled more than once have their least label.
    """
    told = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", divisor) != held))
    told = told.groupBy("doc_id").agg(F.min(label).alias("y")).withColumn("_h", F.xxhash64("doc_id"))
    parts = [told.where(F.col("y") == value).orderBy("_h", "doc_id").limit(n) for value, n in bounds.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    # at most sum(bounds) ids are sent, whatever the size of the tables
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")
    rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_BYTES).select("text", "y").collect()
    return [(r[0] or "", int(r[1])) for r in rows]


def shares(labels: DataFrame, label: str, divisor: int, held: int) -> dict[int, float]:
    """The share of each label value among all labelled rows outside the held-out fold."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", divisor) != held)).groupBy(F.col(label).alias("y")).count().collect()
    total = sum(r["count"] for r in rows) or 1
    return {int(r["y"]): r["count"] / total for r in rows}
