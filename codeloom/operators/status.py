"""Reports: coverage, staleness, and which stored projects are due for removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPIRE_DAYS = 90


def staleness(listing: DataFrame, baselines: DataFrame) -> DataFrame:
    """(filePath, state) for files (filePath, mtime, content): new, fresh, touched or changed.

    Content is hashed only where the time differs from the baseline (filePath, mtime, contentHash).
    """
    known = baselines.select("filePath", F.col("mtime").alias("_m"), F.col("contentHash").alias("_h"))
    met = listing.join(known, "filePath", "left")
    same = F.when(F.col("mtime") != F.col("_m"), F.sha2("content", 256) == F.col("_h"))
    return met.select("filePath", F.when(F.col("_m").isNull(), "new").when(F.col("mtime") == F.col("_m"), "fresh").when(same, "touched").otherwise("changed").alias("state"))


def coverage(discovered: DataFrame, file_nodes: DataFrame, listing: DataFrame, baselines: DataFrame) -> DataFrame:
    """One row: discovered, indexed, coverage (1.0 without files) and dirty. A file without a baseline isn't dirty."""
    files = discovered.select("filePath").distinct()
    indexed = file_nodes.select("filePath").distinct().withColumn("_i", F.lit(1))
    then = baselines.select("filePath", F.col("mtime").alias("_m"))
    met = files.join(indexed, "filePath", "left").join(listing.select("filePath", "mtime"), "filePath", "left").join(then, "filePath", "left")
    n, i = F.count(F.lit(1)), F.coalesce(F.sum("_i"), F.lit(0))
    dirty = F.count_if(F.col("_m").isNotNull() & F.col("mtime").isNotNull() & (F.col("mtime") != F.col("_m")))
    return met.agg(n.alias("discovered"), i.alias("indexed"), F.when(n == 0, 1.0).otherwise(i / n).cast("double").alias("coverage"), dirty.alias("dirty"))


def removal(projects: DataFrame, now: Column, days: int = EXPIRE_DAYS) -> DataFrame:
    """projects (id, root, rootExists, parentExists, lastUsed) with state and expired.

    A root that is gone while its parent stands was deleted; gone with its parent it may be a disk that isn't there.
    """
    state = F.when(F.col("root").isNull(), "legacy").when(F.col("rootExists"), "live").when(F.col("parentExists"), "orphaned").otherwise("unreachable")
    idle = F.greatest(F.lit(0), F.unix_micros(now) - F.unix_micros("lastUsed"))
    return projects.withColumn("state", state).withColumn("expired", F.coalesce(idle > days * 86_400_000_000, F.lit(False)))


def humanize(seconds: Column) -> Column:
    """An idle time in words."""

    def some(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    whole = lambda n: F.floor(seconds / n)
    return F.when(seconds < 60, "just now").when(seconds < 3600, some(whole(60), "minute")).when(seconds < 86400, some(whole(3600), "hour")).otherwise(some(whole(86400), "day"))
