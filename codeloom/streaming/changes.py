"""Change events as streams: quiet paths, bursts, and micro-batches applied to stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators import changes
from codeloom.sources import ndjson
from codeloom.storage import TableRoot

DEBOUNCE, LATE = "300 milliseconds", "10 seconds"
_MICROS = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def watch(spark: SparkSession, folder: str, schema: str = "path string, ts timestamp", files_per_batch: int = 100) -> DataFrame:
    """Change notices that arrive as JSON files in a folder; the number a batch takes is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def _session(gap: str) -> tuple[Column, Column, Column]:
    """A session window, its start and its end, for sessions that end when nothing happens for ``gap`` or longer.

    Spark joins sessions that touch, so its gap is a microsecond less.
    """
    n, unit = gap.split()
    window = F.session_window("ts", f"{int(n) * _MICROS[unit.rstrip('s')] - 1} microseconds")
    return window, F.col("session_window.start"), F.col("session_window.end") + F.expr("interval 1 microsecond")


def debounce(events: DataFrame, gap: str = DEBOUNCE, late: str = LATE, key: str = "path") -> DataFrame:
    """One row for each time a path has been quiet for ``gap``: (key, first, fired, events). Events exactly a gap apart are two.

    On a stream the state of a path ends with its watermark.
    """
    events = events.withWatermark("ts", late) if events.isStreaming else events
    window, first, fired = _session(gap)
    out = events.groupBy(F.col(key), window).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, first.alias("first"), fired.alias("fired"), "events")


def burst(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """Bursts over all paths: (first, fired, events, paths). All rows share one key, so it is for notices, not for data."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    window, first, fired = _session(gap)
    out = events.groupBy(window).agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("path").alias("paths"))
    return out.select(first.alias("first"), fired.alias("fired"), "events", "paths")


def sessions_by_lag(events: DataFrame, gap_micros: int, key: str = "path") -> DataFrame:
    """Debounce on a batch by windows: a session begins where the last event of its path is a gap or more ago."""
    order = W.partitionBy(key).orderBy("ts")
    fresh = F.coalesce(F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order) >= gap_micros, F.lit(True))
    numbered = events.withColumn("_new", fresh.cast("int")).withColumn("session", F.sum("_new").over(order.rangeBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"))


def dirty_queue(events: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """Each path once, in the order first seen."""
    return events.groupBy(key).agg(F.min(order).alias("first_seen")).orderBy("first_seen")


def idle_sessions(events: DataFrame, key: str, idle: str) -> DataFrame:
    """Spans of use that idle times part."""
    return debounce(events, idle, key=key)


def apply_lines(root: TableRoot, lines: DataFrame, after: Callable[[DataFrame, DataFrame], None] | None = None) -> None:
    """One micro-batch of wire lines (value [, place]): upserts nodes and edges in one commit; then ``after`` (nodes, edges), whose failure isn't the batch's.

    Of lines with one id the last is taken: by place, a line's file and where in it its part begins, then as read.
    """
    order = [c for c in lines.columns if c == "place"]
    told = ndjson.classify(lines.select("value", F.struct(*order, F.monotonically_increasing_id().alias("at")).alias("seq")))
    last = [changes.last_wins(told.where(f"{kind} is not null").withColumn("id", F.col(f"{kind}.id")), "id", "seq").drop("id") for kind in ("node", "edge")]
    nodes, edges, declarations, _ = ndjson.split(last[0].unionByName(last[1]))
    none = nodes.select("id").limit(0)
    new = changes.apply_graph(root.read("nodes"), root.read("edges"), root.read("declarations"), nodes, none, edges, none, declarations)
    root.commit(dict(zip(("nodes", "edges", "declarations"), new, strict=True)))
    if after is not None:
        try:
            after(root.read("nodes"), root.read("edges"))
        except Exception as e:
            print(f"the pass after the batch failed: {e}")


def ingest(spark: SparkSession, folder: str, root: TableRoot, checkpoint: str, available_now: bool = True):
    """Starts a query that applies wire files of a folder; a batch that is replayed after a crash changes nothing more."""
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias("place")
    query = spark.readStream.text(folder).select("value", place).writeStream.foreachBatch(lambda df, batch: apply_lines(root, df)).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start() if available_now else query.start()
