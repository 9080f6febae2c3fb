"""Bounded walks over the graph.

Two forms. ``reach`` is a breadth-first search by joins, for any size: what it finds and at which depth equals the
path walk's as long as no budget binds, because shortest paths are simple. ``path_walk`` counts every simple path as
a row, keeps a budget of rows and can be resumed; its state is at most the budget, so it lives on the driver, and
each level is one join of that small frontier with the edges.
"""

from __future__ import annotations

import base64
import gzip
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.lookup import within
from codeloom.operators.neighbors import ends
from codeloom.storage import cut

MAX_DEPTH, MAX_FANOUT, BUDGET = 5, 50, 5000


def steps(edges: DataFrame, direction: str, kind: str | None = None, max_fanout: int | None = MAX_FANOUT) -> DataFrame:
    """(src, dst, id, rank): edges in walking direction, the first ``max_fanout`` of each node by (resolved, id)."""
    own, other = ends(direction)
    out = within(edges, "kind", [kind] if kind else None).select(F.col(own).alias("src"), F.col(other).alias("dst"), "id", "resolved")
    order = W.partitionBy("src").orderBy(F.col("resolved").cast("int").desc(), "id")
    out = out.withColumn("rank", F.row_number().over(order)).drop("resolved")
    return out if max_fanout is None else out.where(F.col("rank") <= max_fanout)


def reach(edges: DataFrame, starts: DataFrame, direction: str, kind: str | None = None, max_depth: int = MAX_DEPTH, max_fanout: int | None = MAX_FANOUT) -> DataFrame:
    """(id, depth): nodes within max_depth of any start, at their least depth.

    Each level joins the frontier's edges only, ranks them after the join, and is cut; it ends early when nothing
    new is met.
    """
    own, other = ends(direction)
    used = within(edges, "kind", [kind] if kind else None).select(F.col(own).alias("src"), F.col(other).alias("dst"), "id", F.col("resolved").cast("int").alias("r"))
    seen = cut(starts.select(F.col("id")).distinct().withColumn("depth", F.lit(0)))
    frontier = seen.select("id")
    for depth in range(1, max_depth + 1):
        out = used.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi")
        if max_fanout is not None:
            out = out.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc("r"), "id"))).where(F.col("rank") <= max_fanout)
        fresh = cut(out.select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh.withColumn("depth", F.lit(depth)))
        frontier = fresh
    return seen


def overfull(edges: DataFrame, ids: DataFrame, direction: str, kind: str | None, max_fanout: int) -> DataFrame:
    """The ids among ``ids`` with more edges than the fanout allows."""
    own, _ = ends(direction)
    used = within(edges, "kind", [kind] if kind else None).select(F.col(own).alias("id")).join(ids.select("id").distinct(), "id", "left_semi")
    return used.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_fanout).select("id")


def frontier_open(edges: DataFrame, seen: DataFrame, direction: str, kind: str | None, max_depth: int) -> DataFrame:
    """Nodes at the depth limit that have an edge to a node not reached."""
    own, other = ends(direction)
    last = seen.where(F.col("depth") == max_depth).select("id")
    used = within(edges, "kind", [kind] if kind else None).select(F.col(own).alias("id"), F.col(other).alias("dst")).join(last, "id", "left_semi")
    return used.join(seen.select(F.col("id").alias("dst")), "dst", "left_anti").select("id").distinct()


def truncation(edges: DataFrame, seen: DataFrame, direction: str, kind: str | None, max_depth: int, max_fanout: int, budget_hit: bool = False) -> str | None:
    """Why a walk isn't the whole closure: budget before fanout before depth."""
    if budget_hit:
        return "budget"
    if not overfull(edges, seen.where(F.col("depth") < max_depth), direction, kind, max_fanout).isEmpty():
        return "maxFanout"
    return None if frontier_open(edges, seen, direction, kind, max_depth).isEmpty() else "maxDepth"


@dataclass
class State:
    """What a resumed walk must know: options, nodes with depths, edges walked."""

    direction: str
    kind: str | None
    max_depth: int
    max_fanout: int
    visited: dict[str, int]
    walked: list[str]

    def token(self) -> str:
        text = json.dumps({"direction": self.direction, "edge_kind": self.kind, "max_depth": self.max_depth, "max_fanout": self.max_fanout, "visited": self.visited, "walked": self.walked}, separators=(",", ":"))
        return base64.b64encode(gzip.compress(text.encode(), mtime=0)).decode()

    @classmethod
    def read(cls, token: str) -> State:
        try:
            held = json.loads(gzip.decompress(base64.b64decode(token, validate=True)))
            return cls(held["direction"], held["edge_kind"], held["max_depth"], held["max_fanout"], held["visited"], held["walked"])
        except (ValueError, KeyError, TypeError, OSError, EOFError) as e:
            raise ValueError("not a resume token") from e


@dataclass
class Walk:
    """nodes: (id, depth) by depth, then id; edges: ids in the order walked; visited_rows counts paths, the root's too."""

    nodes: list[tuple[str, int]]
    edges: list[str]
    visited_rows: int
    truncated_by: str | None = None
    frontier: list[str] = field(default_factory=list)
    resume_token: str | None = None


def path_walk(edges: DataFrame, start: str, direction: str, kind: str | None = None, max_depth: int = MAX_DEPTH, max_fanout: int = MAX_FANOUT, budget: int = BUDGET) -> Walk:
    """Simple paths from a start: a row for each, children in (resolved, id) order, ``budget`` rows at most."""
    return _walk(edges, State(direction, kind, max_depth, max_fanout, {start: 0}, []), budget, fresh=True)


def resume_walk(edges: DataFrame, token: str, budget: int = BUDGET) -> Walk:
    """The next part of a walk that was cut: only nodes and edges that earlier parts didn't return."""
    return _walk(edges, State.read(token), budget, fresh=False)


def _walk(edges: DataFrame, state: State, budget: int, fresh: bool) -> Walk:
    spark = edges.sparkSession
    before, walked = dict(state.visited), set(state.walked)
    depths = dict(before)
    found: dict[str, None] = {}
    rows = 1 if fresh else 0
    frontier = [(i, depth, [i]) for i, depth in sorted(before.items(), key=lambda x: (x[1], x[0])) if depth < state.max_depth]
    ranked = steps(edges, state.direction, state.kind, None)
    seeds = True
    while frontier and rows < budget:
        small = spark.createDataFrame([(n, i, d, p) for n, (i, d, p) in enumerate(frontier)], "n long, src string, depth int, path array<string>")
        one = within(edges, "kind", [state.kind] if state.kind else None)
        own, other = ends(state.direction)
        at = one.join(F.broadcast(small.select(F.col("src").alias(own)).distinct()), own, "left_semi")  # at most `budget` ids
        ranked = steps(at, state.direction, None, state.max_fanout)
        met = ranked.join(F.broadcast(small), "src").where(~F.expr("array_contains(path, dst)"))
        if seeds and walked:
            done = spark.createDataFrame([(e,) for e in walked], "id string")
            met = met.join(done, "id", "left_anti")
        got = met.orderBy("n", "rank").limit(budget - rows).select("id", "dst", "depth", "path").collect()
        rows += len(got)
        frontier = []
        for edge, dst, depth, path in got:
            found.setdefault(edge)
            if dst not in before:
                depths[dst] = min(depths.get(dst, depth + 1), depth + 1)
                if depth + 1 < state.max_depth:
                    frontier.append((dst, depth + 1, [*path, dst]))
        seeds = False
    new = [(i, d) for i, d in depths.items() if fresh or i not in before]
    new.sort(key=lambda x: (x[1], x[0]))
    out = Walk(new, [e for e in found if e not in walked], rows)
    seen = spark.createDataFrame(list(depths.items()), "id string, depth int")
    out.truncated_by = truncation(edges, seen, state.direction, state.kind, state.max_depth, state.max_fanout, rows >= budget)
    if out.truncated_by == "maxDepth":
        out.frontier = sorted(i for i, d in depths.items() if d == state.max_depth)
    if out.truncated_by == "budget":
        out.resume_token = State(state.direction, state.kind, state.max_depth, state.max_fanout, depths, [*state.walked, *out.edges]).token()
    return out


def cut_to_bytes(walk: Walk, rows: list[dict], state: State, budget: int) -> tuple[list[dict], Walk]:
    """The prefix of a walk's result rows (the anchor left out) that fits a byte budget, with a token for the rest.

    ``rows`` are the result rows by id, in the walk's order; the token knows the kept ids and their edges only.
    """
    used, kept = 1, []
    for row in rows:
        used += len(json.dumps(row, separators=(",", ":"), ensure_ascii=False).encode()) + 1
        if used > budget and kept:
            break
        kept.append(row)
    if len(kept) == len(rows):
        return rows, walk
    ids = {r["id"] for r in kept}
    visited = {i: d for i, d in walk.nodes if i in ids or d == 0} | state.visited
    edges = [e for e in (r.get("edge") for r in kept) if e is not None]
    token = State(state.direction, state.kind, state.max_depth, state.max_fanout, visited, [*state.walked, *edges]).token()
    return kept, Walk([n for n in walk.nodes if n[0] in visited], edges, walk.visited_rows, "responseSize", [], token)
