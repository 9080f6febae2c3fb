"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Method (SRS: Sun, Wang, Qin, Zhang and Lin, 2014). Vectors are scaled to length one, so the largest cosine is the
least Euclidean distance, and projected by Gaussian (2-stable) directions to ``DIMS`` numbers. The squared projected
distance over the squared true one then follows a chi-square law. Neighbours are taken in the order of their
projected distance and verified on the original vectors; the search stops when, were there a vector nearer than the
k-th best so far, it would have been met already with probability ``SURE``.

On a cluster one kd-tree doesn't fit. Its splits, fitted on a bounded sample of projections, part all vectors into
leaves, and leaves over ``LEAF`` rows into blocks, the units that are met in projected order and verified. A query
first meets its own leaf, which bounds its k-th distance, and then the leaves that the stopping test can't rule out
by that bound: two rounds in which queries stream past the blocks that they must meet, each block's distances being
one matrix product. Equal vectors are one entry that carries its least ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch

DIMS = 6
#: Quantile 0.95 of the chi-square law with DIMS degrees of freedom.
CHI = 12.592
SURE = 0.95
LEAF = 1024
#: Squared distances that differ by less are ties, as those of parallel vectors of different length.
TIE = 12
#: The upper tree is fitted on at most so many projections and has at most so many leaves.
SAMPLE, MOST_LEAVES = 40_000, 4096
K = 5
SEED = 31


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim, DIMS))


class Splits:
    """The upper levels of a kd-tree: boxes of projections, by median splits of the widest side."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.axis, self.at, self.low, self.high = [], [], [], []
        self.leaf: list[int] = []
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self._grow(points, leaves, np.full(DIMS, -np.inf), np.full(DIMS, np.inf))

    def _grow(self, points: np.ndarray, leaves: int, lo: np.ndarray, hi: np.ndarray) -> int:
        node = len(self.axis)
        for x in (self.axis, self.low, self.high):
            x.append(-1)
        self.at.append(0.0)
        self.leaf.append(-1)
        side = np.ptp(points, axis=0) if len(points) else np.zeros(DIMS)
        if leaves < 2 or side.max() <= 0:
            self.leaf[node] = len(self.boxes)
            self.boxes.append((lo, hi))
            return node
        axis = int(np.argmax(side))
        cut = float(np.quantile(points[:, axis], (leaves // 2) / leaves))
        left = points[:, axis] < cut
        if not left.any():
            cut = float(np.min(points[points[:, axis] > cut, axis]))
            left = points[:, axis] < cut
        self.axis[node], self.at[node] = axis, cut
        lo2, hi2 = lo.copy(), hi.copy()
        lo2[axis], hi2[axis] = cut, cut
        self.low[node] = self._grow(points[left], leaves // 2, lo, hi2)
        self.high[node] = self._grow(points[~left], leaves - leaves // 2, lo2, hi)
        return node

    def assign(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        axis, at, low, high, leaf = (np.array(x) for x in (self.axis, self.at, self.low, self.high, self.leaf))
        while True:
            inner = np.flatnonzero(leaf[node] < 0)
            if not len(inner):
                return leaf[node]
            n = node[inner]
            node[inner] = np.where(points[inner, axis[n]] < at[n], low[n], high[n])

    def near(self, points: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point and a leaf whose box is within the point's squared distance."""
        lo, hi = np.array([b[0] for b in self.boxes]), np.array([b[1] for b in self.boxes])
        gap = np.maximum(np.maximum(lo - points[:, None], points[:, None] - hi), 0)
        return np.nonzero((gap * gap).sum(axis=2) <= radius2[:, None])


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    return np.array(col.flatten(), np.float64).reshape(-1, dim)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosines of rows of originals, in extended precision, so that equal ones are equal numbers."""
    a, b = (x.astype(np.longdouble) / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return ((a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))).astype(np.float64)


def _prepare(dim: int, splits):
    schema = pa.schema([("rep", pa.int64()), ("ids", pa.list_(pa.int64())), ("embedding", pa.list_(pa.float64())), ("leaf", pa.int64()), ("asked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = directions(dim)
        for batch in batches:
            if len(batch):
                x = _vectors(batch.column(2), dim)
                leaf = splits.value.assign(_unit(x) @ turn)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(leaf), batch.column(3)], schema=schema)

    return run


def _project(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _unit(_vectors(batch.column(0), dim)) @ directions(dim)
            bounds = np.arange(len(p) + 1, dtype=np.int32) * DIMS
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(bounds), pa.array(p.ravel()))], names=["p"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


FOUND = "query long, rep long, d2 double, score double"
MET = "leaf long, block long, asks boolean, id long, embedding array<double>, bound2 double"


def _search(dim: int, k: int):
    """Over rows of MET, sorted by block and within a block vectors before queries: the k nearest of each query in each block, within its bound."""
    schema = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("d2", pa.float64()), ("score", pa.float64())])

    def meet(ids: np.ndarray, x: np.ndarray, units: np.ndarray, query: np.ndarray, y: np.ndarray, bound2: np.ndarray) -> pa.RecordBatch:
        d2 = np.round(np.maximum(2 - 2 * (_unit(y) @ units.T), 0), TIE)
        if len(ids) > k:  # all that are no farther than the k-th, then the smallest ids of ties
            bound2 = np.minimum(bound2, np.partition(d2, k - 1, axis=1)[:, k - 1])
        q, row = np.nonzero(d2 <= bound2[:, None] + 10.0**-TIE)
        order = np.lexsort((ids[row], d2[q, row], q))
        q, row = q[order], row[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        q, row = q[nth < k], row[nth < k]
        return pa.RecordBatch.from_arrays([pa.array(query[q]), pa.array(ids[row]), pa.array(d2[q, row]), pa.array(cosines(y[q], x[row]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, block = None, [], None
        for batch in batches:
            leaf, part, asks, ids = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(4))
            x, bound2 = _vectors(batch.column(4), dim), batch.column(5).to_numpy(zero_copy_only=False)
            edge = (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])
            for i, j in zip(np.r_[0, np.flatnonzero(edge) + 1], np.r_[np.flatnonzero(edge) + 1, len(leaf)], strict=True):
                if i == j:
                    continue
                if here != (leaf[i], part[i]):
                    here, held, block = (leaf[i], part[i]), [], None
                if not asks[i]:
                    held.append((ids[i:j], x[i:j]))
                elif held:
                    if block is None:
                        rows = np.concatenate([h[1] for h in held])
                        block = (np.concatenate([h[0] for h in held]), rows, _unit(rows))
                    for m in range(i, j, 512):
                        to = min(j, m + 512)
                        yield meet(*block, ids[m:to], x[m:to], bound2[m:to])

    return run


def _route(dim: int, splits, blocks, first: bool):
    """A row of MET for each block that a query (query, embedding, leaf, bound2) must meet: those of its own leaf first, then the others."""
    schema = pa.schema([("leaf", pa.int64()), ("block", pa.int64()), ("asks", pa.bool_()), ("id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("bound2", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, many = directions(dim), np.asarray(blocks.value)
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                home, bound2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                if first:
                    q, leaf = np.arange(len(batch)), home
                else:
                    q, leaf = splits.value.near(_unit(_vectors(batch.column(1), dim)) @ turn, CHI * bound2)
                    q, leaf = q[leaf != home[q]], leaf[leaf != home[q]]
                n = many[leaf]
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q, leaf = np.repeat(q, n), np.repeat(leaf, n)
                for i in range(0, len(q), 4096):
                    s = slice(i, i + 4096)
                    take = pa.array(q[s])
                    cols = [pa.array(leaf[s]), pa.array(block[s]), pa.array(np.ones(len(q[s]), bool)), batch.column(0).take(take), batch.column(1).take(take), batch.column(3).take(take)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def nearest(vectors: DataFrame, is_query: str, k: int = K, dim: int | None = None) -> DataFrame:
    """The k nearest rows of each query row by cosine: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; ``is_query`` is a SQL condition on vec_id. Candidates are all rows but those
    with the query's own id; ties go to the smaller vec_id. Every row is indexed; the search may miss a neighbour,
    each with probability 1 - SURE or so.

    Vectors that are null, zero, or hold null or non-finite numbers take no part, nor do those whose length isn't
    ``dim`` (by default the commonest, the smaller if tied), nor rows with a null id. Rows that repeat an id and its
    vector count once; an id with several vectors is a candidate by each, with its best score. No rows give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    given = given.where(F.coalesce(fine, F.lit(False)))
    if dim is None:
        top = given.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        if top is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        dim = top["n"]
    given = given.where(F.size("embedding") == dim).withColumn("embedding", F.transform("embedding", lambda x: x + 0.0))
    asks = F.expr(is_query)
    keyed = given.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(3), "embedding"))
    # of equal vectors only the k + 1 smallest ids can be among anyone's k nearest
    ranked = keyed.select("h1", "h2", "vec_id").distinct().withColumn("r", F.row_number().over(W.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = ranked.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("rep"))
    queries = scratch.keep(keyed.where(asks).select("vec_id", "h1", "h2").distinct())
    asked = queries.select("h1", "h2").distinct().withColumn("asked", F.lit(True))
    first = keyed.join(classes, ["h1", "h2"]).where("vec_id = rep").dropDuplicates(["h1", "h2"])
    entries = scratch.keep(first.join(asked, ["h1", "h2"], "left").select("rep", "ids", "embedding", F.coalesce("asked", F.lit(False)).alias("asked"), "h1", "h2"))
    n = entries.count()
    taken = entries.orderBy(F.xxhash64("h1", "h2"), "h1").limit(min(SAMPLE, 40 * (n // LEAF + 1))).select("embedding")
    points = np.array(taken.mapInArrow(_project(dim), "p array<double>").toPandas()["p"].tolist(), np.float64).reshape(-1, DIMS)
    splits = spark.sparkContext.broadcast(Splits(points, min(MOST_LEAVES, n // LEAF + 1)))
    index = scratch.keep(entries.select("rep", "ids", "embedding", "asked").mapInArrow(_prepare(dim, splits), "rep long, ids array<long>, embedding array<double>, leaf long, asked boolean"))
    sizes = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / LEAF).alias("blocks"))  # at most MOST_LEAVES rows
    many = np.ones(len(splits.value.boxes), np.int64)
    for r in sizes.collect():
        many[r["leaf"]] = r["blocks"]
    blocks = spark.sparkContext.broadcast(many)
    data = index.join(F.broadcast(sizes), "leaf").select("leaf", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), F.lit(False).alias("asks"), F.col("rep").alias("id"), "embedding", F.lit(0.0).alias("bound2"))

    def visit(asking: DataFrame, first: bool) -> DataFrame:
        to = asking.select("query", "embedding", "leaf", "bound2").mapInArrow(_route(dim, splits, blocks, first), MET)
        met = data.unionByName(to).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "asks")
        return scratch.keep(met.mapInArrow(_search(dim, k + 1), FOUND))

    start = index.where("asked").select(F.col("rep").alias("query"), "embedding", "leaf", F.lit(4.0).alias("bound2"))
    home = visit(start, True)
    order = W.partitionBy("query").orderBy("d2", "rep")
    kth = home.withColumn("r", F.row_number().over(order)).where(F.col("r") == k + 1).select("query", F.col("d2").alias("bound2"))
    # a leaf with fewer than k + 1 entries bounds nothing: such a query visits all leaves (no distance is over 4)
    again = start.drop("bound2").join(kth, "query", "left").withColumn("bound2", F.coalesce("bound2", F.lit(4.0)))
    more = visit(again, False)
    splits.destroy()
    blocks.destroy()
    best = home.unionByName(more).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    by_id = entries.select(F.col("rep").alias("query"), "h1", "h2")
    pairs = queries.join(by_id, ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "query").join(best.select("query", "rep", "score"), "query")
    pairs = pairs.join(index.select("rep", "ids"), "rep").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")
