"""Exact vector search and embedding upkeep."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.lookup import text_to_embed

MAX_TOKENS = 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 for a zero vector, an error for vectors of different length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.when(F.size(a) == F.size(b), F.when(norm > 0, dot(a, b) / norm).when(norm == 0, 0.0))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different length")).cast("double")).otherwise(same)


def _points(vector: str) -> Column:
    """Whether a vector has a direction: searches leave zero vectors out."""
    return F.exists(vector, lambda x: x != 0).alias("points")


def _literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest(vectors: DataFrame, query: list[float], k: int, id_column: str = "nodeId") -> DataFrame:
    """The k most similar vectors, best first, ties by id: a scan and a top-n, whatever the table's size."""
    scored = vectors.select(F.col(id_column).alias("id"), cosine(F.col("embedding"), _literal(query)).alias("score"), _points("embedding")).where("score is not null and points").drop("points")
    return scored.orderBy(F.desc("score"), "id").limit(k)


def scored_nodes(nodes: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """Nodes with a vector and their score, for score pages; vectors without a node don't show."""
    scored = vectors.select("nodeId", cosine(F.col("embedding"), _literal(query)).alias("score"), _points("embedding")).where("score is not null and points").drop("points")
    return nodes.join(scored, nodes["id"] == scored["nodeId"]).drop("nodeId")


def pool(tokens: DataFrame) -> DataFrame:
    """(id, embedding) from (id, position, mask, vector): the mean over unmasked tokens up to MAX_TOKENS, at length one."""
    used = tokens.where((F.col("mask") == 1) & (F.col("position") < MAX_TOKENS)).select("id", F.posexplode("vector").alias("i", "x"))
    mean = used.groupBy("id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    out = mean.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    return out.select("id", F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("embedding"))


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed counts of hashed words, at length one."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 32 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed_nodes(nodes: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], version: str) -> DataFrame:
    """Vectors (nodeId, embedding, embeddingVersion) of the nodes that have text. ``make`` loads the model, once a worker process.

    A text that the model fails on gives no row; the others do.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for pdf in batches:
            rows = []
            try:
                rows = [v.tolist() for v in embed(pdf["text"].tolist())]
                ids = pdf["nodeId"].tolist()
            except Exception:
                ids = []
                for node, text in zip(pdf["nodeId"], pdf["text"], strict=True):
                    try:
                        rows.append(embed([text])[0].tolist())
                        ids.append(node)
                    except Exception:
                        continue
            yield pd.DataFrame({"nodeId": ids, "embedding": rows, "embeddingVersion": version})

    texts = nodes.select(F.col("id").alias("nodeId"), text_to_embed().alias("text")).where("text is not null")
    return texts.mapInPandas(run, "nodeId string, embedding array<float>, embeddingVersion string")


def refresh_vectors(vectors: DataFrame, changed: DataFrame, fresh: DataFrame, drop_textless: bool = True) -> DataFrame:
    """The vectors after a diff: changed nodes' new ones replace theirs; a node that lost its text loses its vector too."""
    gone = changed.select(F.col("id").alias("nodeId")) if drop_textless else fresh.select("nodeId")
    return vectors.join(gone.distinct(), "nodeId", "left_anti").unionByName(fresh)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of each of a few queries (queryId, embedding), which go to every task; for many, use an index."""
    rows = queries.select("queryId", "embedding").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 queries")
    held = F.array(*[F.struct(F.lit(r[0]).alias("queryId"), _literal(r[1]).alias("q")) for r in rows])
    scored = vectors.select(F.col("nodeId").alias("id"), "embedding", F.explode(held).alias("ask"))
    scored = scored.select("ask.queryId", "id", cosine(F.col("embedding"), F.col("ask.q")).alias("score")).where("score is not null")
    rank = F.row_number().over(W.partitionBy("queryId").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
