"""Near-duplicate documents by circulant MinHash.

Method (C-MinHash, Li and Li, 2022): a first permutation scatters the shingles over a circle of 2**20 places, a
second one gives each place a rank, and coordinate k of the signature is the least rank met when the second
permutation is turned by k places. Two permutations thus give all coordinates, and as one shingle's ranks for all
k lie side by side in memory, a signature is the running minimum of contiguous slices.

Plan: one pass makes sets and signatures; equal sets fall together by a 128-bit digest; only one document of each
such class is banded; bands propose, full sets decide (near_links), union-find closes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.near_links import near_links
from codeloom.llm.scratch import Scratch
from codeloom.llm.textnum import U, mix, overlap, shingle_sets
from codeloom.llm.union_find import components

PLACES = 1 << 20
#: 48 bands of 5 rows miss a pair of similarity 0.75 with probability (1 - 0.75**5)**48 = 2e-6.
BANDS, ROWS = 48, 5
#: The lowest two bits of so many coordinates sketch a set.
SKETCH = 1024


class Circulant:
    """Signatures of sets of 64-bit numbers."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.k, self.bands, self.rows = bands * rows, bands, rows
        self.scatter = rng.permutation(PLACES).astype(np.uint32)
        rank = rng.permutation(PLACES).astype(np.uint32)
        self.turned = np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[: self.k]]), self.k)
        self.odd = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * U(2) + U(1)

    def signature(self, numbers: np.ndarray) -> np.ndarray:
        at = self.scatter[(numbers >> U(44)).astype(np.int64)]
        out = np.full(self.k, PLACES, np.uint32)
        for i in range(0, len(at), 512):
            np.minimum(out, self.turned[at[i : i + 512]].min(axis=0), out=out)
        return out

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band."""
        rows = self.signature(numbers).reshape(self.bands, self.rows).astype(np.uint64)
        return mix((rows * self.odd).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


_made: dict[tuple[int, int], Circulant] = {}


def _sign(words: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _made.get((bands, rows)) or _made.setdefault((bands, rows), Circulant(bands, rows))
        for batch in batches:
            size, digest, keys = [], [], []
            for found in shingle_sets(batch.column(1), words):
                size.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(maker.keys(found) if len(found) else np.zeros(0, np.uint64))
            pair = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], schema=schema)

    return run


def _compare(words: int, per_cent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("link", pa.bool_()), ("dist", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, bytes, np.ndarray] = (None, b"", np.zeros(0, np.uint64))
        for batch in batches:
            link, dist = [], []
            a = batch.column(0).to_pylist()
            sets = shingle_sets(batch.column(3), words)
            for i, right in enumerate(sets):
                text = batch.column(2)[i].as_py() if last[0] != a[i] or i == 0 else None
                if text is not None and (last[0] != a[i] or last[1] != text):  # rows come grouped by a
                    last = (a[i], text, next(shingle_sets(pa.array([text]), words)))
                left = last[2]
                both = overlap(left, right)
                either = len(left) + len(right) - both
                link.append(either > 0 and 100 * both >= per_cent * either)
                dist.append(1 - both / either if either else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(link, pa.bool_()), pa.array(dist, pa.float64())], schema=schema)

    return run


def _sketch(words: int):
    schema = pa.schema([("node", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Circulant(SKETCH, 1, seed=6)
        for batch in batches:
            planes = []
            for found in shingle_sets(batch.column(1), words):
                low = maker.signature(found) & 3
                planes += [np.packbits(low & 1), np.packbits(low >> 1)]
            flat = np.concatenate(planes).view(np.int64) if planes else np.zeros(0, np.int64)
            bounds = np.arange(len(batch) + 1, dtype=np.int32) * (SKETCH // 32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], schema=schema)

    return run


def _alike(per_cent: int):
    """Whether two sketches disagree no more often than sets of the least similarity do, and 4.5 deviations."""
    p = 0.75 * (1 - per_cent / 100)
    most = int(SKETCH * p + 4.5 * (SKETCH * p * (1 - p)) ** 0.5)
    n = SKETCH // 64

    def test(a: Column, b: Column) -> Column:
        at = lambda i: F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        return sum((F.bit_count(at(i).bitwiseOR(at(n + i))) for i in range(n)), F.lit(0)) <= most

    return test


def near_duplicates(docs: DataFrame, words: int = 5, per_cent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if the Jaccard similarity of their sets of distinct word shingles is ``per_cent``
    hundredths or more; component_id is the smallest doc_id reachable over links, kept says it is the row's own.

    Null and empty texts, and texts without words, have an empty set and no link. A text of fewer than ``words``
    words is one shingle. A null doc_id can't be named, so such a row has no link, a null component and is kept.
    Rows that share a doc_id stand for one document with all of their texts: each row returns its own n_shingles
    and the common component. Further columns of ``docs`` are not read. No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = scratch.keep(docs.mapInArrow(_sign(words, bands, rows), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"))
    named = sets.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    own = F.when(F.col("doc_id") == F.col("rep"), F.col("keys")).alias("keys")
    signed = scratch.keep(named.join(classes, ["h1", "h2"]).select("doc_id", "rep", own))
    entries = signed.where("keys is not null").select(F.explode("keys").alias("key"), F.col("doc_id").alias("node"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        return docs.join(nodes.hint("merge"), docs["doc_id"] == nodes["node"]).select("node", "text")  # nodes grow with the documents

    def compare(pairs: DataFrame) -> DataFrame:
        return pairs.mapInArrow(_compare(words, per_cent), "a long, b long, link boolean, dist double")

    def sketch(texts: DataFrame) -> DataFrame:
        return texts.select("node", "text").mapInArrow(_sketch(words), "node long, sketch array<long>")

    links = near_links(entries, texts_of, compare, 1 - per_cent / 100, scratch, sketch, _alike(per_cent)).select("a", "b")
    edges = signed.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).unionByName(links)
    found = components(edges, scratch)
    scratch.drop(signed)
    out = sets.join(found, sets["doc_id"] == found["node"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are near copies of a document with a smaller doc_id; repeated rows of one doc_id stay one row."""
    verdict = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(verdict, docs["doc_id"] == verdict["_gone"], "left_anti")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
x AS (SELECT doc_id, hash(unnest(sh)) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = n.doc_id
"""
