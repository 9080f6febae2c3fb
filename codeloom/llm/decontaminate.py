"""Benchmark items inside long documents, by size-partitioned MinHash containment search.

An item of a few dozen shingles inside a document of thousands has a tiny Jaccard similarity, so equal signature
lengths for all can't work. As in LSH Ensemble (Zhu et al., 2016) documents are parted by the size of their set,
and each part has its own signature: one permutation hashing with a number of bins that is a fixed multiple of the
part's largest size. Whatever the size, a shared shingle is then the least of its bin in the document with
probability 0.98 or more under each of two permutations, and one shared coordinate proposes the pair.

The items' coordinates for each part, and their sets, go to every task while they are under a stated size; a
document is then searched and verified in the task that reads it, without a shuffle. Beyond that size the
coordinates are joined instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch
from codeloom.llm.textnum import U, mix, shingle_sets

#: Bins for each shingle of the largest document of a part; documents of a part differ in size by less than twice.
BINS = 32
TURNS = (U(0x8CB92BA72F3D8DD7), U(0xABC98388FB8FAC03))
#: Items' sets up to so many bytes are sent to every task.
SENT_BYTES = 64 << 20
LEAST = 0.75


def part_of(size: int) -> int:
    """The part that a set of this size belongs to: its sizes are in [2**(part - 1), 2**part)."""
    return int(size).bit_length()


def coordinates(numbers: np.ndarray, part: int, turn: int) -> np.ndarray:
    """The coordinates of a set under one permutation: for each bin that isn't empty, bin and least value as one number.

    The value's high bits are its bin, so the least value alone tells both.
    """
    turned = np.sort(mix(numbers ^ TURNS[turn]))
    bits = min(int(BINS).bit_length() - 1 + part, 40)
    bins = turned >> U(64 - bits)
    least = turned[np.concatenate([[True], bins[1:] != bins[:-1]])] if len(turned) else turned
    return mix(least ^ U(part * 2 + turn))


class Index:
    """The items, ready to search: sets one after another, and for each part the sorted coordinates with their items."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        keep = [i for i, s in enumerate(sets) if len(s)]
        self.ids = np.array([ids[i] for i in keep], np.int64)
        self.sets = [sets[i] for i in keep]
        self.parts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def of(self, part: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted coordinates, their items, and which highest 20 bits occur among them."""
        if (part, turn) not in self.parts:
            each = [coordinates(s, part, turn) for s in self.sets]
            keys = np.concatenate(each) if each else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(each)), [len(k) for k in each])
            order = np.argsort(keys, kind="stable")
            some = np.zeros(1 << 20, bool)
            some[(keys >> U(44)).astype(np.int64)] = True
            self.parts[(part, turn)] = keys[order], owner[order], some
        return self.parts[(part, turn)]

    def search(self, numbers: np.ndarray) -> np.ndarray:
        """The items (by index) that share a coordinate with a document's set."""
        found = [np.zeros(0, np.int64)]
        for turn in range(len(TURNS)):
            keys, owner, some = self.of(part_of(len(numbers)), turn)
            own = coordinates(numbers, part_of(len(numbers)), turn)
            own = own[some[(own >> U(44)).astype(np.int64)]]
            for a, b in zip(np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right"), strict=True):
                found.append(owner[a:b])
        return np.unique(np.concatenate(found))


_COLUMNS = "doc_id long, item_id long, n_item long, n_common long, containment double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_common", pa.int64()), ("containment", pa.float64())])


def _common(item: np.ndarray, doc: np.ndarray) -> int:
    at = np.searchsorted(doc, item)
    at[at == len(doc)] = 0
    return int((doc[at] == item).sum())


def _search(sent, words: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*sent.value)
        for batch in batches:
            rows = []
            for doc, numbers in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words), strict=True):
                if not len(numbers):
                    continue
                for i in index.search(numbers):
                    k, n = _common(index.sets[i], numbers), len(index.sets[i])
                    if k >= least * n:
                        rows.append((doc, int(index.ids[i]), n, k, k / n))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)] if rows else [pa.array([], t) for t in _SCHEMA.types], schema=_SCHEMA)

    return run


def _keys(words: int, items: bool):
    """(part, key, id) of each set; an item has coordinates for every part, a document for its own."""
    schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for who, numbers in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words), strict=True):
                if not len(numbers):
                    continue
                for part in range(1, 41) if items else [part_of(len(numbers))]:
                    keys = np.concatenate([coordinates(numbers, part, turn) for turn in range(len(TURNS))]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), pa.array(keys), pa.array([who] * len(keys), pa.int64())], schema=schema)

    return run


def _verify(words: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, item, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words), strict=True):
                k, n = _common(b, a), len(b)
                if n and k >= least * n:
                    rows.append((doc, item, n, k, k / n))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)] if rows else [pa.array([], t) for t in _SCHEMA.types], schema=_SCHEMA)

    return run


def _sent(spark: SparkSession, items: DataFrame, words: int, most: int):
    """The items' ids and sets for every task, if they are small enough by their measured size; else None."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if 2 * size > most:
        return None
    rows = items.collect()
    return spark.sparkContext.broadcast(([r[0] for r in rows], list(shingle_sets(pa.array([r[1] for r in rows], pa.string()), words))))


def contained_items(docs: DataFrame, items: DataFrame, words: int = 5, least: float = LEAST, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Pairs of a document and an item of which it holds ``least`` or more: doc_id, item_id, n_item, n_common, containment.

    ``docs`` has doc_id and text, ``items`` item_id and text. containment is the share of the item's distinct
    word shingles that the document's whole text has, wherever they stand. An item of fewer than ``words`` words is
    one shingle, held by documents that are these words only. Null, empty and wordless texts and items match
    nothing. Rows with a null id take part and return that null. Repeated rows return their pairs once for each
    row. Further columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    sent = _sent(spark, items, words, sent_bytes)
    if sent is not None:
        return docs.mapInArrow(_search(sent, words, least), _COLUMNS)
    scratch = Scratch(spark, "contained")
    keys = [t.mapInArrow(_keys(words, own), f"part int, key long, {name} long").distinct() for t, own, name in ((docs, False, "doc_id"), (items, True, "item_id"))]
    pairs = scratch.keep(keys[0].join(keys[1], ["part", "key"]).select("doc_id", "item_id").distinct())
    a = docs.withColumnRenamed("text", "_doc").withColumnRenamed("doc_id", "_a")
    b = items.withColumnRenamed("text", "_item").withColumnRenamed("item_id", "_b")
    both = pairs.join(b, F.col("item_id").eqNullSafe(F.col("_b"))).join(a, F.col("doc_id").eqNullSafe(F.col("_a")))
    return both.select("doc_id", "item_id", "_doc", "_item").mapInArrow(_verify(words, least), _COLUMNS)


def _keep_clean(sent, words: int, least: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*sent.value)
        for batch in batches:
            clean = [not any(_common(index.sets[i], s) >= least * len(index.sets[i]) for i in (index.search(s) if len(s) else ())) for s in shingle_sets(batch.column(at), words)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, words: int = 5, least: float = LEAST, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; while items are few, judged where they are read.

    Every row is judged by its own text: beyond that size rows get keys of this call, so null or shared ids don't matter.
    """
    sent = _sent(docs.sparkSession, items, words, sent_bytes)
    if sent is not None:
        return docs.mapInArrow(_keep_clean(sent, words, least, docs.columns.index("text")), docs.schema)
    keyed = Scratch(docs.sparkSession, "clean").keep(docs.withColumn("_row", F.monotonically_increasing_id()))  # written, so keys hold
    texts = keyed.select(F.col("_row").alias("doc_id"), "text")
    found = contained_items(texts, items, words, least, sent_bytes).select(F.col("doc_id").alias("_gone")).distinct()
    return keyed.join(found, F.col("_row") == F.col("_gone"), "left_anti").select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH u AS (SELECT doc_id AS id, text, 0 AS item FROM documents UNION ALL SELECT item_id, text, 1 FROM benchmark),
w AS (SELECT id, item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM u),
s AS (SELECT id, item, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
x AS (SELECT id, item, unnest(sh) AS g FROM s),
c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_common FROM x d JOIN x b ON d.item = 0 AND b.item = 1 AND d.g = b.g GROUP BY 1, 2)
SELECT doc_id, item_id, len(sh)::BIGINT AS n_item, n_common, n_common / len(sh) AS containment FROM c JOIN s ON s.item = 1 AND s.id = item_id WHERE n_common >= 0.75 * len(sh)
"""
