import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import near_dedup, textnum, union_find
from codeloom.llm.near_links import near_links
from codeloom.llm.scratch import Scratch
from codeloom.llm.union_find import components


@given(st.lists(st.text(alphabet="aAbZé \t\n\x0b\u00a0\u2003", max_size=40), max_size=6))
def test_shingles_equal_plain_ones(texts):
    sets = list(textnum.shingle_sets(pa.array(texts, pa.string()), 3))
    assert [len(s) for s in sets] == [len(brute.shingles(t, 3)) for t in texts]


def test_words_across_blocks(monkeypatch):
    text = "ab " * 50 + "x" * 40 + " cd e"
    want = [s.tolist() for s in textnum.shingle_sets(pa.array([text, "", None, text]))]
    monkeypatch.setattr(textnum, "BLOCK", 16)
    assert [s.tolist() for s in textnum.shingle_sets(pa.array([text, "", None, text]))] == want


def test_circulant_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 1 << 63, 80, dtype=np.uint64)])
    c = near_dedup.Circulant(200, 5)
    assert abs((c.signature(a) == c.signature(b)).mean() - 320 / 480) < 0.08


def test_equals_brute_force(docs_of, near_rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs_of(near_rows)).collect()}
    assert got == brute.near(near_rows)


def test_group_whose_pivot_links_few(docs_of):
    words = [f"v{i}" for i in range(60)]
    rows = [(0, " ".join(words))]
    for i in range(1, 40):  # each differs from the last by little and from the first by much
        words = words[:]
        words[(i * 7) % 60] = f"n{i}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs_of(rows)).collect()}
    assert got == brute.near(rows)


def test_odd_rows(spark, docs_of):
    text = "one two three four five six seven"
    out = near_dedup.near_duplicates(docs_of([(None, text), (3, text), (3, text), (5, text), (5, "other words here")]).withColumn("component", F.lit("x")).withColumn("rep", F.lit(1)))
    assert sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()) == [(-1, 3, None, True), (3, 3, 3, True), (3, 3, 3, True), (5, 1, 3, False), (5, 3, 3, False)]
    assert near_dedup.near_duplicates(docs_of([])).count() == 0


def test_drop_keeps_columns_and_first(docs_of):
    text = "one two three four five six seven"
    out = near_dedup.drop_near_duplicates(docs_of([(2, text), (1, text), (3, ""), (4, None)]))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and sorted(r[0] for r in out.collect()) == [1, 3, 4]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (8, 9), (5, 5), (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    chain = spark.range(200).selectExpr("id a", "id + 1 b")
    assert {r["component"] for r in components(chain, Scratch(spark, "t")).collect()} == {0}
    assert components(edges.limit(0), Scratch(spark, "t")).count() == 0


def test_components_end_when_flat(spark, monkeypatch):
    rng = random.Random(11)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    want = brute.closure({i for p in pairs for i in p}, pairs)
    alone = {i for i in want if all(a == b for a, b in pairs if i in (a, b))}
    for few in (0, union_find.FEW):  # rounds with and without a shuffle
        monkeypatch.setattr(union_find, "FEW", few)
        got = components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()
        assert sorted((r["node"], r["component"]) for r in got) == sorted((i, c) for i, c in want.items() if i not in alone)
        star = Scratch(spark, "t")
        assert components(spark.range(1, 40).selectExpr("id a", "0L b"), star).count() == 40
        assert star._count == 1  # one aggregation sees that nothing is left to do


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.op7_near_dedup(spark, DATA).collect()}
    assert got == brute.near(rows)


@pytest.mark.parametrize("early", [True, False])
def test_two_large_components_need_few_pairs(spark, early):
    noise, n = 300, 70
    place = {i: 100.0 + 10 * i for i in range(noise)} | {noise + i: i / n for i in range(n)} | {noise + n + i: 0.7 + i / n for i in range(n)}
    one, two = range(noise, noise + n), range(noise + n, noise + 2 * n)
    entries = spark.createDataFrame([(1, i) for i in one] + [(2, i) for i in two] + [(3, i) for i in place], "key long, node long")
    texts = spark.createDataFrame([(i, str(x)) for i, x in place.items()], "node long, text string")
    far = lambda a, b: F.abs(a.cast("double") - b.cast("double"))
    made = []

    class Counted(Scratch):
        def keep(self, df, files=None):
            out = super().keep(df, files)
            if df.columns[:2] == ["a", "b"] and "more" not in df.columns:
                made.append(out.where(F.col("a") >= noise).count())
            return out

    compare = lambda pairs: pairs.select("a", "b", (far(F.col("ta"), F.col("tb")) <= 1).alias("link"), far(F.col("ta"), F.col("tb")).alias("dist"))
    sketch = lambda rows: rows.select("node", F.col("text").alias("sketch"))
    scratch = Counted(spark, "near-links")
    links = near_links(entries, lambda nodes: texts.join(nodes, "node", "left_semi"), compare, 1.0, scratch, sketch, lambda a, b: far(a, b) <= 1.01, early=early)
    found = {(r["node"], r["component"]) for r in components(links.select("a", "b"), scratch).collect()}
    scratch.close()
    assert found == {(i, noise) for i in [*one, *two]}
    assert max(made) < 1000
