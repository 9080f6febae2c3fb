import numpy as np
import pytest

from codeloom.llm import ann


def plain(rows, asks, k=5):
    """Every query's k nearest by brute force: (query, rank, vec_id), ties by id, and their scores."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in sorted({i for i, _ in rows if asks(i)}):
        c = np.round((u @ u[ids == q].T).max(axis=1), 12)
        order = [j for j in np.lexsort((ids, -c)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(c[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("kind", ["clustered", "gaussian"])
def test_ranks_scores_and_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "LEAF", 128)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    if kind == "clustered":
        x = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.15 * x
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), "vec_id % 50 = 0"))
    want = plain(rows, lambda i: i % 50 == 0)
    assert sorted(got) == sorted(want) and all(len(v) == 5 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    same = [q for q in want if [i for i, _ in got[q]] == [i for i, _ in want[q]]]
    assert len(same) >= 0.8 * len(want)
    assert all(abs(a - b) < 1e-9 for q in same for (_, a), (_, b) in zip(got[q], want[q], strict=True))


def test_parallel_vectors_tie_by_id(spark):
    rng = np.random.default_rng(5)
    one = rng.normal(size=8)
    rows = [(i, (one * (1 + 2 * (i % 7))).tolist()) for i in range(40, 0, -1)] + [(100 + i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += rows[:10]  # repeated rows
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id in (3, 40)"))
    assert [i for i, _ in got[3]] == [1, 2, 4, 5, 6] and [i for i, _ in got[40]] == [1, 2, 3, 4, 5]
    assert {s for v in got.values() for _, s in v} == {1.0}
