"""Vector searches against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from sextant.llm import op3_cover_tree as cover
from sextant.llm import op10_hnsw as hnsw

SCHEMA = "vec_id long, embedding array<float>, label int"


def _table(spark, n=600, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[n // 2 : n // 2 + 40] = x[7]  # ties
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(n)]
    odd = [(10_000, None, 0), (10_050, [float("nan")] + [0.0] * (dim - 1), 0), (10_100, [None] + [1.0] * (dim - 1), 0), (10_150, [float("inf")] * dim, 0), (10_200, [0.0] * dim, 0), (5, [float(v) for v in x[5]], 1)]
    return spark.createDataFrame(rows + odd, SCHEMA), x


def test_cover_tree_equals_brute_force(spark):
    table, x = _table(spark)
    data = cover.integer_vectors(table)
    got = {}
    for r in cover.top_k(data, data.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    v = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    ids = np.append(np.arange(len(x)), 10_200)
    v = np.concatenate((v, np.zeros((1, v.shape[1]), np.int64)))
    for q in [*range(0, 600, 50), 10_200]:
        s = v @ v[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert sorted(got[q]) == [(k + 1, ids[i], s[i]) for k, i in enumerate(order)]
    assert set(got) == {*range(0, 600, 50), 10_200}


def test_cover_tree_small_and_empty_tables(spark):
    few = cover.integer_vectors(spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [3.0], 0)], SCHEMA))
    assert [(r.query_id, r.vec_id, r.score) for r in cover.top_k(few, few.where("vec_id = 0")).collect()] == [(0, 1, 256 * 768)]
    none = few.limit(0)
    assert cover.top_k(none, none).count() == 0


def test_cover_tree_keeps_large_components_and_refuses_overflow(spark):
    import pytest

    far = cover.integer_vectors(spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1e7, 0.0], 0), (2, [0.5, 0.0], 0), (3, [-3e12, 3e12], 0)], "vec_id long, embedding array<double>, label int"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in cover.top_k(far, far.where("vec_id = 0")).collect())
    assert got == [(0, 1, 1, 256 * 2_560_000_000), (0, 2, 2, 256 * 128), (0, 3, 3, 256 * -768_000_000_000_000)]
    a, b = np.array([[2**40, 2**40 + 1]]), np.array([[2**22, -(2**22)], [1, 1]])
    assert cover.products(a, b).tolist() == [[-(2**22), 2**41 + 1]]
    with pytest.raises(OverflowError):
        cover.products(np.array([[2**40]]), np.array([[2**40]]))


def test_cover_tree_with_many_cells_and_far_queries(spark, monkeypatch):
    monkeypatch.setattr(cover, "CELL_ROWS", 32)
    monkeypatch.setattr(cover, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 20
    x = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6)) * 0.3).astype(np.float32)
    data = cover.integer_vectors(spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], SCHEMA))
    asked = cover.integer_vectors(spark.createDataFrame([(5_000 + i, [float(v) for v in 50 * row], 0) for i, row in enumerate(centres)], SCHEMA))
    got = {}
    for r in cover.top_k(data, asked).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v, w = np.floor(256 * x.astype(np.float64)).astype(np.int64), np.floor(256 * (50 * centres).astype(np.float32).astype(np.float64)).astype(np.int64)
    for i in range(12):
        s = v @ w[i]
        top = np.lexsort((np.arange(900), -s))[:5]
        assert sorted(got[5_000 + i]) == [(k + 1, int(j), int(s[j])) for k, j in enumerate(top)]


def test_cover_tree_covers_and_prunes_soundly():
    x = np.random.default_rng(1).normal(size=(3_000, 6)) * 100
    t = cover.build(x, 32)
    assert sorted(t["order"]) == list(range(len(x)))
    for b, e, c, r in zip(t["begin"], t["end"], t["centre"], t["radius"]):
        assert np.sqrt(((x[t["order"][b:e]] - x[c]) ** 2).sum(axis=1)).max() <= r + 1e-9


def test_graph_search_recall_scores_and_ties(spark):
    table, x = _table(spark, n=1_500, dim=16)
    rows = hnsw.vectors(table)
    found = hnsw.nearest(rows, rows.where("vec_id % 20 = 0"), k=20, shard_rows=500).collect()
    ids, hits, asked = np.arange(len(x)), 0, 0
    for q in range(0, 1_500, 20):
        s = (x.astype(np.float64) * x[q].astype(np.float64)).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(abs(s[v] - score) < 1e-9 for _, v, score in own)
        assert [(-score, v) for _, v, score in own] == sorted((-score, v) for _, v, score in own)
        hits, asked = hits + len({v for _, v, _ in own} & set(order)), asked + 20
    assert hits / asked >= 0.9
    assert not {r.vec_id for r in found} & {10_000, 10_050, 10_100, 10_150, 10_200}


def test_graph_search_small_and_empty_tables(spark):
    few = hnsw.vectors(spark.createDataFrame([(0, [1.0, 2.0], 0), (20, [1.0, 2.0], 0), (3, [0.5], 0)], SCHEMA))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in hnsw.nearest(few, few.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 20, 5.0), (0, 2, 3, 0.5), (20, 1, 0, 5.0), (20, 2, 3, 0.5)]
    assert hnsw.nearest(few.limit(0), few.limit(0)).count() == 0


def _recall(x: np.ndarray, k: int = 20, queries: int = 60) -> float:
    built = hnsw.Graph.build(np.arange(len(x)), x, 1)
    graph = hnsw.Graph.of({name: v[0] for name, v in built.flat().items()}, x.shape[1])
    found, exact = graph.search(x[:queries], k + 1), np.argsort(-(x[:queries] @ graph.x.T), axis=1, kind="stable")[:, : k + 1]
    return float(np.mean([len(np.intersect1d(a, b)) / (k + 1) for a, b in zip(found, exact)]))


@pytest.mark.parametrize("large", [1e3, 1e6, 1e20, 1e30, 1e150])
def test_one_long_vector_does_not_blur_the_others(large):
    x = np.random.default_rng(1).normal(size=(4_000, 64))
    x[5, 3] = large
    assert _recall(x) >= 0.9


@pytest.mark.parametrize("kind", ["scattered", "varied", "clustered"])
def test_recall_in_a_full_shard(kind):
    """Vectors without structure, of very different lengths, and in clusters: a whole shard of each."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(hnsw.SHARD_ROWS, 64))
    if kind == "varied":
        x *= np.exp(rng.normal(size=(len(x), 1)))
    elif kind == "clustered":
        x = rng.normal(size=(200, 64))[rng.integers(0, 200, len(x))] + 0.3 * x
    assert _recall(x) >= 0.9


def test_large_components_through_spark(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(60)] + [(60, [1e30, 0.0, 0.0, 1.0]), (80, [1e200, 1e200, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = hnsw.vectors(df)
    got = {}
    for r in hnsw.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=5, shard_rows=30).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    table = dict(rows)
    with np.errstate(over="ignore"):
        for q in (0, 20, 40, 60, 80):
            score = {i: float((np.array(v) * np.array(table[q])).sum()) for i, v in table.items() if i != q}
            assert got[q] == sorted(score, key=lambda i: (-score[i], i))[:5]
