import numpy as np
import pytest

from palisade.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, matrix, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    return spark.createDataFrame(
        [(int(i), [float(x) for x in v], 0) for i, v in zip(ids, matrix)], SCHEMA)


def slow(matrix, k, every):
    matrix = np.array(matrix, dtype=np.float32).astype(np.float64)
    out = {}
    for q in range(0, len(matrix), every):
        scores = (matrix * matrix[q]).sum(axis=1)
        order = [int(i) for i in np.lexsort((np.arange(len(matrix)), -scores)) if i != q][:k]
        out[q] = [(i, scores[i]) for i in order]
    return out


def fetched(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for ranks in out.values():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))
    return {q: [ranks[n] for n in sorted(ranks)] for q, ranks in out.items()}


def test_a_full_search_is_exact(spark):
    """All leaves, many equal vectors, different lengths, ties; small pages and many copies."""
    r = np.random.default_rng(2)
    matrix = np.round(r.normal(size=(400, 6)), 1)
    matrix[50:150] = matrix[50]
    matrix[200:230] *= 5
    found = fetched(ann.nearest(table(spark, matrix), k=7, every=9, search_share=1.0, trees=3,
                                leaf_rows=20, page_rows=30, page_queries=10))
    expected = slow(matrix, 7, 9)
    assert set(found) == set(expected)
    for q, rows in expected.items():
        assert [i for i, _ in found[q]] == [i for i, _ in rows]
        assert np.allclose([s for _, s in found[q]], [s for _, s in rows], atol=1e-12)


@pytest.mark.parametrize("clusters", [0, 30])
def test_recall(spark, clusters):
    r = np.random.default_rng(4)
    matrix = r.normal(size=(4000, 64))
    if clusters:
        matrix = 3 * r.normal(size=(clusters, 64))[r.integers(0, clusters, 4000)] + matrix
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    found, expected = fetched(ann.nearest(table(spark, matrix))), slow(matrix, 20, 20)
    hits = [len({i for i, _ in found[q]} & {i for i, _ in rows}) / 20
            for q, rows in expected.items()]
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("rows", [2, 21, 25, 100, 500])
def test_small_tables_are_complete_and_exact(spark, rows):
    r = np.random.default_rng(rows)
    matrix = r.normal(size=(rows, 64))
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    found, expected = fetched(ann.nearest(table(spark, matrix))), slow(matrix, 20, 20)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {
        q: [i for i, _ in v] for q, v in expected.items()}


@pytest.mark.parametrize("norms", ["one of 100", "one of 5", 0.3, 0.6])
def test_recall_of_unequal_lengths(spark, norms):
    r = np.random.default_rng(6)
    matrix = r.normal(size=(4000, 64))
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    if isinstance(norms, str):
        matrix[7] *= float(norms.split()[-1])
    else:
        matrix *= np.exp(norms * r.normal(size=4000))[:, None]
    found, expected = fetched(ann.nearest(table(spark, matrix))), slow(matrix, 20, 20)
    assert all(len(v) == 20 for v in found.values()) and set(found) == set(expected)
    hits = [len({i for i, _ in found[q]} & {i for i, _ in rows}) / 20
            for q, rows in expected.items()]
    print(norms, np.mean(hits))
    assert np.mean(hits) >= 0.9


def test_leaves_of_every_tree_hold_every_row():
    r = np.random.default_rng(5)
    matrix = r.normal(size=(500, 8))
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    forest = ann.plant(matrix, 500, 1.0, 3, 40)
    leaves = forest.leaves(matrix)
    sizes = np.bincount((leaves + np.arange(3) * (1 << forest.depth)).reshape(-1),
                        minlength=3 << forest.depth)
    assert sizes.sum() == 1500
    # The queue takes a query's own leaves first, then nearer ones before farther ones.
    taken = ann.Bands(1.1, {0: forest}).search(matrix[:20], sizes, 1500.0, 10)
    for q, entries in enumerate(taken):
        # A row on a threshold may be a rounding error away from its own leaf.
        assert set((leaves[q] + np.arange(3) * (1 << forest.depth)).tolist()) <= set(entries[:6])
        assert len(entries) == (sizes > 0).sum()


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 1), (20, [0.0, 0.0], 0), (40, None, 0),
            (60, [1.0, None], 0), (80, [float("nan"), 1.0], 0), (100, [float("inf"), 1.0], 0),
            (120, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (3, [0.5, 0.5], 0),
            (5, [0.5, 0.5], 0), (140, [], 0), (160, [-1.0, 0.0], None)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    found = fetched(ann.nearest(vectors))
    assert found == {0: [(3, 0.5), (5, 0.5), (160, -1.0)], 160: [(3, -0.5), (5, -0.5), (0, -1.0)]}
    assert ann.nearest(vectors.limit(0)).count() == 0
    assert ann.nearest(vectors.where("vec_id = 0")).count() == 0
