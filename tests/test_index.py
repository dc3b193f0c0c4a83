import numpy as np

from quern.operators import index, search
from quern.plans.catalogue import vectors


def test_recall(spark, small):
    rows = vectors(spark, small).select("id", "vector")
    asked = rows.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    centers = index.fit_centroids(rows, 16)
    built = index.build(rows, centers)
    assert built.count() == rows.count()
    exact = search.search_many(asked, rows, 5)
    found = index.probe(asked, built, centers, 5, 12, block=20)
    assert found.count() == exact.count()
    assert index.recall(found, exact) >= 0.9
    assert index.recall(index.probe(asked, built, centers, 5, 16), exact) == 1.0


def test_empty(spark, small):
    rows = vectors(spark, small).select("id", "vector")
    centers = index.fit_centroids(rows.limit(0))
    assert len(centers) == 0
    some = index.fit_centroids(rows, 4)
    assert index.probe(rows.limit(0).withColumnRenamed("id", "query_id"), index.build(rows, some), some).count() == 0


def test_products_are_made_in_tiles_and_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(5)
    x, q = rng.integers(-2, 3, (300, 4)).astype(float), rng.integers(-2, 3, (40, 4)).astype(float)
    want = np.argsort(-(q @ x.T), axis=1, kind="stable")
    for k, tile in ((0, 50), (1, 50), (7, 900), (300, 10_000), (500, 1)):
        best, scores = search.nearest(q, x, k, tile)
        assert (best == want[:, :k]).all() and np.allclose(scores, np.take_along_axis(q @ x.T, best, 1))
    assert search.nearest(q, x[:0], 3)[0].shape == (40, 0)
