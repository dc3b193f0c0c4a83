"""Null, empty, short and non-finite vectors, and ids that are strings, in every search."""

import pytest
from pyspark.sql import functions as F

from quern.operators import index, search

NAN, INF = float("nan"), float("inf")
ROWS = [(1, [1.0, 0.0]), (2, [NAN, 1.0]), (3, None), (4, [1.0, None]), (5, []), (6, [INF, 0.0]), (7, [0.5, 0.5]), (8, [2.0]), (9, [0.0, 0.0]), (10, [-1.0, 0.0])]
#: By cosine to (1, 0), ties by id; a short vector ends in zeros, a zero vector scores 0.
WANT = [(1, 1.0), (8, 1.0), (7, 0.707107), (9, 0.0), (10, -1.0)]


@pytest.fixture(params=["long", "string"])
def vectors(spark, request):
    rows = spark.createDataFrame(ROWS, "id long, vector array<double>")
    return rows if request.param == "long" else rows.withColumn("id", F.lpad(F.col("id").cast("string"), 3, "0"))


def told(df):
    return [(int(r["id"]), round(r["score"], 6)) for r in df.collect()]


def test_search(vectors):
    assert told(search.search(vectors, [1.0, 0.0], F.lit(True), 20)) == WANT
    with pytest.raises(ValueError):
        search.search(vectors, [NAN, 0.0], F.lit(True))


def test_search_many(vectors):
    asked = vectors.filter(F.col("id").cast("int").isin(1, 2, 3, 4, 5, 6)).withColumnRenamed("id", "query_id")
    got = search.search_many(asked, vectors, 20, block=3, query_block=2)
    assert {int(r["query_id"]) for r in got.collect()} == {1}
    assert told(got.orderBy("rank")) == WANT
    assert got.schema["id"].dataType == vectors.schema["id"].dataType == got.schema["query_id"].dataType


def test_index(vectors):
    centers = index.fit_centroids(vectors, 3)
    built = index.build(vectors, centers)
    assert sorted(int(r["id"]) for r in built.collect()) == [1, 7, 8, 9, 10]
    got = index.probe(vectors.filter(F.col("id").cast("int") == 1).withColumnRenamed("id", "query_id"), built, centers, 20, 3)
    assert told(got.orderBy("rank")) == WANT


def test_cache(vectors):
    probes = vectors.filter(F.col("id").cast("int") <= 6).withColumnRenamed("id", "query_id")
    cache = vectors.filter(F.col("id").cast("int") > 6).withColumn("value", F.col("id").cast("string"))
    answers, added = search.cached_answers(probes, cache, lambda rows: rows.withColumn("value", F.lit("made")))
    assert {(int(r["query_id"]), r["hit"]) for r in answers.collect()} == {(1, True), *((k, False) for k in range(2, 7))}
    assert added.count() == 5
