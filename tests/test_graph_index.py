"""The layered graph: recall, exactness at full beam, filters, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import graph_index, index, search
from quern.plans.catalogue import vectors

LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def graph(spark, small, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('graph')}/nodes"
    graph_index.build(vectors(spark, small).select("id", "vector", "tenant_id"), ("tenant_id",), shard_rows=150, links=6).write.parquet(path)
    return spark.read.parquet(path)


def test_layers_are_connected_both_ways(graph):
    for shard in range(graph.agg(F.max("shard")).head()[0] + 1):
        rows = {r["node"]: r["links"] for r in graph.filter(F.col("shard") == shard).collect()}
        assert len(rows[0]) == max(map(len, rows.values())) > 1
        for layer in range(len(rows[0])):
            own = {k for k, links in rows.items() if len(links) > layer}
            assert all(o in own and k in rows[o][layer] for k in own for o in rows[k][layer])
            seen, todo = set(), [0]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += rows[k][layer]
            assert seen == own


def test_full_beam_is_exact(spark, small, graph):
    rows = vectors(spark, small)
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    for where, kept in ((None, rows), (F.col("tenant_id") == "T2", rows.filter("tenant_id = 'T2'")), (F.lit(False), rows.limit(0))):
        got = graph_index.search(asked, graph, 5, beam=10_000, where=where, query_block=4)
        want = search.search_many(asked, kept, 5)
        keys = ["query_id", "id", "rank"]
        assert got.select(keys).exceptAll(want.select(keys)).isEmpty() and got.count() == want.count()


def test_recall_at_a_beam(spark):
    rows = vectors(spark, LARGE)
    graph = graph_index.build(rows.select("id", "vector", "tenant_id"), ("tenant_id",))
    graph = graph.cache()
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    assert graph.count() == rows.count()
    found = graph_index.search(asked, graph, 5, beam=96)
    assert index.recall(found, search.search_many(asked, rows, 5)) >= 0.9
    filtered = graph_index.search(asked, graph, 5, beam=96, where=F.col("tenant_id") == "T1")
    assert index.recall(filtered, search.search_many(asked, rows.filter("tenant_id = 'T1'"), 5)) >= 0.9


def test_a_walk_goes_to_few_rows():
    """A beam of 20 over 3,000 rows compares a small part of them."""
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = graph_index._links(x, np.arange(3000), 12)
    links = [[near[k]] for k in range(3000)]

    class Counted:
        rows = 0

        def __getitem__(self, k):
            Counted.rows += np.size(x[k]) // 8
            return x[k]

        def __len__(self):
            return 3000

    hits = sum({k for _, k in graph_index.walk(Counted(), links, q, np.ones(3000, bool), 20)} >= set(np.argsort(-(x @ q))[:3].tolist()) for q in x[:30])
    assert hits >= 27 and Counted.rows / 30 < 1000


def test_odd_vectors(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [nan, 1.0]), ("d", []), ("e", [2.0]), ("f", [0.0, 0.0]), ("f", [0.0, 0.0])], "id string, vector array<double>")
    got = graph_index.search(rows.filter("id in ('a', 'b', 'c')").withColumnRenamed("id", "query_id"), graph_index.build(rows), 9, beam=9)
    assert sorted((r["query_id"], r["id"], round(r["score"], 6)) for r in got.collect()) == [("a", "a", 1.0), ("a", "e", 1.0), ("a", "f", 0.0), ("a", "f", 0.0)]
    assert graph_index.search(rows.withColumnRenamed("id", "query_id"), graph_index.build(rows.limit(0))).count() == 0
