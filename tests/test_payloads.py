"""The payload index against plain filters, and both ways of searching against each other."""

import pytest
from pyspark.sql import functions as F

from quern.operators import index, payloads, search
from quern.plans.catalogue import vectors


@pytest.fixture(scope="module")
def table(spark, small):
    rows = vectors(spark, small).select("id", "vector", "tenant_id", "allowed_roles", F.when(F.col("id") % 7 > 0, F.concat(F.lit("c"), (F.col("label") % 3).cast("string"))).alias("kind"))
    odd = spark.createDataFrame([(90_001, None, "T0", None, "c1"), (90_002, [float("nan")] * 64, "T0", [], "c1"), (90_003, [0.0] * 64, None, None, None), (90_004, [1.0], "T0", ["a", "b"], "c1")], "id long, vector array<double>, tenant_id string, allowed_roles array<string>, kind string")
    return rows.withColumn("vector", F.col("vector").cast("array<double>")).unionByName(odd)


@pytest.fixture(scope="module")
def built(table, tmp_path_factory):
    return payloads.build(table, {"tenant": F.col("tenant_id"), "role": F.col("allowed_roles"), "kind": F.col("kind")}, f"{tmp_path_factory.mktemp('payloads')}/index", 8)


CASES = [
    ({}, "true"),
    ({"tenant": "T2"}, "tenant_id = 'T2'"),
    ({"tenant": None}, "tenant_id is null"),
    ({"tenant": "T0", "kind": "c1"}, "tenant_id = 'T0' and kind = 'c1'"),
    ({"tenant": ["T0", "T1"], "kind": None}, "tenant_id in ('T0', 'T1') and kind is null"),
    ({"tenant": "T1", "role": [None, "ops", "analyst"]}, "tenant_id = 'T1' and (coalesce(size(allowed_roles), 0) <= 0 or arrays_overlap(allowed_roles, array('ops', 'analyst')))"),
    ({"tenant": "none such"}, "false"),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_both_ways_equal_a_plain_search(table, built, case):
    filters, where = CASES[case][0], F.expr(CASES[case][1])
    asked = table.filter("id % 40 = 0 or id > 90000").select(F.col("id").alias("query_id"), "vector")
    want = sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in search.search_many(asked, table.filter(where), 4).collect())
    for way in ("filter", "index"):
        found, taken = payloads.search(built, asked, filters, 4, way=way)
        assert taken == way and sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in found.collect()) == want
    n = payloads.count(payloads.select(built, filters))
    assert n == table.filter(where).filter(search.usable(F.col("vector"))).count() == payloads.numbers(payloads.select(built, filters)).count()


def test_the_counts_choose_the_way(table, built):
    asked = table.filter("id = 1").select(F.col("id").alias("query_id"), "vector")
    assert payloads.search(built, asked, {"tenant": "T2"}, 2, few=1)[1] == "index"
    assert payloads.search(built, asked, {"tenant": "T2"}, 2)[1] == "filter"


def test_far_lists_are_not_probed(spark):
    """Tight clusters: a query needs its own cluster's list only, and the result is exact."""
    rows = spark.range(400).selectExpr("id", "transform(sequence(0, 7), i -> if(i = id % 8, 1.0D, 0.001D * ((id * 7 + i) % 10))) as vector")
    centers = index.fit_centroids(rows, 8)
    asked = rows.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    found, probed = index.exact(asked, index.build(rows, centers), centers, 5, probes=1, block=16)
    want = search.search_many(asked, rows, 5)
    assert found.select("query_id", "id", "rank").exceptAll(want.select("query_id", "id", "rank")).isEmpty() and found.count() == want.count()
    assert probed.count() < asked.count() * len(centers) / 2 and probed.distinct().count() == probed.count()


def test_nothing_to_index(table, tmp_path):
    none = payloads.build(table.limit(0), {"kind": F.col("kind")}, f"{tmp_path}/none", 4)
    asked = table.filter("id = 1").select(F.col("id").alias("query_id"), "vector")
    for way in ("filter", "index"):
        assert payloads.search(none, asked, {"kind": "c1"}, way=way)[0].count() == 0
