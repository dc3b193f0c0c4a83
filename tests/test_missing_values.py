"""Vectors that cannot be compared, empty tables, and inputs that are not there."""

import pytest
from pyspark.sql import functions as F

from quern.functions.machines import RollingPercentiles
from quern.operators import fusion, index, learning, resilience, search, telemetry
from quern.operators.fold import ordered_fold
from quern.sources.stores import mock_documents, mock_embeddings, with_model
from quern.streaming.processors import latest_results, start_once


@pytest.fixture(scope="module")
def ragged(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0]), (5, []), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [0.0, 0.0])]
    return spark.createDataFrame(rows, "id long, vector array<double>")


def test_search_leaves_out_what_is_no_vector(ragged):
    found = search.search_many(ragged.withColumnRenamed("id", "query_id"), ragged, 2).collect()
    assert {r["query_id"] for r in found} == {1, 3, 4, 8} and {r["id"] for r in found} <= {1, 3, 4, 8}
    best = {(r["query_id"], r["rank"]): r["id"] for r in found}
    assert best[1, 1] == 1 and best[4, 1] == 1 and best[3, 1] == 3


def test_index_leaves_out_what_is_no_vector(ragged):
    centers = index.fit_centroids(ragged, 2)
    built = index.build(ragged, centers)
    assert {r["id"] for r in built.collect()} == {1, 3, 4, 8}
    assert {r["query_id"] for r in index.probe(ragged.withColumnRenamed("id", "query_id"), built, centers, 1, 2).collect()} == {1, 3, 4, 8}


def test_cache_misses_are_computed_and_added(spark, ragged):
    cache = spark.createDataFrame([(10, [1.0, 0.0], "known")], "id long, vector array<double>, value string")
    compute = lambda rows: rows.withColumn("value", F.lit("new"))
    probes = ragged.withColumnRenamed("id", "query_id")
    answers, added = search.cached_answers(probes, cache, compute, 0.08)
    got = {r["query_id"]: (r["hit"], r["value"]) for r in answers.collect()}
    assert got == {k: (k in (1, 4), "known" if k in (1, 4) else "new") for k in range(1, 9)}
    assert {r["id"] for r in added.collect()} == {2, 3, 5, 6, 7, 8}
    answers, _ = search.cached_answers(probes, cache.limit(0), compute)
    assert not any(r["hit"] for r in answers.collect())


def test_no_cross_scores_give_the_raw_fusion(spark):
    fused = spark.createDataFrame([("a", 0.3), ("b", 0.2)], "id string, rrf_score double")
    none = spark.createDataFrame([], "id string, score double")
    for cross in (None, none):
        assert [tuple(r) for r in fusion.blend(fused, cross, tenant="t").collect()] == [("a", "t", 0.3, 0.3), ("b", "t", 0.2, 0.2)]
    some = spark.createDataFrame([("b", 1.0)], "id string, score double")
    assert [r["score"] for r in fusion.blend(fused, some).collect()] == [0.5, 0.5]
    assert fusion.blend(fused.limit(0), some).count() == 0


def test_latest_row_of_a_key(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", None, "z"), (None, 5, "n")], "id string, seq long, v string")
    assert {tuple(r) for r in search.upsert_latest(log, "id", "seq").collect()} == {("a", 3, None, 1), ("b", None, "z", None), (None, 5, "n", 5)}
    rows = spark.createDataFrame([("t", "a", 1, "x"), ("t", "a", 2, "y"), ("u", "a", 1, "z")], "tenant_id string, id string, batch long, v string")
    assert {tuple(r) for r in latest_results(rows).collect()} == {("t", "a", 2, "y"), ("u", "a", 1, "z")}
    assert latest_results(rows, ("id",)).count() == 1


@pytest.mark.parametrize(("size", "rows"), [(3, 5), (10, 4), (50, 7), (1000, 10)])
def test_sliced_percentiles_are_the_whole_ones(spark, size, rows):
    data = [(k % 2 if k < 60 else None, (k * 7919) % 97 if k % 3 else 5, k, float((k * 31) % 41)) for k in range(90)]
    df = spark.createDataFrame(data, "key long, us long, n long, value double")
    want = {tuple(r) for r in ordered_fold(df, ["key"], ["us", "n"], RollingPercentiles(size), ["value"]).collect()}
    assert {tuple(r) for r in telemetry.rolling_percentiles_split(df, ["key"], "us", "n", "value", size, rows).collect()} == want


@pytest.mark.parametrize("gamma", [0.0, 0.3, 0.9, 1.0])
def test_blocks_of_a_return(spark, gamma):
    data = [(k % 2, k // 2, float(k % 7) - 2) for k in range(150)]
    df = spark.createDataFrame(data, "traj long, t long, reward double")
    got = {(r["traj"], r["t"]): r["g"] for r in learning.discounted(df, "reward", "g", "traj", "t", gamma, block=8).collect()}
    for traj in (0, 1):
        g = 0.0
        for _, t, reward in sorted((r for r in data if r[0] == traj), key=lambda r: -r[1]):
            g = reward + gamma * g
            assert got[traj, t] == pytest.approx(g, abs=1e-9)


def test_providers_and_classes(spark):
    asked = spark.createDataFrame([("q", "q - more")], "user_query string, sub_query string")
    assert mock_documents(asked).head()["relevance"] == 0.8

    def invoke(prompt):
        if prompt == "bad":
            raise RuntimeError("down")
        return prompt.upper()

    prompts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id long, prompt string")
    assert {(r["id"], r["response"], r["ok"], r["error"]) for r in with_model(prompts, invoke).collect()} == {(1, "A", True, None), (2, None, False, "down"), (3, None, False, "no prompt")}
    tasks = spark.range(60).select("id", (F.col("id") % 6).alias("batch"), F.concat(F.lit("t"), "id").alias("text"), F.lit(0).alias("retry_count"))
    made = mock_embeddings(tasks, 1536, 50, "batch").collect()
    assert all(r["ok"] == made[r["batch"]]["ok"] for r in made) and {r["ok"] for r in made} == {True, False}
    assert all(len(r["embedding"]) == 1536 and max(map(abs, r["embedding"])) < 2 for r in made if r["ok"])
    names = spark.createDataFrame([("transient",), (None,)], "name string")
    assert [r[0] for r in names.select(resilience.error_class(F.col("name"))).collect()] == ["transient", None]
    with pytest.raises(Exception, match="unknown error class"):
        names.select(resilience.error_class(F.lit("odd"))).collect()


def test_a_second_start_changes_nothing(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    start = lambda name: stream.writeStream.queryName(name).format("memory").option("checkpointLocation", str(tmp_path / "state")).start()
    first = start_once(spark, "only", start)
    try:
        assert start_once(spark, "only", start).id == first.id
    finally:
        first.stop()


def test_plans_do_not_grow_with_rounds(spark, small):
    from quern.operators import agents
    from quern.plans.catalogue import edges

    start = spark.createDataFrame([("c1",)], "node string")
    plan = agents.k_hop(edges(spark, small), start, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 8
