from pyspark.sql import functions as F

from quern.sources.stores import VectorStore, mock_embeddings, streams_of, with_provider, write_dead_letters, write_json


def test_vector_store_keeps_the_latest_row(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"), 2)
    schema = "id string, vector array<double>, tenant_id string, allowed_roles array<string>, metadata map<string,string>, seq long"
    store.upsert(spark.createDataFrame([("a", [3.0, 4.0], "t", [], {}, 1), ("b", [0.0, 0.0], "t", [], {}, 2)], schema))
    store.upsert(spark.createDataFrame([("a", [0.0, 2.0], "t", [], {"k": "v"}, 3)], schema))
    rows = {r["id"]: (list(r["vector"]), r["first_seq"]) for r in store.read().collect()}
    assert rows == {"a": ([0.0, 1.0], 1), "b": ([0.0, 0.0], 2)}
    assert store.count() == 2
    assert store.compact(str(tmp_path / "compact")).count() == 2


def test_wrong_dimension_is_an_error(spark, tmp_path):
    import pytest

    store = VectorStore(spark, str(tmp_path / "store"), 3)
    with pytest.raises(Exception, match="expected 3 components"):
        store.upsert(spark.createDataFrame([("a", [1.0], 1)], "id string, vector array<double>, seq long"))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 4), (2, 1)], "id long, retry_count int")
    assert [r["id"] for r in write_dead_letters(rows, str(tmp_path / "dead")).collect()] == [2]
    assert spark.read.parquet(str(tmp_path / "dead")).head()["id"] == 1
    write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_streams_keep_their_order(spark):
    one = spark.createDataFrame([("a", 1.0)], "id string, score double")
    assert [(r["stream"], r["stream_ord"]) for r in streams_of(dense=one, sparse=one).collect()] == [("dense", 0), ("sparse", 1)]


def test_providers(spark):
    tasks = spark.range(40).select("id", F.lit("t").alias("tenant_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(0).alias("retry_count"))
    first, again = (mock_embeddings(tasks).orderBy("id").collect() for _ in range(2))
    assert first == again and 0 < sum(not r["ok"] for r in first) < 20
    got = with_provider(tasks, lambda texts: [[float(len(t))] for t in texts], 1).collect()
    assert all(r["ok"] and r["embedding"] == [float(len(r["text"]))] for r in got)
    short = with_provider(tasks, lambda texts: [[1.0]], 1).collect()
    assert not any(r["ok"] for r in short) and "expected" in short[0]["error"]
