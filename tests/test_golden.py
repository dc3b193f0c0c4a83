"""Cases worked out by hand from the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import rl
from quern.functions.machines import Breaker, MicroBatcher, RollingPercentiles, TokenBucket, WaitingBucket
from quern.functions.vectors import cosine, normalized
from quern.operators import agents, fusion, learning, resilience, search, telemetry, text


def test_payload_top_one_and_null_filter(spark):
    rows = spark.createDataFrame([("p", [3.0, 4.0, 0.0], {"shelf": "low"}), ("q", [0.0, 0.0, 2.0], {"shelf": "high"})], "id string, vector array<double>, payload map<string,string>")
    got = search.search(rows, [1.0, 2.0, 2.0], search.payload_matches({"shelf": "low"}), 1).collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [("p", round(11 / 15, 6))]
    assert search.search(rows, [1.0, 0.0, 0.0], search.payload_matches({"absent": None})).count() == 2
    assert search.search(rows, [1.0, 0.0, 0.0], search.payload_matches(None), 0).count() == 0
    with pytest.raises(ValueError):
        search.search(rows, [1.0, 0.0, 0.0], F.lit(True), -1)


def test_roles(spark):
    rows = spark.createDataFrame([("a", "t", []), ("b", "t", ["a"]), ("c", "t", ["b"]), ("d", "u", []), ("e", "t", None)], "id string, tenant_id string, allowed_roles array<string>")
    assert {r["id"] for r in rows.filter(search.visible("t", ["a"])).collect()} == {"a", "b", "e"}
    assert {r["id"] for r in rows.filter(search.visible("t", [])).collect()} == {"a", "e"}


def test_zero_vectors_score_zero(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0])], "id string, vector array<double>")
    assert [r["score"] for r in search.search(rows, [0.0, 0.0], F.lit(True)).collect()] == [0.0, 0.0]
    assert rows.select(normalized(F.col("vector")).alias("n"), cosine("vector", F.array(F.lit(1.0), F.lit(0.0))).alias("c")).head() == ([0.0, 0.0], 0.0)


def test_fused_lists(spark):
    lists = spark.createDataFrame([(0, [("A", "dense"), ("B", "dense")]), (1, [("B", "sparse"), ("C", "sparse")])], "list_ord int, items array<struct<id:string,text:string>>")
    got = [(r["id"], round(r["rrf_score"], 6), r["item"]["text"]) for r in fusion.rrf_lists(lists).collect()]
    assert got == [("B", 0.032522, "sparse"), ("A", 0.016393, "dense"), ("C", 0.016129, "sparse")]


def test_fusion_with_a_repeated_id(spark):
    ranked = spark.createDataFrame([("s", 0, "x", 1), ("s", 0, "y", 2), ("s", 0, "x", 3)], "stream string, stream_ord int, id string, rank int")
    got = {r["id"]: (r["rrf_score"], r["lineage"]) for r in fusion.rrf(ranked).collect()}
    assert got["x"] == (pytest.approx(1 / 61 + 1 / 63), {"s": 3})
    with pytest.raises(ValueError):
        fusion.rrf(ranked, 0)


def test_blend(spark):
    one = spark.createDataFrame([("a", 0.5)], "id string, rrf_score double")
    cross = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "id string, score double")
    assert fusion.blend(one, cross).head()["score"] == 0.0
    three = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "id string, rrf_score double")
    got = {r["id"]: r["score"] * 2 for r in fusion.blend(three, cross).collect()}
    assert got == {"a": pytest.approx(1.0), "b": pytest.approx(0.99207, abs=1e-5), "c": 0.0}


def test_machines():
    bucket = TokenBucket(2, 1)
    state, allowed = bucket.start(), []
    for _ in range(3):
        state, out = bucket.step(state, 0)
        allowed.append(out[1])
    assert allowed == [True, True, False]
    waiting = WaitingBucket(1, 1)
    state, granted = waiting.start(), []
    for _ in range(3):
        state, out = waiting.step(state, 0)
        granted.append(out[0])
    assert granted == [0, 1_000_000, 2_000_000]
    with pytest.raises(ValueError):
        waiting.step(waiting.start(), 0, 5.0)
    with pytest.raises(ValueError):
        WaitingBucket(1, 0)
    batcher = MicroBatcher(4)
    state, batches = batcher.start(), []
    for _ in range(6):
        state, out = batcher.step(state, 0)
        batches.append(out[0])
    assert batches == [0, 0, 0, 0, 1, 1]
    rolling = RollingPercentiles(1000)
    state = rolling.start()
    for x in range(1, 101):
        state, out = rolling.step(state, float(x))
    assert out == (50.5, pytest.approx(99.01))


@pytest.mark.parametrize(("variant", "at", "allowed"), [(1, 10, True), (2, 10, False), (2, 11, True), (3, 10, True)])
def test_breaker_variants_differ_at_the_timeout(variant, at, allowed):
    machine = Breaker(variant, 1, 10)
    state, _ = machine.step(machine.start(), 0, False)
    assert machine.step(state, 5, True)[1][0] is False
    assert machine.step(state, at, True)[1][0] is allowed


def test_retries(spark):
    attempts = spark.createDataFrame([("dead", n, False) for n in (1, 2, 3, 4)] + [("ok", 1, False), ("ok", 2, False), ("ok", 3, True)] + [("open", 1, False)], "id string, attempt int, ok boolean")
    got = {r["id"]: (r["retry_count"], r["status"]) for r in resilience.retry_outcomes(attempts, ["id"]).collect()}
    assert got == {"dead": (4, "DEAD"), "ok": (2, "DELIVERED"), "open": (1, "PENDING")}
    caps = spark.createDataFrame([(1,), (2,), (3,), (4,)], "n int").select(resilience.backoff_cap(F.col("n")).alias("c"), resilience.geometric_delay(F.col("n") - 1).alias("d")).collect()
    assert [r["c"] for r in caps] == [1.0, 2.0, 4.0, 5.0]
    assert [r["d"] for r in caps][:2] == [0.5, 0.75]


def test_bounded_search_stops_when_enough_is_found(spark):
    got = agents.bounded_search(spark.createDataFrame([("q",)], "user_query string"), lambda rows: rows).head()
    assert (got["loops"], got["n_docs"], round(got["sufficiency"], 6)) == (2, 3, 0.9)
    none = agents.bounded_search(spark.createDataFrame([("q",)], "user_query string"), lambda rows: rows.filter("false")).head()
    assert (none["loops"], none["n_docs"]) == (3, 0)


def test_throughput(spark):
    rows = spark.createDataFrame([(100, 200.0, 1200.0), (100, 200.0, 200.0)], "c long, f double, t double")
    assert [r["x"] for r in rows.select(telemetry.throughput(F.col("c"), F.col("f"), F.col("t")).alias("x")).collect()] == [100.0, 0.0]


def test_learning(spark):
    rewards = spark.createDataFrame([("p", 1.0), ("p", 0.0), ("p", 1.0), ("p", 0.0)], "prompt string, reward double")
    assert sorted(round(r["adv"], 4) for r in learning.group_advantages(rewards).collect()) == [-1.0, -1.0, 1.0, 1.0]
    steps = spark.createDataFrame([("t", k, 1.0) for k in range(3)], "traj string, t int, reward double")
    assert [r["g"] for r in learning.discounted_return(steps, gamma=0.5).orderBy("t").collect()] == [1.75, 1.5, 1.0]
    one = spark.range(1).select(rl.dpo(F.lit(-1.0), F.lit(-1.0), F.lit(-2.0), F.lit(-2.0)).alias("dpo"), rl.kl_token(F.lit(-1.0), F.lit(-1.0)).alias("kl")).head()
    assert (round(one["dpo"], 6), one["kl"]) == (0.693147, 0.0)


def test_bm25_and_chunks_of_odd_input(spark):
    docs = spark.createDataFrame([(1, "The cat"), (2, None), (3, ""), (4, "the the dog " * 50)], "id long, text string")
    assert {r["id"] for r in text.bm25(docs, "the").collect()} == {1, 4}
    assert text.bm25(docs, "...").count() == 0
    assert text.bm25(docs.limit(0), "the").count() == 0
    got = text.chunks(docs, 100, 20).filter("id = 4").orderBy("chunk_no").collect()
    whole = "the the dog " * 50
    assert all(r["chunk"] == whole[r["start"] : r["start"] + 100] for r in got) and got[-1]["start"] + len(got[-1]["chunk"]) == len(whole)
    with pytest.raises(ValueError):
        text.chunks(docs, 10, 10)
