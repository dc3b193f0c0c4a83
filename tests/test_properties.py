"""Properties of the machines, and batch folds against their streaming twins."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions.machines import Breaker, MicroBatcher, RollingPercentiles, Router, TokenBucket, WorkerBatcher
from quern.operators.fold import ordered_fold
from quern.streaming.processors import deliver, stream_fold


@given(st.lists(st.integers(0, 10**7), max_size=50), st.floats(1, 10), st.floats(0.01, 5))
def test_tokens_stay_within_the_bucket(gaps, capacity, rate):
    bucket, now = TokenBucket(capacity, rate), 0
    state = bucket.start()
    for gap in gaps:
        now += gap
        state, (tokens, _) = bucket.step(state, now)
        assert 0 <= tokens <= capacity


@given(st.lists(st.integers(0, 200_000), max_size=60), st.integers(1, 8))
def test_batches_are_bounded_and_ordered(gaps, size):
    machine, now, state, seen = MicroBatcher(size), 0, MicroBatcher(size).start(), []
    for gap in gaps:
        now += gap
        state, out = machine.step(state, now)
        seen.append(out)
    assert all(p < size for _, p in seen) and [b for b, _ in seen] == sorted(b for b, _ in seen)


@settings(max_examples=30)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.integers(1, 10))
def test_rolling_median_is_within_the_frame(values, size):
    machine = RollingPercentiles(size)
    state = machine.start()
    for k, v in enumerate(values):
        state, (p50, p99) = machine.step(state, v)
        frame = values[max(0, k - size + 1) : k + 1]
        assert min(frame) - 1e-6 <= p50 <= p99 + 1e-6 <= max(frame) + 1e-5


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    rows = [(k % 5, k, k * 400_000 + (k * 7919) % 300_000, (k * 31) % 3 != 0, float(k * 37 % 101)) for k in range(200)]
    df = spark.createDataFrame(rows, "key long, n long, us long, ok boolean, value double")
    path = str(tmp_path_factory.mktemp("calls"))
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return path


@pytest.mark.parametrize(
    ("machine", "inputs"),
    [(TokenBucket(3, 0.4), ["us"]), (Breaker(1, 2, 3_000_000), ["us", "ok"]), (Breaker(2, 2, 3_000_000), ["us", "ok"]), (MicroBatcher(4, 5_000_000), ["us"]), (RollingPercentiles(10), ["value"])],
    ids=["bucket", "breaker1", "breaker2", "batches", "percentiles"],
)
def test_stream_equals_batch(spark, calls, tmp_path, machine, inputs):
    df = spark.read.parquet(calls)
    want = {tuple(r) for r in ordered_fold(df, ["key"], ["us"], machine, inputs).collect()}
    stream = stream_fold(spark.readStream.schema(df.schema).parquet(calls), ["key"], ["us"], machine, inputs)
    out = str(tmp_path / "out")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want


def test_results_and_dead_letters_are_the_input(spark, tmp_path):
    from pyspark.sql import functions as F

    source = str(tmp_path / "in")
    tasks = spark.range(50).select("id", F.lit("t").alias("tenant_id"), F.lit("x").alias("text"))
    tasks.write.parquet(source)

    def provider(df):
        return df.withColumn("ok", (F.col("id") % 3 != 0) | ((F.col("retry_count") > 1) & (F.col("id") % 2 == 0))).withColumn("error", F.lit(None).cast("string"))

    stream = spark.readStream.schema(tasks.schema).parquet(source)
    deliver(stream, provider, str(tmp_path / "ok"), str(tmp_path / "dead"), str(tmp_path / "state")).awaitTermination(120)
    ok, dead = ([r["id"] for r in spark.read.parquet(str(tmp_path / k)).collect()] for k in ("ok", "dead"))
    assert sorted(ok + dead) == list(range(50))
    assert set(dead) == {k for k in range(50) if k % 3 == 0 and k % 2}


def test_a_provider_that_does_not_repeat_itself_runs_once_a_row(spark, tmp_path):
    from pyspark.sql import functions as F

    source, log = str(tmp_path / "in"), tmp_path / "calls"
    log.mkdir()
    tasks = spark.range(400).select("id", F.lit("t").alias("tenant_id"), F.lit("x").alias("text"))
    tasks.write.parquet(source)

    def provider(df):
        def run(batches):
            import random
            import uuid

            for b in batches:
                (log / uuid.uuid4().hex).write_text("\n".join(f"{i} {k}" for i, k in zip(b["id"], b["retry_count"], strict=True)))
                yield b.assign(ok=[random.random() < 0.4 for _ in range(len(b))], error=None)

        return df.mapInPandas(run, df.selectExpr("*", "true as ok", "cast(null as string) as error").schema)

    stream = spark.readStream.schema(tasks.schema).parquet(source)
    deliver(stream, provider, str(tmp_path / "ok"), str(tmp_path / "dead"), str(tmp_path / "state")).awaitTermination(180)
    ok, dead = ([r["id"] for r in spark.read.parquet(str(tmp_path / k)).collect()] for k in ("ok", "dead"))
    assert sorted(ok + dead) == list(range(400)) and dead
    calls = [line for f in log.iterdir() for line in f.read_text().split("\n") if line]
    assert len(calls) == len(set(calls))


@settings(max_examples=200)
@given(st.lists(st.tuples(st.integers(0, 10**5), st.booleans(), st.booleans()), max_size=40), st.booleans())
def test_routed_requests_end_once(events, registered):
    router = Router((("a", Breaker(2, 2, 50_000)), ("b", Breaker(1, 2, 50_000))) if registered else ())
    state, now = router.start(), 0
    for gap, a, b in events:
        now += gap
        state, (provider, fallback, tried, status) = router.step(state, now, ["a", None, "b"], [a, True, b])
        assert (status == "OK") == (provider is not None) and 0 <= tried <= 2
        if not registered:
            assert provider == ("a" if a else "b" if b else None) and (provider is None or fallback == (provider == "b"))


@given(st.lists(st.integers(0, 200_000), max_size=60), st.integers(1, 5), st.integers(0, 90_000), st.integers(0, 5_000))
def test_worker_batches_are_those_of_a_played_loop(gaps, size, service, idle):
    """Against a loop that is played step by step over a queue."""
    wait = 50_000
    times = [sum(gaps[: k + 1]) for k in range(len(gaps))]
    machine, got = WorkerBatcher(size, wait, service, idle), []
    state = machine.start()
    for t in times:
        state, out = machine.step(state, t)
        got.append(out)
    want, begin, k, batch = [], 0, 0, 0
    while k < len(times):
        taken, clock = 0, begin
        while taken < size and k < len(times) and max(clock, times[k]) < begin + wait:
            clock = max(clock, times[k])
            want.append((batch, taken))
            taken, k = taken + 1, k + 1
        if not taken:
            begin += wait + idle
        else:
            begin, batch = (clock if taken == size else begin + wait) + service, batch + 1
    assert got == want
