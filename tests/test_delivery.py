"""Requests joined to their results, and retries that wait, as streams and as tables."""

import time
from datetime import datetime, timedelta
from zlib import crc32

from pyspark.sql import functions as F

from quern.streaming.processors import answered, retried

T0 = datetime(2024, 3, 1, 12, 0, 0)
REQUESTS = "request_id long, asked_at timestamp, text string"
RESULTS = "request_id long, done_at timestamp, answer string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def told(rows):
    return sorted((r["request_id"], r["answer"], r["status"]) for r in rows)


def test_results_come_back_to_their_requests(spark, tmp_path):
    """In time, late, twice, lost, before the request, and without one; the table's and the stream's answers agree."""
    requests = [(k, at(k), f"q{k}") for k in range(6)]
    results = [(0, at(1), "in time"), (1, at(40), "too late"), (2, at(3), "first"), (2, at(4), "second"), (4, at(3), "before"), (5, at(15), "at the limit"), (77, at(5), "of none")]
    df = spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(results, RESULTS)
    want = [(0, "in time", "OK"), (1, None, "TIMED_OUT"), (2, "first", "OK"), (3, None, "TIMED_OUT"), (4, None, "TIMED_OUT"), (5, "at the limit", "OK")]
    assert told(answered(*df).collect()) == want
    # The streams: both in several files, and at last rows that move the watermarks beyond all of it.
    last = (99, at(600), "last")
    for name, rows, schema in (("requests", [requests[:3], requests[3:], [last], [(100, at(601), "x")]], REQUESTS), ("results", [results[:1], results[1:], [(99, at(601), "done")], [(100, at(602), "x")]], RESULTS)):
        for k, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            time.sleep(0.05)
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    q = answered(read("requests", REQUESTS), read("results", RESULTS)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    assert [r for r in told(spark.read.parquet(f"{tmp_path}/out").collect()) if r[0] < 90] == want


def test_odd_requests(spark):
    requests = spark.createDataFrame([(None, at(0), "a"), (1, None, "b"), (2, at(0), None), (2, at(0), None)], REQUESTS)
    results = spark.createDataFrame([(None, at(0), "x"), (1, at(1), "x"), (2, None, "x"), (2, at(1), None)], RESULTS)
    assert [(r["request_id"], r["status"]) for r in answered(requests, results).orderBy("request_id", "text").collect()] == [(None, "TIMED_OUT"), (1, "TIMED_OUT"), (2, "OK"), (2, "OK")]
    assert answered(requests.limit(0), results).count() == 0 and answered(requests, results.limit(0)).filter("status = 'OK'").isEmpty()


def provider(task, failed):
    if crc32(f"{task['id']}|{failed}".encode()) % 5 == 0:
        raise OSError("down")
    return crc32(f"{task['id']}|{failed}".encode()) % 2 == 0


def outcome(k):
    for failed in range(4):
        code = crc32(f"{k}|{failed}".encode())
        if code % 5 and code % 2 == 0:
            return failed, "DELIVERED"
    return 4, "DEAD"


def test_retries_wait_across_batches_and_a_restart(spark, tmp_path):
    """A query that is stopped while tasks wait, and started again, ends each task once, as its attempts say."""
    for k in range(2):
        spark.range(60 * k, 60 * k + 60).withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def start():
        stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return retried(stream, "id", provider, base=1.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="500 milliseconds").start()

    def done():
        try:
            return spark.read.schema("id long, text string, retry_count int, status string").parquet(f"{tmp_path}/out").collect()
        except Exception:  # noqa: BLE001  nothing is written yet
            return []

    first, until = start(), time.time() + 90
    while not done() and time.time() < until:
        time.sleep(0.3)
    first.stop()
    early = len(done())
    assert 0 < early < 120  # some tasks still wait
    second, until = start(), time.time() + 150
    while len(done()) < 120 and time.time() < until:
        time.sleep(1)
    assert second.exception() is None
    second.stop()
    assert sorted((r["id"], r["retry_count"], r["status"]) for r in done()) == [(k, *outcome(k)) for k in range(120)]
    assert all(r["text"] == f"t{r['id']}" for r in done()) and {"DELIVERED", "DEAD"} == {r["status"] for r in done()}
