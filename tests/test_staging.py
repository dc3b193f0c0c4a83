"""Staged tables have the scope of the job that staged them."""

import threading

from pyspark.sql import functions as F

from quern.session import shared_dir, stage, staging
from quern.streaming.processors import deliver


def test_a_scope_drops_its_own_tables_only(spark):
    outer = stage(spark, spark.range(3), "outer")
    with staging(spark):
        mine = stage(spark, spark.range(4), "mine")
        with staging(spark):
            inner = stage(spark, spark.range(5), "inner")
            assert inner.count() == 5
        assert mine.count() == 4 and not exists(spark, inner)
    assert outer.count() == 3 and not exists(spark, mine) and exists(spark, outer)


def exists(spark, df):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_scopes_of_threads_do_not_meet(spark):
    """The one that began first ends while the other still reads its tables, and the other way round."""
    first_ended, second_staged, told = threading.Event(), threading.Event(), {}

    def first():
        with staging(spark):
            stage(spark, spark.range(2), "first")
            second_staged.wait(60)
        first_ended.set()

    def second():
        with staging(spark):
            df = stage(spark, spark.range(7), "second")
            second_staged.set()
            first_ended.wait(60)
            told["rows"] = df.count()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert told == {"rows": 7}


def test_an_error_drops_what_was_staged(spark):
    try:
        with staging(spark):
            df = stage(spark, spark.range(2), "failed")
            raise ValueError
    except ValueError:
        assert not exists(spark, df)


def test_two_deliveries_and_a_query_side_by_side(spark, tmp_path):
    """Interleaved micro-batches of two streams, and a staged table of this thread: every task ends in one of the two tables."""
    beside = stage(spark, spark.range(11), "beside")
    for name in "ab":
        for k in range(3):
            spark.range(20 * k, 20 * k + 20).select("id", F.concat(F.lit(name), F.col("id").cast("string")).alias("text")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")

    def provider(rows):
        return rows.withColumn("ok", F.pmod(F.xxhash64("text", "retry_count"), F.lit(3)) != 0).withColumn("error", F.lit(None).cast("string"))

    def run(name):
        stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
        return deliver(stream, provider, f"{tmp_path}/{name}/results", f"{tmp_path}/{name}/dead", f"{tmp_path}/{name}/checkpoint", max_retries=1)

    queries = [run(name) for name in "ab"]
    for q in queries:
        q.awaitTermination(240)
        assert q.exception() is None
    for name in "ab":
        done, dead = (spark.read.parquet(f"{tmp_path}/{name}/{t}").select("id") for t in ("results", "dead"))
        assert sorted(r["id"] for r in done.union(dead).collect()) == list(range(60))
    assert beside.count() == 11 and shared_dir(spark)
