"""Streaming twins of the ordered folds: the same state machines behind keyed, transactional state.

Rows of a key within a micro-batch are put in order before they are stepped
through; rows that come in a later micro-batch than their order would have it
are stepped through when they come. State lives in the RocksDB store, is
checkpointed with the query, and can be given a time to live.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.session import ship, stage, staging

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class MachineProcessor(StatefulProcessor):
    """Runs a state machine per key; its state is stored as one JSON value."""

    def __init__(self, machine, keys: list[str], order: list[str], inputs: list[str], columns: list[str], ttl_ms: int | None = None):
        self.machine, self.keys, self.order, self.inputs, self.columns, self.ttl_ms = machine, keys, order, inputs, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("state", T.StringType())])
        self.state = handle.getValueState("state", schema, self.ttl_ms) if self.ttl_ms else handle.getValueState("state", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        held = self.state.get() if self.state.exists() else None
        state = json.loads(held[0]) if held else self.machine.start()
        out = []
        for row in data[self.inputs].itertuples(index=False):
            state, got = self.machine.step(state, *(v.item() if hasattr(v, "item") else v for v in row))
            out.append(got)
        self.state.update((json.dumps(state),))
        new = pd.DataFrame(out, columns=[n for n, _ in self.machine.outputs], index=data.index)
        yield pd.concat([data, new], axis=1)[[*self.columns, *new.columns]]

    def close(self) -> None:
        pass


def stream_fold(stream: DataFrame, keys: list[str], order: list[str], machine, inputs: list[str], ttl_ms: int | None = None) -> DataFrame:
    """``stream`` with the machine's outputs, emitted per row as it arrives (append)."""
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = T.StructType([*stream.schema.fields, *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in machine.outputs)).fields])
    processor = MachineProcessor(machine, keys, order, inputs, stream.columns, ttl_ms)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if ttl_ms else "None")


def windowed_counts(events: DataFrame, ts: str, key: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and mean value per tumbling window and key; in a stream, later rows than ``late`` are dropped."""
    from pyspark.sql import functions as F

    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("__ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("__ts", length).alias("w"), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("window_start"), key, "n", "mean_value")


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the trigger limit is the back pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start_once(spark: SparkSession, name: str, start):
    """The running query of this name, or the one that ``start(name)`` starts: a second start changes nothing."""
    for query in spark.streams.active:
        if query.name == name:
            return query
    return start(name)


def attempts(tasks: DataFrame, provider, max_retries: int = 3) -> tuple[DataFrame, DataFrame]:
    """Delivered rows and dead ones after ``max_retries`` further attempts; together they are ``tasks``.

    ``provider`` maps a DataFrame of tasks with retry_count to one with ok and
    error added. What an attempt gave is written before anything is derived from
    it, so the provider runs once per attempt and row, and need not repeat itself.
    A null ``ok`` is a failure.
    """
    from pyspark.sql import functions as F

    spark, todo, done = tasks.sparkSession, tasks, None
    for attempt in range(max_retries + 1):
        tried = provider(todo.withColumn("retry_count", F.lit(attempt)))
        tried = stage(spark, tried.withColumn("ok", F.coalesce("ok", F.lit(False))), f"attempt-{attempt}")
        done = tried.filter("ok") if done is None else done.unionByName(tried.filter("ok"))
        failed = tried.filter("not ok")
        if attempt == max_retries or failed.isEmpty():
            return done, failed.withColumn("retry_count", F.lit(attempt + 1))
        todo = failed.select(*tasks.columns)


def deliver(stream: DataFrame, provider, results: str, dead: str, checkpoint: str, max_retries: int = 3):
    """Runs a provider over every micro-batch: delivered rows go to ``results``, failed ones, after their retries, to ``dead``.

    Retries happen within the batch, so every input row ends in exactly one of
    the two tables, and a restarted query rewrites a batch's own folders instead
    of adding to them; a stopped query leaves a batch to be run again, never lost.
    """

    def batch(df: DataFrame, number: int) -> None:
        with staging(df.sparkSession):
            tasks = stage(df.sparkSession, df, "tasks")  # the source is read once
            done, failed = attempts(tasks, provider, max_retries)
            done.write.mode("overwrite").parquet(f"{results}/batch={number}")
            failed.write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_results(results: DataFrame, keys: tuple[str, ...] = ("tenant_id", "id"), version: str = "batch") -> DataFrame:
    """The result store: one row per key, the last written one.

    Tenants do not overwrite each other's ids; ``keys=("id",)`` gives the store that lets them.
    """
    from pyspark.sql import functions as F

    rest = [c for c in results.columns if c not in keys]
    best = results.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("row"))
    return best.select(*keys, *(F.col("row")[c].alias(c) for c in rest))


def answered(requests: DataFrame, results: DataFrame, timeout: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """``requests`` (request_id, asked_at, ...) with done_at, answer and status of their result: OK, or TIMED_OUT without one.

    ``results`` has request_id, done_at, answer. A result counts from its request on
    until ``timeout`` after it; of several the first one counts: by ``done_at``
    in tables, by arrival in streams, where rows that come later than ``late`` are
    dropped and a request is told to have timed out once no result can come any more. Requests
    without an id or a time time out, in streams never; repeated requests are each answered.
    """
    from pyspark.sql import functions as F

    streaming = requests.isStreaming
    own = results.select(F.col("request_id").alias("answer_id"), "done_at", "answer")
    asked = requests
    if streaming:
        asked = requests.withWatermark("asked_at", late)
        own = own.withWatermark("done_at", late).dropDuplicatesWithinWatermark(["answer_id"])
    limit = F.expr(f"INTERVAL {timeout}")
    same = (F.col("request_id") == F.col("answer_id")) & (F.col("done_at") >= F.col("asked_at")) & (F.col("done_at") <= F.col("asked_at") + limit)
    status = F.when(F.col("answer_id").isNotNull(), "OK").otherwise("TIMED_OUT").alias("status")
    if streaming:
        return asked.join(own, same, "left_outer").select(*requests.columns, "done_at", "answer", status)
    # A table's requests may repeat, so each gets a number before its first result is looked for.
    numbered = stage(requests.sparkSession, asked.withColumn("number", F.monotonically_increasing_id()), "requests")
    met = numbered.select("number", "request_id", "asked_at").join(own, same)
    first = met.groupBy("number").agg(F.min(F.struct("done_at", "answer", "answer_id")).alias("first"))
    rows = numbered.join(first, "number", "left").withColumn("answer_id", F.col("first.answer_id"))
    return rows.select(*requests.columns, F.col("first.done_at").alias("done_at"), F.col("first.answer").alias("answer"), status)


class DelayedRetry(StatefulProcessor):
    """Attempts a task when it comes, and again whenever its delay has passed, until it succeeds or its retries are used up.

    State holds a waiting task and how often it failed; the timer that wakes it is
    checkpointed with the state, so a restarted query goes on waiting where it was.
    """

    def __init__(self, provider, columns: list[str], max_retries: int, base: float, most: float):
        self.provider, self.columns, self.max_retries, self.base, self.most = provider, columns, max_retries, base, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", T.StructType([T.StructField("task", T.StringType()), T.StructField("failed", T.IntegerType())]))

    def delay_ms(self, key: tuple, failed: int) -> int:
        """Full jitter below the doubled base: a hash of task and count instead of a random draw, so a batch that runs again waits as long."""
        from zlib import crc32

        cap = min(self.most, self.base * 2**failed)
        return 1 + int(1000 * cap * crc32(f"{key}|{failed}".encode()) / 2**32)

    def attempt(self, key: tuple, task: dict, failed: int, now: int) -> Iterator[pd.DataFrame]:
        ok = False
        try:
            ok = bool(self.provider(task, failed))
        except Exception:  # noqa: BLE001  a provider may fail in any way
            pass
        failed += not ok
        if ok or failed > self.max_retries:
            self.waiting.clear()
            yield pd.DataFrame([{**task, "retry_count": failed, "status": "DELIVERED" if ok else "DEAD"}])[[*self.columns, "retry_count", "status"]]
            return
        self.waiting.update((json.dumps(task), failed))
        self.handle.registerTimer(now + self.delay_ms(key, failed))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows))
        if self.waiting.exists():
            return  # the task is known and waits; a second one under its key is the same task
        task = json.loads(data.iloc[[0]][self.columns].to_json(orient="records"))[0]
        yield from self.attempt(key, task, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            task, failed = self.waiting.get()
            yield from self.attempt(key, json.loads(task), failed, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def retried(tasks: DataFrame, key: str, provider, max_retries: int = 3, base: float = 0.5, most: float = 5.0) -> DataFrame:
    """``tasks`` with retry_count and status, each once, DELIVERED or DEAD: ``provider(task, failed)`` says whether an attempt succeeds.

    A failed task is requeued: it waits its jittered delay in keyed state, across
    micro-batches and restarts, while others go on. Failures beyond ``max_retries`` are dead letters.
    Tasks are plain values by column; tasks without a key share one.
    """
    spark = tasks.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = T.StructType([*tasks.schema.fields, T.StructField("retry_count", T.IntegerType()), T.StructField("status", T.StringType())])
    return tasks.groupBy(key).transformWithStateInPandas(DelayedRetry(provider, tasks.columns, max_retries, base, most), schema, "Append", "ProcessingTime")
