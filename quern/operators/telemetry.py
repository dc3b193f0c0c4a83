"""Latency telemetry: throughput, rolling percentiles per key, and the exported payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.machines import RollingPercentiles
from quern.operators.fold import ordered_fold
from quern.session import stage


def throughput(completion_tokens: Column, ttft_ms: Column, total_ms: Column) -> Column:
    """Tokens per second of generation; 0 where no time passed."""
    seconds = (total_ms - ttft_ms) / 1000
    return F.when(seconds > 0, completion_tokens / F.when(seconds > 0, seconds)).otherwise(F.lit(0.0))


def rolling_percentiles(events: DataFrame, keys: list[str], order: list[str], value: str, size: int = 1000) -> DataFrame:
    """p50 and p99 of the last ``size`` events of a key, the current one included, per event in arrival order.

    A native window recomputes an exact percentile for every row; the fold keeps
    the frame sorted, which is far cheaper at frames of a thousand rows.
    """
    return ordered_fold(events, keys, order, RollingPercentiles(size), [value])


def rolling_percentiles_split(events: DataFrame, keys: list[str], time: str, tie: str, value: str, size: int = 1000, rows: int = 100_000) -> DataFrame:
    """The same with the events cut by rank into slices of about ``rows`` rows, so that one key, and one time, is many tasks' work.

    A range partitioning on key, time and tie (and a row's own place, for rows
    alike in all) gives the slices. A frame reaches back at most ``size`` - 1 rows, so
    a slice gets copies of the last rows of those before it, as many as its first row
    can see, and drops them at the end. Nulls in ``time`` come first; a null or NaN
    value takes a place in the frame and is no number in it. Columns may have any names but p50 and p99.
    """
    spark = events.sparkSession
    ks = [f"k{i}" for i in range(len(keys))]
    inner = events.select(*(F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)), F.col(time).alias("time"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("value"), F.struct(*(F.col(f"`{c}`") for c in events.columns)).alias("row"), F.monotonically_increasing_id().alias("own"))
    order = [*ks, F.col("time").asc_nulls_first(), F.col("tie").asc_nulls_first(), "own"]
    dealt = inner.repartitionByRange(max(1, -(-events.count() // rows)), *order).sortWithinPartitions(*order)
    dealt = stage(spark, dealt.select(*ks, "value", "row", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("pos")), "rolling-rows")
    # How many rows lie between the ends of a key's slices says which slices still see which.
    until = Window.partitionBy(*ks).orderBy("slice")
    sizes = dealt.groupBy(*ks, "slice").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
    ends = stage(spark, sizes.select(*ks, "slice", "last", F.sum("n").over(until).alias("end"), (F.sum("n").over(until) - F.col("n")).alias("begin")), "rolling-slices")
    later = ends.select(*(F.col(k).alias(f"{k}_") for k in ks), F.col("slice").alias("to"), F.col("begin").alias("first"))
    same = lambda df: [F.col(k).eqNullSafe(df[f"{k}_"]) for k in ks]
    seen = ends.join(later, [*same(later), F.col("to") > F.col("slice"), F.col("first") - F.col("end") < size - 1])
    reach = seen.groupBy(*(F.col(k).alias(f"{k}_") for k in ks), F.col("slice").alias("of"), "last").agg(F.collect_list(F.struct("to", (F.col("first") - F.col("end")).alias("between"))).alias("seen"))  # size - 1 slices at most
    tails = dealt.join(reach, [*same(reach), F.col("slice") == F.col("of")]).withColumn("back", F.col("last") - F.col("pos") + 1).filter(F.col("back") < size)
    copies = tails.withColumn("e", F.explode("seen")).filter(F.col("back") + F.col("e.between") < size)
    copies = copies.select(*ks, "value", "row", F.col("e.to").alias("slice"), "pos", F.lit(True).alias("copy"))
    both = dealt.withColumn("copy", F.lit(False)).unionByName(copies)
    folded = ordered_fold(both, [*ks, "slice"], ["pos"], RollingPercentiles(size), ["value"])
    return folded.filter(~F.col("copy")).select("row.*", "p50", "p99")


def rolling_percentiles_native(events: DataFrame, keys: list[str], order: list[str], value: str, size: int = 1000) -> DataFrame:
    """The same by a window expression: the definition, for checks and for short frames."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - size, 0)
    return events.select("*", F.percentile(value, 0.5).over(w).alias("p50"), F.percentile(value, 0.99).over(w).alias("p99"))


#: Fixed value: the type that every exported document names.
EVENT_TYPE = "llm_generation_metrics"


def payload(rows: DataFrame, *keep: str) -> DataFrame:
    """One JSON document per event, with the metrics nested, beside the columns to ``keep``.

    ``rows`` has tenant_id, model_variant, timestamp (epoch seconds), the token
    counts and latencies, throughput_tps, and p50 and p99 of the time to first token.
    """
    two = lambda c, name: F.bround(c, 2).alias(name)
    metrics = F.struct("prompt_tokens", "completion_tokens", "ttft_ms", "total_latency_ms", two("throughput_tps", "throughput_tps"), two("p50", "ttft_p50_ms"), two("p99", "ttft_p99_ms"))
    document = F.struct(F.lit(EVENT_TYPE).alias("event_type"), "timestamp", "tenant_id", "model_variant", metrics.alias("metrics"))
    return rows.select(*keep, F.to_json(document).alias("payload"))
