"""Retry, dead letters, routing with fallback, limits, breakers and micro-batches over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.machines import Backlog, Breaker, CallWrapper, MicroBatcher, Router, TokenBucket, WaitingBucket, WorkerBatcher
from quern.operators.fold import ordered_fold


def token_bucket(requests: DataFrame, key: str, order: list[str], now_us: str, bucket: TokenBucket, limits: DataFrame | None = None) -> DataFrame:
    """``requests`` plus tokens and allowed. ``limits`` (key, capacity, rate) override the bucket's per client."""
    if limits is None:
        return ordered_fold(requests, [key], order, bucket, [now_us])
    own = requests.join(limits.select(key, "capacity", "rate"), key, "left")
    rows = own.withColumn("cost", F.lit(1.0)).withColumn("capacity", F.coalesce("capacity", F.lit(bucket.capacity))).withColumn("rate", F.coalesce("rate", F.lit(bucket.rate)))
    return ordered_fold(rows, [key], order, bucket, [now_us, "cost", "capacity", "rate"])


def grant_times(requests: DataFrame, key: str, order: list[str], now_us: str, bucket: WaitingBucket) -> DataFrame:
    """``requests`` plus the time at which a waiting caller gets its token."""
    return ordered_fold(requests, [key], order, bucket, [now_us])


def breaker(calls: DataFrame, key: str, order: list[str], now_us: str, success: str, machine: Breaker) -> DataFrame:
    """``calls`` plus allowed, state after the call, and its failure count."""
    return ordered_fold(calls, [key], order, machine, [now_us, success])


def wrapped_calls(calls: DataFrame, key: str, order: list[str], now_us: str, done_us: str, ok_at: str, fallback: str, machine: CallWrapper) -> DataFrame:
    """``calls`` plus outcome (OK, FALLBACK, OPEN or FAILED), attempts made, and the breaker's state and failures after the call."""
    return ordered_fold(calls, [key], order, machine, [now_us, done_us, ok_at, fallback])


def routed(requests: DataFrame, keys: list[str], order: list[str], now_us: str, chain: str, ok: str, machine: Router) -> DataFrame:
    """``requests`` plus provider, is_fallback, providers tried, and status; outcomes move the breakers, request by request.

    ``chain`` holds the providers in order (nulls leave it before positions are
    given), ``ok`` whether each would succeed. A router's requests depend on one
    another through its breakers, so a router is one task's work.
    """
    return ordered_fold(requests, keys, order, machine, [now_us, chain, ok])


def limit_requests(requests: DataFrame, api_key: str, host: str, order: list[str], now_us: str, bucket: TokenBucket = TokenBucket(50.0, 10.0)) -> DataFrame:
    """``requests`` plus client (the API key, or the host where none is given), tokens left, and status: 200, or 429 for the rejected."""
    client = F.coalesce(F.when(F.col(api_key) != "", F.col(api_key)), F.col(host))
    rows = token_bucket(requests.withColumn("client", client), "client", order, now_us, bucket)
    return rows.withColumn("status", F.when(F.col("allowed"), 200).otherwise(429)).drop("allowed")


#: The classes of errors.
ERROR_CLASSES = ("circuit_open", "transient", "permanent")


def error_class(name: Column) -> Column:
    """One of the classes, or null; any other name is an error."""
    return F.when(name.isNull() | name.isin(*ERROR_CLASSES), name).otherwise(F.raise_error(F.concat(F.lit("unknown error class "), name)))


def outcomes_at(attempts: DataFrame, key: list[str], at: str, stop: Column, max_retries: int = 3) -> DataFrame:
    """What a worker that stops at ``stop`` has done: a task's later attempts do not happen, and the task is PENDING, never lost."""
    rows = attempts.withColumn("late_", F.col(at) > stop)
    none = F.when(~F.col("late_"), F.col("ok"))
    seen = rows.groupBy(*key).agg(F.min(F.when(none, F.col("attempt"))).alias("won"), F.count_if(~none).alias("failed"))
    retries = F.least(F.coalesce(F.col("won") - 1, F.col("failed")), F.lit(max_retries + 1)).cast("long")
    status = F.when(retries > max_retries, "DEAD").when(F.col("won").isNotNull(), "DELIVERED").otherwise("PENDING")
    return seen.select(*key, retries.alias("retry_count"), status.alias("status"))


def worker_batches(arrivals: DataFrame, keys: list[str], order: list[str], now_us: str, machine: WorkerBatcher) -> DataFrame:
    """``arrivals`` plus batch number and position, per key, by the clock of the worker's loop."""
    return ordered_fold(arrivals, keys, order, machine, [now_us])


def micro_batches(arrivals: DataFrame, keys: list[str], order: list[str], now_us: str, machine: MicroBatcher) -> DataFrame:
    """``arrivals`` plus batch number and position, per key."""
    return ordered_fold(arrivals, keys, order, machine, [now_us])


def shed_load(arrivals: DataFrame, keys: list[str], order: list[str], now_us: str, machine: Backlog) -> DataFrame:
    """``arrivals`` plus queue depth, and whether a full queue dropped the row."""
    return ordered_fold(arrivals, keys, order, machine, [now_us])


def backoff_cap(attempt: Column, base: float = 0.5, most: float = 5.0) -> Column:
    """Upper end of the jitter before the next try; the jitter itself is a caller's random draw below it."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt))


def jitter(cap: Column, *keys: str) -> Column:
    """A delay below the cap, the same on every run: drawn from a hash of the keys."""
    return cap * (F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) / 1_000_000.0)


def geometric_delay(attempt: Column, base: float = 0.5, factor: float = 1.5) -> Column:
    return base * F.pow(F.lit(factor), attempt)


def retry_outcomes(attempts: DataFrame, key: list[str], max_retries: int = 3) -> DataFrame:
    """Per task: its retries, and whether it is DELIVERED, DEAD (failures beyond the retries) or still PENDING.

    ``attempts`` has attempt (from 1) and ok. What follows a first success does not count.
    """
    # The first success is a minimum and the failures before it follow from it, so the aggregate is two partial sums.
    rows = attempts.groupBy(*key).agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("won"), F.count_if(~F.col("ok")).alias("failed"), F.max("attempt").alias("tries"))
    retries = F.least(F.coalesce(F.col("won") - 1, F.col("failed")), F.lit(max_retries + 1)).cast("long")
    status = F.when(retries > max_retries, "DEAD").when(F.col("won").isNotNull(), "DELIVERED").otherwise("PENDING")
    return rows.select(*key, retries.alias("retry_count"), status.alias("status"))


def first_success(attempts: Column, most: int = 5) -> Column:
    """Outcome of a request from its attempts (array of outcome classes): transient errors are tried again, others end it."""
    tried = F.slice(attempts, 1, most)
    ended = F.filter(tried, lambda a: a != "transient")
    return F.when(F.size(ended) > 0, F.get(ended, F.lit(0))).otherwise(F.lit("transient"))


def attempts_made(attempts: Column, most: int = 5) -> Column:
    tried = F.slice(attempts, 1, most)
    at = F.array_position(F.transform(tried, lambda a: a != "transient"), F.lit(True))
    return F.when(at > 0, at).otherwise(F.size(tried)).cast("long")


#: The capability with a chain of its own, its providers, and those of all others, in order.
CODE = "code_gen"
CODE_CHAIN = ("vllm_local", "saas_primary")
OTHER_CHAIN = ("saas_primary", "saas_fallback")


def route(capability: Column) -> Column:
    """Providers to try, in order."""
    chain = lambda names: F.array(*map(F.lit, names))
    return F.when(capability == CODE, chain(CODE_CHAIN)).otherwise(chain(OTHER_CHAIN))


def fall_back(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``requests`` (request_id, route) plus the first provider that is allowed and succeeds, and whether it is a fallback.

    ``outcomes`` has request_id, provider, allowed, ok; a provider without a row
    is allowed. Null providers leave the chain before positions are given.
    """
    chain = requests.select("request_id", F.posexplode(F.array_compact("route")).alias("pos", "provider"))
    tried = chain.join(outcomes, ["request_id", "provider"], "left").filter(F.coalesce("allowed", F.lit(True)) & F.coalesce("ok", F.lit(False)))
    best = tried.groupBy("request_id").agg(F.min_by("provider", "pos").alias("provider"), F.min("pos").alias("pos"))
    return requests.join(best, "request_id", "left").select("request_id", "provider", (F.col("pos") > 0).alias("is_fallback"), F.when(F.col("provider").isNull(), "EXHAUSTED").otherwise("OK").alias("status"))
