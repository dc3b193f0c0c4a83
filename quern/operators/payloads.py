"""Payload index: words of bits per payload value, intersected before anything is scored, and filtered search through it.

Every row of the index has a number. For each key and value of its payload, 64
neighbouring numbers share a word with a bit for each row that has the value; only
words with bits are rows. A filter is an OR of its values' words, several filters an AND, both
combining aggregates over word numbers: no key of them is hot, and a frequent value is many words.

A search first counts the rows that its filters leave. If they are few, they
are looked up by number and scored all (filter first); if they are many, the lists of
the vector index are searched, each as far as it can hold something near enough, and rows without
their bit are left out (index first). Both are exact, so the choice changes the cost and never the result.

Nulls and limits: a missing or null value is a value of its own and matches the
filter value None; an array is all of its values, an empty one is None; rows whose vectors
cannot be compared have no number; without filters all rows count; ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import index
from quern.operators.search import search_many
from quern.session import stage

#: The key that every row has.
ALL = ""


@dataclass(frozen=True)
class Payloads:
    """``rows``: id, v, list, near, number; ``words``: key, value, word, bits; ``centers`` of the lists."""

    rows: DataFrame
    words: DataFrame
    centers: np.ndarray


def build(table: DataFrame, payload: dict[str, Column], path: str, lists: int = 64) -> Payloads:
    """Writes the index of ``table`` (id, vector and what ``payload`` names: an expression, string or array of strings, per key) to ``path``."""
    spark = table.sparkSession
    centers = index.fit_centroids(table.select("id", "vector"), lists)
    keys = {f"key_{k}": value for k, value in enumerate(payload.values())}
    rows = index.build(table.select("id", "vector", *(v.alias(name) for name, v in keys.items())), centers, tuple(keys))
    # Numbers come from partitions and places, so they are written before anything refers to them.
    # Sorted by list and key, so a search's filters skip row groups; ranges also cut a long list or a frequent value.
    rows.repartitionByRange("list", "id").sortWithinPartitions("list").withColumn("number", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    written = spark.read.parquet(f"{path}/rows")
    entries = [F.struct(F.lit(ALL).alias("key"), F.array(F.lit(ALL)).alias("values"))]
    for key, name in zip(payload, keys, strict=True):
        many = written.schema[name].dataType.typeName() == "array"
        values = F.col(name) if many else F.array(F.col(name))
        entries.append(F.struct(F.lit(key).alias("key"), F.when(F.size(values) > 0, values.cast("array<string>")).otherwise(F.array(F.lit(None).cast("string"))).alias("values")))
    each = written.select("number", F.explode(F.array(*entries)).alias("e")).select("number", "e.key", F.explode("e.values").alias("value"))
    bit = F.expr("shiftleft(1L, cast(number % 64 as int))")
    words = each.groupBy("key", "value", F.expr("number div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    words.repartitionByRange("key", "value", "word").sortWithinPartitions("key", "value", "word").write.parquet(f"{path}/words")
    spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centers)], "list int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Payloads:
    centers = spark.read.parquet(f"{path}/centers").orderBy("list").collect()  # a row per list
    return Payloads(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/words"), np.array([c["center"] for c in centers]) if centers else np.zeros((0, 1)))


def select(found: Payloads, filters: dict[str, object]) -> DataFrame:
    """word, bits of the rows that pass all filters; a filter is a value, None, or a list of values of which one is enough."""
    given = {ALL: [ALL]} | {k: v if isinstance(v, list) else [v] for k, v in filters.items()}
    parts = None
    for number, (key, values) in enumerate(given.items()):
        if key == ALL and len(given) > 1:
            continue
        some = F.lit(False)
        for value in values:
            some = some | F.col("value").eqNullSafe(F.lit(value))
        part = found.words.filter((F.col("key") == key) & some).select(F.lit(number).alias("filter"), "word", "bits")
        parts = part if parts is None else parts.unionByName(part)
    each = parts.groupBy("filter", "word").agg(F.bit_or("bits").alias("bits"))
    wanted = max(1, len(given) - 1)
    both = each.groupBy("word").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n"))
    return both.filter((F.col("n") == wanted) & (F.col("bits") != 0)).select("word", "bits")


def count(words: DataFrame) -> int:
    return words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))).head()[0]


def numbers(words: DataFrame) -> DataFrame:
    """The rows' numbers out of their words."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit(F.col("bits"), k) == 1)
    return words.select("word", F.explode(bits).alias("bit")).select((F.col("word") * 64 + F.col("bit")).alias("number"))


def search(found: Payloads, queries: DataFrame, filters: dict[str, object], k: int = 10, few: int = 100_000, way: str | None = None) -> tuple[DataFrame, str]:
    """query_id, id, score, rank of the k nearest rows that pass ``filters``, and the way taken: "filter" up to ``few`` rows, "index" beyond."""
    spark = queries.sparkSession
    words = stage(spark, select(found, filters), "payload-words")
    n = count(words)
    way = way or ("filter" if n <= few else "index")
    if way == "filter":
        mine = numbers(words)
        kept = found.rows.join(F.broadcast(mine) if n <= 100_000 else mine, "number", "left_semi")
        return search_many(queries, kept.select("id", F.col("v").alias("vector")), k), way
    # A word of 64 rows each: broadcast if few, else joined by word.
    at = found.rows.withColumn("word", F.expr("number div 64"))
    small = words.count() <= 100_000
    kept = at.join(F.broadcast(words) if small else words, "word").filter(F.getbit("bits", F.expr("cast(number % 64 as int)")) == 1)
    return index.exact(queries, kept.select("id", "v", "list", "near"), found.centers, k)[0], way
