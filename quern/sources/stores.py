"""Sources and sinks: a vector store on Parquet, JSON and dead-letter sinks, and deterministic providers."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.vectors import normalized, of_dimension
from quern.operators.search import upsert_latest
from quern.session import ship


class VectorStore:
    """Append-only log of vectors under a folder; reads give the latest row per id.

    Columns: id, vector, tenant_id, allowed_roles, metadata, seq. Appending is
    one file write and never reads what is there; ``compact`` rewrites the log.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int):
        self.spark, self.path, self.dimension = spark, path, dimension

    def upsert(self, records: DataFrame) -> None:
        """Checks the dimension, normalises, and appends; of an id the row with the greatest ``seq`` counts."""
        checked = records.withColumn("vector", of_dimension(F.col("vector"), self.dimension))
        checked.withColumn("vector", normalized(F.col("vector")).cast("array<float>")).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return upsert_latest(self.spark.read.parquet(self.path), "id", "seq")

    def count(self) -> int:
        return self.spark.read.parquet(self.path).select("id").distinct().count()

    def compact(self, target: str) -> VectorStore:
        self.read().drop("first_seq").write.mode("overwrite").parquet(target)
        return VectorStore(self.spark, target, self.dimension)


def streams_of(**streams: DataFrame) -> DataFrame:
    """Candidate streams in the given order as one long table."""
    out = None
    for ord_, (name, df) in enumerate(streams.items()):
        part = df.withColumn("stream", F.lit(name)).withColumn("stream_ord", F.lit(ord_))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON document per line."""
    rows.select(F.to_json(F.struct(*rows.columns))).write.mode("append").text(path)


def write_dead_letters(rows: DataFrame, path: str, max_retries: int = 3) -> DataFrame:
    """Appends the rows whose retries are used up, and returns the others."""
    rows.filter(F.col("retry_count") > max_retries).write.mode("append").parquet(path)
    return rows.filter(F.col("retry_count") <= max_retries)


def mock_embeddings(tasks: DataFrame, dimension: int = 1536, fail_percent: int = 10, batch: str = "id") -> DataFrame:
    """``tasks`` (id, tenant_id, text, retry_count) plus embedding, ok, error; the same on every run.

    An attempt fails, with all the rows that share its ``batch``, by the CRC of
    batch and attempt; components are digits of the text's MD5 and of their place,
    so SQL can say the same. The key travels with its vector, so nothing is
    matched by position.
    """
    roll = F.crc32(F.concat_ws("|", F.col(batch).cast("string"), F.col("retry_count").cast("string")).cast("binary")) % 100
    code = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    part = lambda i: F.conv(F.substring(code, (i - 1) % 29 + 1, F.lit(4)), 16, 10).cast("long") / 32768.0 - 1 + F.floor((i - 1) / 29) / 100.0
    ok = roll >= fail_percent
    vector = F.transform(F.sequence(F.lit(1), F.lit(dimension)), part)
    return tasks.withColumn("ok", ok).withColumn("embedding", F.when(ok, vector)).withColumn("error", F.when(~ok, F.lit("transient")))


#: Fixed value: the relevance of a mock document.
MOCK_RELEVANCE = 0.8


def mock_documents(asked: DataFrame) -> DataFrame:
    """One document per row of (user_query, sub_query): its text and relevance; a fetch for search loops."""
    return asked.select("user_query", "sub_query", F.concat(F.lit("document for "), "sub_query").alias("content"), F.lit(MOCK_RELEVANCE).alias("relevance"))


def with_model(requests: DataFrame, invoke, column: str = "prompt") -> DataFrame:
    """``requests`` plus response, ok, error and latency_ms of ``invoke``, a function from one text to one text.

    A call that fails marks its own row; a null prompt is not sent and fails.
    """
    ship(requests.sparkSession)
    schema = requests.selectExpr("*", "cast(null as string) as response", "true as ok", "cast(null as string) as error", "cast(0 as double) as latency_ms").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for prompt in b[column].tolist():
                began = time.perf_counter()
                try:
                    if prompt is None:
                        raise ValueError("no prompt")
                    got = (invoke(prompt), True, None)
                except Exception as e:  # noqa: BLE001  a provider may fail in any way
                    got = (None, False, str(e))
                out.append((*got, round(1000 * (time.perf_counter() - began), 2)))
            yield b.assign(**{n: [r[k] for r in out] for k, n in enumerate(("response", "ok", "error", "latency_ms"))})

    return requests.mapInPandas(run, schema)


def with_provider(tasks: DataFrame, embed, dimension: int) -> DataFrame:
    """``tasks`` plus the vectors of ``embed``, a function from a list of texts to vectors, called once per Arrow batch.

    A provider that gives fewer vectors than texts is an error, and an error of a
    batch marks the batch's rows instead of ending the query.
    """
    ship(tasks.sparkSession)
    schema = tasks.selectExpr("*", "cast(null as array<double>) as embedding", "true as ok", "cast(null as string) as error").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                vectors = [np.asarray(v, float).tolist() for v in embed(b["text"].tolist())]
                if len(vectors) != len(b) or any(len(v) != dimension for v in vectors):
                    raise ValueError(f"expected {len(b)} vectors of {dimension}")
                yield b.assign(embedding=vectors, ok=True, error=None)
            except Exception as e:  # noqa: BLE001  a provider may fail in any way
                yield b.assign(embedding=None, ok=False, error=str(e))

    return tasks.mapInPandas(run, schema)
