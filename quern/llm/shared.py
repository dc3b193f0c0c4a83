"""Helpers that several training-data operators share.

``stage`` (of the package's session module) cuts lineage by writing a table under
the folder that the cluster names in ``spark.checkpoint.dir``; a lost executor
then costs a re-read, never a recomputation of everything before it. Operators
take any input columns: those they add inside have names that the table lacks
(``free_names``), and those they return must not be there already
(``refuse_clash``). Null values, empty tables and repeated rows pass through the
helpers here unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import ship, stage, staging

__all__ = ["batches_of", "documents", "free_names", "held_out", "let", "only", "refuse_clash", "ship", "slices", "small_batches", "stage", "staging", "texts_of", "training_sample"]

#: Rows of one Arrow batch; texts can be long, so batches are kept small.
BATCH_ROWS = 256


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores added until no column of the table (in any case) has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def refuse_clash(columns: list[str], *outputs: str) -> None:
    """An error if the table has a column that an operator would add."""
    both = {c.lower() for c in columns} & {c.lower() for c in outputs}
    if both:
        raise ValueError(f"the table has columns named as the result's: {sorted(both)}; name others")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Ready the session for Python workers: the package goes with the tasks, and Arrow batches are bounded.

    A smaller bound that the session has stays.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` for what runs inside, for tables of large rows; the session's own bound comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(texts: list[str], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` characters together."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from: crc32 of the id's text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it (also inside its own lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, **types: str) -> DataFrame:
    """Exactly the named columns with these types; other columns never reach an operator."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents that may be learned from: doc_id, text, label.

    The rows are those with the smallest hash of their id, so the sample is the
    same on every run. It is bounded by ``rows``, so its ids may be broadcast; an
    id that documents share gives the least of their texts, and so one row.
    """
    picked = (
        only(labels, doc_id="long", **{label: "int"})
        .filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = only(docs, doc_id="long", text="string").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
