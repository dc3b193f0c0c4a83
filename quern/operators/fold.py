"""Ordered folds: one state machine per key, over rows in order.

Rows are partitioned by key and sorted within partitions by key and order, so a
task streams through its keys and holds one state at a time, however many rows a
key has. A key's rows depend on one another, so one key is one task's work; keys
spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.session import ship


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], machine, inputs: list[str], static: dict | None = None) -> DataFrame:
    """``df`` with the machine's outputs; ``inputs`` are the columns that ``step`` takes."""
    static = static or {}
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in machine.outputs)).fields])
    arrow = to_arrow_schema(T.StructType(schema.fields[len(df.columns) :]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for b in batches:
            at = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in {*keys, *inputs}}
            names = zip(*(at[k] for k in keys), strict=True) if keys else iter([()] * b.num_rows)
            out = []
            for key, row in zip(names, zip(*(at[c] for c in inputs), strict=True), strict=True):
                if key != held:
                    held, state = key, machine.start()
                state, got = machine.step(state, *row, **static)
                out.append(got)
            new = [pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *arrow.names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
