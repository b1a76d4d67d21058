"""Ordered folds: rows dealt by key and sorted stream past a state, so that a key of any length needs no more than one row."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

_KINDS = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "date": pa.date32(), "timestamp": pa.timestamp("us", tz="UTC"), "timestamp_ntz": pa.timestamp("us")}


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def fold(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """What step(state, row) -> (state, rows) gives over each key's rows in order; start() makes the state of a new key.

    One shuffle and one sort, which spill; a task holds a state and an Arrow batch. Without rows there is no result.
    """
    fields = [f.split() for f in schema.split(",")]

    def run(batches):
        at, state = object(), None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    at, state = key, start()
                state, made = step(state, row)
                out += made
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, _KINDS[k]) for x, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
