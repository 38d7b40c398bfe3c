"""Ordered folds: state machines whose next state depends on the last, one instance per key.

Rows are dealt by the instance and sorted within the partition by the engine, which spills; the fold then runs over
the sorted stream with one state at a time, so an instance of any length needs constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: step(state, row) gives the next state and the rows to emit.
Step = Callable[[dict, dict], tuple[dict, list[dict]]]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Step, schema: str | StructType) -> DataFrame:
    """One pass per instance in the given order; emits what step returns."""
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        instance, state = None, {}
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != instance:
                    instance, state = now, start()
                state, rows = step(state, row)
                out += rows
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
