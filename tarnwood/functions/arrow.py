"""Arrow-batched maps for the operators that no built-in expression covers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_columns(df: DataFrame, columns: list[str], schema: T.StructType, work: Callable[[list[list]], list]) -> DataFrame:
    """`work` turns the columns' values of a batch into the result's columns."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work([c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)
