"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def text_or_empty(col: str | Column = "text") -> Column:
    """Null text counts as empty everywhere in this package."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of text that are handed over at a time (or one longer text): bounds the memory of a Python worker.
CHUNK_ROWS, CHUNK_BYTES = 256, 16 << 20


def chunks(batch: pa.RecordBatch, column: str, rows: int = CHUNK_ROWS, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many rows, and so many bytes in a column of texts, bytes or arrays of numbers."""
    values = batch.column(batch.schema.get_field_index(column))
    nested = pa.types.is_list(values.type) or pa.types.is_large_list(values.type)
    lengths = pc.fill_null(pc.list_value_length(values) if nested else pc.binary_length(values), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)) * (8 if nested else 1)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        n = min(rows, max(1, int(np.searchsorted(ends, before + size, side="right")) - at))
        yield batch.slice(at, n)
        at += n


def map_column(df: DataFrame, column: str, fn: Callable[[list], dict[str, list]], schema: str, keep: list[str]) -> DataFrame:
    """Arrow-batched map: fn gets the values of one column and returns the new columns, a value for each row. The
    columns named in `keep` pass through untouched, nulls and large numbers included."""

    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column):
                new = fn(part.column(part.schema.get_field_index(column)).to_pylist())
                arrays = []
                for f in target:
                    if f.name in keep:
                        arrays.append(part.column(part.schema.get_field_index(f.name)).cast(f.type))
                    else:
                        arrays.append(pa.array(new[f.name], f.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
        pa.default_memory_pool().release_unused()  # an idle worker keeps no buffers

    return df.mapInArrow(run, schema)
