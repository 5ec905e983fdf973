"""Arrow batches of texts as lists of bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS_AT_ONCE = 1024


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches cut to so many rows, so that what a task holds in Python stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def strings_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def map_rows(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, object]], schema: str, rows: int = ROWS_AT_ONCE) -> DataFrame:
    """df through mapInArrow, where make turns a batch into columns of the schema, by name."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows):
            made = make(batch)
            arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in (made[n] for n in names)]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, names)

    return df.mapInArrow(run, schema)
