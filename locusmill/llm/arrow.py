"""Small helpers for Arrow-batched map functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], sized: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``most`` bytes of column ``sized``, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(sized))
        if batch.num_rows == 0 or column.nbytes <= most:
            if batch.num_rows:
                yield batch
            continue
        start, held = 0, 0
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_slices(
    df: DataFrame, fn: Callable[[pa.RecordBatch], list], added: StructType, sized: str, keep: list[str]
) -> DataFrame:
    """``df``'s columns ``keep`` beside those that ``fn`` returns for each slice of rows, as lists or Arrow arrays."""
    schema = StructType([df.schema[c] for c in keep] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for part in slices(batches, sized):
            made = fn(part)
            columns = [part.column(part.schema.get_field_index(c)) for c in keep]
            columns += [
                x.cast(f.type) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type)
                for x, f in zip(made, list(target)[len(keep):])
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.mapInArrow(run, schema)


def texts(part: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    column = part.column(part.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
