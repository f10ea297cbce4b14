"""Schemas of what Arrow functions return."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.types import StructField, StructType

#: Rows of frames or slices that Arrow functions take from a batch at a time, and their bytes, which one row alone may exceed.
ROWS, BYTES = 256, 4 << 20


def plus(schema: StructType, ddl: str, without: tuple[str, ...] = ()) -> StructType:
    """A new schema: the fields of one, but for some, and then those of a DDL string."""
    return StructType([StructField(f.name, f.dataType, True) for f in schema if f.name not in without] + StructType.fromDDL(ddl).fields)


def few(batches: Iterable[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of some rows and bytes, so that what is made of them as Python objects stays small."""
    for batch in batches:
        k = 0
        while k < batch.num_rows:
            part = batch.slice(k, rows)
            while part.num_rows > 1 and part.nbytes > size:
                part = part.slice(0, part.num_rows // 2)
            yield part
            k += part.num_rows
