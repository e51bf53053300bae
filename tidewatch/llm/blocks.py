"""Columns that are computed for blocks of rows whose texts have a bounded size together."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm.common import map_batches

BLOCK_BYTES = 4 << 20


def block_ends(column: pa.Array, most: int = BLOCK_BYTES) -> list[int]:
    """Ends of blocks of rows with at most that many bytes of text each; a longer text is a block of its own."""
    out, held = [], 0
    for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
        if held and held + (n or 0) > most:
            out.append(i)
            held = 0
        held += n or 0
    return [*out, len(column)] if len(column) else []


def block_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], most: int = BLOCK_BYTES) -> DataFrame:
    """df with columns after its own, made by make()'s function a block at a time; own columns of these names are replaced."""
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]

    def make_each():
        each = make()

        def run(whole: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            at = 0
            for end in block_ends(whole.column(text), most):
                batch = whole.slice(at, end - at)
                at = end
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *each(batch)], names=[*(f.name for f in kept), *(f.name for f in fields)])

        return run

    return map_batches(df, make_each, T.StructType([*kept, *fields]))


def lists_of(parts: list[bytes]) -> pa.ListArray:
    """An array of lists of 32-bit ints, each given as its little-endian bytes."""
    offsets, n = [0], 0
    for p in parts:
        n += len(p) // 4
        offsets.append(n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), n, [None, pa.py_buffer(b"".join(parts))]))
