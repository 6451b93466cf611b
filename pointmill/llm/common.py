"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import discard, materialize, scratch_path  # noqa: F401  one place for the operators to take them from

#: Rows of a batch that are worked on at a time: what a function makes of them is handed on before the next ones are read.
SLICE = 512


def release() -> None:
    """Give freed memory back to the system: worker processes live on, and what one stage keeps another one lacks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches, cut into pieces of at most ``rows`` rows. After the last one freed memory goes back to the system."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with a function of one piece of a batch, which returns a batch or yields several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = fn(batch)
            for out in (made,) if isinstance(made, pa.RecordBatch) else made or ():
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, decide: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """Rows of ``df``, all columns untouched, for which ``decide(batch)`` is true. Names of columns cannot clash: none is added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = batch.filter(decide(batch))
            if out.num_rows:
                yield out

    return df.mapInArrow(run, df.schema)


def bytes_of(column: pa.Array) -> list[bytes]:
    """A string or binary column as bytes; null counts as empty."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x if x is not None else b"" for x in column.to_pylist()]


def empty_if_null(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(column: str = "doc_id") -> Column:
    """True for rows whose crc32(id as text) mod 5 is 0: labels of these are never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()
