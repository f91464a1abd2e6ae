"""Helpers shared by the text operators.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r, which is how
`bytes.split()` cuts; texts therefore travel to Python as UTF-8 bytes, not as `str`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 4 << 20


def text_bytes(name: str = "text") -> Column:
    """The text column as UTF-8 bytes."""
    return F.col(name).cast("string").cast("binary")


def fold(name: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5, F.lit(0))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` cut so that each part holds about `limit` bytes of `column`, one row at least."""
    start = held = 0
    for i, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        held += size or 0
        if held >= limit:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
                text: str = "text") -> DataFrame:
    """`df` through `work`, a slice of bounded text size at a time."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                made = work(part)
                if made is not None and made.num_rows:
                    yield made

    return df.mapInArrow(run, schema)


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that added columns cannot clash with theirs."""
    return F.struct(*([F.col(f"`{c}`") for c in df.columns] or [F.lit(0).alias("none")]))
