"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from platwork.session import stored  # noqa: F401

# Upper-case ASCII letters to lower case, every other byte as it is.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# The characters that separate words, \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut so that ``column`` holds about ``most_bytes`` at once (a row stays whole)."""
    start = held = 0
    lengths = pa.compute.binary_length(batch.column(column).cast(pa.binary())).to_pylist()
    for i, n in enumerate(lengths):
        if held and held + (n or 0) > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Return memory that a finished task has freed to the system: Python workers live on between
    tasks, and what they keep adds up with the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
