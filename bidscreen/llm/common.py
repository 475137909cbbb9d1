"""What the operators share: tables written to the shared folder, and bounded pieces of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

from bidscreen.sources.shared import written as materialize  # noqa: F401  what operators write tables with

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc_of_id(doc_id: Column | str) -> Column:
    """crc32 of an id as text; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


_libc = ctypes.CDLL(None)


def release() -> None:
    """Give the system back what the allocators hold and nobody uses: a Python worker lives on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most max_bytes of text each, or one row where a row is longer. Free memory is
    given back at the end."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        begin, size = 0, 0
        for row, n in enumerate(pa.compute.binary_length(text).to_pylist()):
            if size and size + (n or 0) > max_bytes:
                yield batch.slice(begin, row - begin)
                begin, size = row, 0
            size += (n or 0) + 16
        if begin < batch.num_rows:
            yield batch.slice(begin)
    release()


U = np.uint64
_step = U(0x9E3779B97F4A7C13)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer: all bits depend on all bits."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A number for each byte: sums of these times powers of the step are hashes of runs of bytes.
byte_values = mix(np.arange(256, dtype=U), 7)


class Powers:
    """Powers of the odd step and of its inverse modulo 2**64, as far as any text has needed them."""

    def __init__(self):
        self.step = _step
        self.up = self.down = np.ones(1, U)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            back = U(pow(int(_step), -1, 2**64))
            self.up = np.cumprod(np.r_[U(1), np.full(n - 1, _step, U)])
            self.down = np.cumprod(np.r_[U(1), np.full(n - 1, back, U)])


powers = Powers()
