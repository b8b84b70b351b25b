"""What Python workers hold at a time: small batches on the way to them, slices of
those, and memory that is given back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of a batch on its way to a Python worker, where the session sets none: a batch of
#: ten thousand long texts would be held several times over by the executor and its worker.
BATCH_BYTES = 4 << 20
#: Bytes of text that are worked on at a time.
SLICE_BYTES = 1 << 19


def small_batches(spark: SparkSession | None) -> None:
    """Bound the bytes of a batch for what the session runs from now on, unless it says itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and spark.conf.get(key, None) in (None, str(2**31 - 1)):
        spark.conf.set(key, str(BATCH_BYTES))


def text_slices(column: pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column of about ``most_bytes`` each; a longer text is a range of its own."""
    upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + most_bytes, "right")) - 1)
        yield first, last
        first = last


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, which in the end gives free memory back."""

    def leaned(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # what it frees, give_back can return
        try:
            yield from run(batches)
        finally:
            give_back()

    return leaned


def give_back() -> None:
    """Return unused memory to the system."""
    gc.collect(0)
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return
