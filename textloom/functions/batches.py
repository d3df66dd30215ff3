"""Python over a column, a slice of each Arrow batch at a time: what a worker holds as Python objects doesn't grow with the batch."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of values that are looked at together.
SLICE_BYTES = 1 << 19


def lean() -> None:
    """Gives back what earlier tasks left in this worker: it is used again, and its allocators keep freed memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def _ends(values: pa.Array) -> np.ndarray:
    """Offsets of strings or lists within what lies under them, without a copy; as many as there are values, and one."""
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) or pa.types.is_large_list(values.type)
    raw = np.frombuffer(values.buffers()[1] or b"", np.int64 if wide else np.int32)
    return raw[values.offset : values.offset + len(values) + 1]


def slices(values: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``most`` bytes; a longer value stands alone. Strings, bytes, or lists of these or of numbers."""
    if not len(values):
        return
    ends = _ends(values)
    size = (ends - ends[0]).astype(np.int64)
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        size *= 32  # an element as a Python object
        kind = values.type.value_type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            inner = _ends(values.values)[ends] if len(values.values) else np.zeros(len(ends), np.int64)
            size += inner - inner[0]
    size += 64 * np.arange(len(size))
    at = 0
    while at < len(values):
        stop = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield values.slice(at, stop - at)
        at = stop


def sliced(kind: T.DataType, start: Callable[[], Callable[[pa.Array], list | pa.Array]]):
    """A column function. ``start`` is called once a task; what it returns turns a slice into its results."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        make = start()
        for batch in batches:
            for part in slices(batch):
                made = make(part)
                yield made if isinstance(made, pa.Array) else pa.array(made, arrow)
            del batch
        del make
        lean()  # the worker waits for its next task without what this one took

    return run


def by_value(kind: T.DataType, f: Callable):
    """A column function from ``f`` on each value; null stays null."""
    return sliced(kind, lambda: lambda part: [None if v is None else f(v) for v in part.to_pylist()])
