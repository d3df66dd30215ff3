"""Words of many texts at once as arrays: hashes, places and lines, without a Python object a word.

Words are runs of anything but white space (``[\\x20\\x09-\\x0D]``), A-Z lowered. All sums are modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0`` to ``base ** (n - 1)``."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(n, 1 << 16).bit_length(), np.uint64(base), np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= 8 * SLICE_BYTES:  # those of one very long text are not kept
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for each range; ranges may overlap."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), dtype=np.uint64, out=total[1:])
    made = total[end] - total[start]
    made *= powers(_INVERSE, len(values) + 1)[start]
    return mix(made)


class Words:
    """The words of some texts laid end to end.

    ``hash``, ``text`` (number of the text), ``start`` and ``end`` (bytes of the texts end to end, one byte between two) and
    ``line`` (numbered through all texts) are by word; ``first`` has the number of each text's first word (and the end), ``at`` its
    first byte, ``first_line`` the number of its first line.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([b"", *texts, b""]).lower(), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.at = np.cumsum(size) - size
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        raw = raw[1:]
        self.hash = range_hashes(_VALUE[raw], self.start, self.end)
        self.first = np.append(np.searchsorted(self.start, self.at), len(self.start))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        breaks = np.flatnonzero(raw == 10)
        self.line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.searchsorted(self.start, breaks), prepend=0, append=len(self.start)))
        self.first_line = np.searchsorted(breaks, self.at)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = powers(_BASE, size + 1)
    made = hashes[:n] * factor[1]
    for k in range(1, size):
        made += hashes[k : k + n] * factor[k + 1]
    return mix(made)


def binaries(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column as bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def by_bytes(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have about ``most`` bytes; a longer text stands alone or ends its slice."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop
