"""A Bloom filter of 64-bit keys: built by the tasks that hold the keys, bounded in size, broadcast to those that ask.

A key that was put in always passes; others pass with a chance of about 0.3 %
up to LARGEST / BITS_PER_KEY (33 million) keys, and more often beyond, so a
larger set of keys costs false passes, never a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import schema_of

BITS_PER_KEY = 16
#: Bits of the largest filter (64 MB), and of the pieces in which tasks send theirs (64 KB).
LARGEST, PIECE = 1 << 29, 1 << 19
_PROBES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class BitFilter:
    def __init__(self, bits: int) -> None:
        self.shift = np.uint64(64 - (bits - 1).bit_length()) if bits else None
        self.bytes = np.zeros(bits // 8, np.uint8)

    def add(self, keys: np.ndarray) -> None:
        for odd in _PROBES:
            at = (keys * odd) >> self.shift
            np.bitwise_or.at(self.bytes, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def passing(self, keys: np.ndarray) -> np.ndarray:
        """Where those keys (uint64) stand that may have been put in."""
        left = np.arange(len(keys) if self.shift is not None else 0)
        for odd in _PROBES:
            at = (keys[left] * odd) >> self.shift if len(left) else left.astype(np.uint64)
            set_bits = self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
            left = left[(set_bits & 1).astype(bool)]
        return left


def filter_of(keys: DataFrame) -> BitFilter:
    """The filter of a table of one long column, which is read twice. At most LARGEST bits come to the driver."""
    n = keys.count()
    if not n:
        return BitFilter(0)
    width = min(LARGEST, max(PIECE, 1 << (BITS_PER_KEY * n - 1).bit_length()))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BitFilter(width)
        for batch in batches:
            own.add(batch.column(0).to_numpy().view(np.uint64))
        pieces = own.bytes.reshape(-1, PIECE // 8)
        for k in np.flatnonzero(pieces.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pieces[k].tobytes()], pa.binary())], names=_SENT.names)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits = np.frombuffer(piece, np.uint8)
                found[k] = found[k] | bits if k in found else bits
        for k, bits in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=_SENT.names)

    out = BitFilter(width)
    for row in keys.mapInArrow(put, _SENT).repartition("piece").mapInArrow(unite, _SENT).toLocalIterator():
        out.bytes[row.piece * PIECE // 8 : (row.piece + 1) * PIECE // 8] = np.frombuffer(row.bits, np.uint8)
    return out


_SENT = schema_of(piece="int", bits="binary")
