"""Blocks of documents: code numbers of their words or parts, and one small dictionary per block.

Operators that need corpus-wide counts of what a text holds write each text
once as numbers of its block's dictionary. Only dictionaries meet across
blocks, so a very common entry has one row per block there, never one per text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A block closes when the texts in it reach this many bytes, or with its partition.
BLOCK_BYTES = 32 << 20
#: Blocks of one partition, at most (bits).
_BLOCK_BITS = 24


def block_number(slot: int, sequence: int) -> int:
    return slot << _BLOCK_BITS | sequence


def packed(codes: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as byte planes, compressed."""
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(codes).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, dtype=np.uint32)
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum of each values[cuts[i]:cuts[i + 1]], zero for an empty range."""
    out = np.zeros(len(cuts) - 1, dtype=values.dtype)
    full = np.flatnonzero(cuts[:-1] < cuts[1:])
    if len(full):
        out[full] = np.add.reduceat(values, cuts[:-1][full])
    return out
