"""Elias-Fano lists: ascending numbers in about 2 + log2(greatest / count) bits each, any of
which is found without decoding the rest."""

from __future__ import annotations

import struct

import numpy as np

HEADER = struct.Struct("<QQB")
#: Bytes of the upper bits for each entry of the rank directory.
STEP = 64


def encode(values: np.ndarray) -> bytes:
    """Ascending numbers, repeats allowed, as bytes: count, greatest and width of the lower
    bits; the lower bits; the rank before each step of the upper bits; the upper bits."""
    n = len(values)
    if not n:
        return HEADER.pack(0, 0, 0)
    values = np.asarray(values, np.int64)
    greatest = int(values[-1])
    width = max(0, (greatest // n).bit_length() - 1)
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    upper = np.zeros(-(-(n + (greatest >> width) + 1) // (8 * STEP)) * 8 * STEP, np.uint8)
    upper[(values >> width) + np.arange(n)] = 1
    ranks = np.concatenate([[0], np.cumsum(upper.reshape(-1, 8 * STEP).sum(1, dtype=np.int64))[:-1]])
    parts = np.packbits(low.ravel(), bitorder="little"), ranks.astype("<u4"), np.packbits(upper, bitorder="little")
    return HEADER.pack(n, greatest, width) + b"".join(p.tobytes() for p in parts)


def count(data: bytes) -> int:
    return HEADER.unpack_from(data)[0]


def select(data: bytes, i: int) -> int:
    """The i-th number, from 0: its step by the directory, its place there, its lower bits."""
    n, greatest, width = HEADER.unpack_from(data)
    if not 0 <= i < n:
        raise IndexError(i)
    steps = -(-(n + (greatest >> width) + 1) // (8 * STEP))
    at = HEADER.size + -(-n * width // 8)
    ranks = np.frombuffer(data, "<u4", steps, at)
    step = int(np.searchsorted(ranks, i, "right")) - 1
    bits = np.unpackbits(np.frombuffer(data, np.uint8, STEP, at + 4 * steps + STEP * step), bitorder="little")
    place = 8 * STEP * step + int(np.flatnonzero(bits)[i - int(ranks[step])])
    first, last = i * width, (i + 1) * width
    held = int.from_bytes(data[HEADER.size + first // 8 : HEADER.size + -(-last // 8)], "little")
    return (place - i) << width | (held >> first % 8) & ((1 << width) - 1)
