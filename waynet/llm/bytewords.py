"""Words as runs of bytes of Arrow's UTF-8 buffers, and crc32 of many runs at once, in numpy."""

from __future__ import annotations

import zlib

import numpy as np

#: Bytes with A-Z made a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: The table of crc32 by bytes, from its polynomial.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)

#: Bytes of a run that are advanced for all runs at once; what is longer goes on alone.
STEPS = 64


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of bytes that are inside; none goes from one text to the next."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first, last = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    start[first], end[last] = inside[first], inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, side="right") - 1


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc states after the bytes of their runs, all starts advancing together, a byte a step."""
    order = np.argsort(starts - ends, kind="stable")  # the longest first, so those still going are the first ones
    own, at, lengths = state[order], starts[order], (ends - starts)[order]
    longest = int(lengths[0]) if len(lengths) else 0
    going = np.searchsorted(-lengths, -np.arange(min(longest, STEPS)), side="left")
    for step, n in enumerate(going.tolist()):
        own[:n] = CRC[(own[:n] ^ data[at[:n] + step]) & 255] ^ (own[:n] >> 8)
    for k in range(int(np.searchsorted(-lengths, -STEPS, side="left"))):
        rest = data[at[k] + STEPS : at[k] + lengths[k]].tobytes()
        own[k] = zlib.crc32(rest, int(own[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(own)
    out[order] = own
    return out


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ~advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, ends)
