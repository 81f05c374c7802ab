"""Whole texts as flat byte blocks: word and byte n-gram hashes by numpy, without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that part words: fixed values, [\x20\x09-\x0D].
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
BLOCK_BYTES = 1 << 18

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)  # golden-ratio multiplier
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i < n."""
    size = 1 << max(18, int(n).bit_length())
    if size not in _POWERS:
        r = 0x5851F42D4C957F2D
        inv = pow(r, -1, 1 << 64)
        up = np.full(size, r, dtype=np.uint64)
        down = np.full(size, inv, dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser (MurmurHash3's 64-bit constants: fixed values)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def blocks(payloads: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring payloads of about ``limit`` bytes together; a longer one alone. Yields (first index, payloads)."""
    first, held, size = 0, [], 0
    for i, p in enumerate(payloads):
        if held and size + len(p) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(p)
        size += len(p)
    if held:
        yield first, held


def flat_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of ``data``, which must end with white space."""
    flat = np.frombuffer(data, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _IS_SPACE[flat])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(flat))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)])))
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def word_hashes(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, payload index) of every word, in order."""
    h, starts, _ = flat_words(b" ".join(payloads) + b" ")
    lengths = np.fromiter((len(p) + 1 for p in payloads), np.int64, len(payloads))
    return h, np.searchsorted(np.cumsum(lengths), starts, side="right")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, then free memory goes back to the system: Python workers live as long as their executor."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped
