"""Words of texts as numbers, for the steps that work on arrays inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 8 << 20  # text worked on at once

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SHIFT = np.uint64(29)

_KEPT: dict = {}  # what this worker keeps between tasks


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What an operator's tasks keep in a worker, such as its model: one thing at a time, workers outlive the stages of a pipeline."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what tasks of earlier stages kept in this worker."""
    _KEPT.clear()


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words given as bytes."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ordered pair."""
    with np.errstate(over="ignore"):
        x = (a * _A) ^ (b * _B + _C)
        x ^= x >> _SHIFT
        x *= _B
        x ^= x >> _SHIFT
    return x


def windows(h: np.ndarray, size: int, have: int = 1) -> np.ndarray:
    """Hashes of all windows of ``size`` words from those of windows of ``have`` words, doubling on the way."""
    while have < size:
        step = min(have, size - have)
        h = mix(h[:-step], h[step:]) if len(h) > step else h[:0]
        have += step
    return h


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 64  # bytes of a word that are hashed side by side with other words; longer ones are hashed alone


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of words (other characters than blank and \\t-\\r) of each text, and 64-bit hashes of all words one after another.

    Not the hashes of ``hashes``: eight bytes at a time are mixed in, for all words at once.
    """
    encoded = [t.encode() for t in texts.to_pylist()]
    raw = b" ".join([b"", *encoded, b" " * 8])
    n = len(raw) - 8
    gap = _SPACE[np.frombuffer(raw, np.uint8, n + 1)]
    begins = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    sizes = np.flatnonzero(~gap[:-1] & gap[1:]) + 1 - begins
    until = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in encoded], dtype=np.int64) + 1)
    eight = np.ndarray((n + 1,), "<u8", raw, strides=(1,))  # the eight bytes at every place
    h = mix(sizes.astype(np.uint64), eight[begins] & _MASKS[np.minimum(sizes, 8)])
    for i in np.flatnonzero(sizes > _LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[begins[i] : begins[i] + sizes[i]])
    more = np.flatnonzero((sizes > 8) & (sizes <= _LONG))
    for at in range(8, _LONG, 8):
        h[more] = mix(h[more], eight[begins[more] + at] & _MASKS[np.minimum(sizes[more] - at, 8)])
        more = more[sizes[more] > at + 8]
    return np.diff(until, prepend=0), h


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``most`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)), dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        base = at[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(at, base + most, side="right")))
        yield batch.slice(first, end - first)
        first = end


def lists(parts: list[np.ndarray], dtype) -> pa.ListArray:
    """Arrays of numbers as one column of lists."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.astype(dtype, copy=False)))


def list_parts(column: pa.Array) -> list[np.ndarray]:
    """A column of lists of numbers as arrays; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]
