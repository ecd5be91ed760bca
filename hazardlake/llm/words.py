"""Words, 64-bit word hashes and word windows of many texts at once, as NumPy arrays.

Tasks receive Arrow batches; ``slices`` cuts them into pieces of about a megabyte of text,
so the arrays below stay small however many rows a batch has. A word never crosses a text.
Hashes come from fixed seeds: every worker and every rerun computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20

#: Bytes of words between ASCII white space (U+0020, U+0009 to U+000D).
SPACE_FREE = np.ones(256, bool)
SPACE_FREE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of plain words: digits, ASCII letters and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20

_rng = np.random.default_rng(20240)
_BYTES = _rng.integers(0, 2**64, (2, 256), dtype=U)
_BASE = _rng.integers(0, 2**64, 2, dtype=U) | U(1)
_STEP = _rng.integers(0, 2**64, (2, 64), dtype=U) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of pieces of ``batch``; a null text is empty."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo]: at[hi]], at[lo: hi + 1] - at[lo]
        lo = hi


def bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; ``inside`` tells the bytes of words."""
    mask = inside[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    prev = np.empty_like(mask)
    prev[0], prev[1:] = False, mask[:-1]
    prev[offsets[offsets < len(data)]] = False
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    after[offsets[offsets > 0] - 1] = False
    start = np.flatnonzero(mask & ~prev)
    end = np.flatnonzero(mask & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes after ``fold``."""
    if not len(start):
        return np.zeros(0, U)
    length = end - start
    first = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    power = np.ones(int(length.max()) + 1, U)
    power[1:] = np.multiply.accumulate(np.full(len(power) - 1, _BASE[seed], U))
    byte = _BYTES[seed][fold[data[within + np.repeat(start, length)]]]
    byte *= power[within]
    return mix(np.add.reduceat(byte, first) + length.astype(U))


def windows(word: np.ndarray, doc: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word number of every run of ``k`` words within one text."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(n, U)
    for j in range(k):
        total += word[j: j + n] * _STEP[seed][j % 64]
    keep = np.flatnonzero(doc[:n] == doc[k - 1: k - 1 + n])
    return mix(total[keep] + U(k)), keep


def sequence(word: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash ``windows`` gives for the whole of a short text of at most 64 words."""
    return mix((word * _STEP[seed][: len(word)]).sum(dtype=U, keepdims=True) + U(len(word)))


def counts(doc: np.ndarray, n: int) -> np.ndarray:
    """Words of each of ``n`` texts."""
    return np.bincount(doc, minlength=n).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U, copy=False).view(np.int64)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """A list column whose rows have ``sizes`` values each."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
