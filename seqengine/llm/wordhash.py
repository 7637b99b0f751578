"""Vectorised word and shingle hashing over Arrow string batches.

The kernels work on the UTF-8 bytes of a whole Arrow batch at once, so the cost
a byte is a few numpy passes, not a Python loop.  Words are maximal runs of
bytes other than space and 0x09-0x0D; A-Z are lower-cased, nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators for words of letters and digits: every other ASCII byte.
PLAIN = np.ones(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SLOTS = _SEED.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}
PIECE = 1 << 20  # bytes of text that the kernels take at a time


def _power_table(base: int, size: int) -> np.ndarray:
    """base**0 .. base**(size-1) modulo 2**64, kept for the next batch."""
    have = _powers.get(base)
    if have is None or len(have) < size:
        have = np.full(max(size, 1 << 16), np.uint64(base))
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:size]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `size` powers of the base and of its inverse."""
    return _power_table(_BASE, size), _power_table(_BASE_INVERSE, size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(column: pa.Array, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between bytes marked in `gap`: hashes, first and past-the-end byte of each, and each row's first word index.

    Bytes are taken a piece of `PIECE` at a time, cut where no word is, so a
    long text needs memory for its words alone.
    """
    raw, rows = text_bytes(column)
    none = np.zeros(0, np.int64)
    parts, at = [(np.zeros(0, np.uint64), none, none)], 0
    while at < len(raw):
        to = _piece_end(raw, rows, gap, at)
        value, begin, end = _piece_words(raw[at:to], rows[np.searchsorted(rows, at) : np.searchsorted(rows, to)] - at, gap)
        parts.append((value, begin + at, end + at))
        at = to
    value, begin, end = parts[1] if len(parts) == 2 else (np.concatenate(x) for x in zip(*parts))
    return value, begin, end, np.searchsorted(begin, rows)


def _piece_end(raw: np.ndarray, rows: np.ndarray, gap: np.ndarray, at: int) -> int:
    """The last place within PIECE bytes, or else the first one behind, that no word crosses."""
    to = at + PIECE
    if to >= len(raw):
        return len(raw)
    row = int(rows[np.searchsorted(rows, to, "right") - 1])
    blank = np.flatnonzero(gap[raw[at:to]])
    best = max(row, at + int(blank[-1]) + 1 if len(blank) else at)
    while best <= at:  # a word longer than a piece
        blank = np.flatnonzero(gap[raw[to : to + PIECE]])
        ends = [len(raw), int(rows[np.searchsorted(rows, to)])] + ([to + int(blank[0]) + 1] if len(blank) else [])
        to += PIECE
        best = min(ends) if min(ends) <= to else at
    return best


def _piece_words(raw: np.ndarray, rows: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    solid = ~gap[raw]
    cut = np.zeros(n + 1, bool)
    cut[rows] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power_table(_BASE, n), out=sums[1:])
    value = (sums[end] - sums[begin]) * _power_table(_BASE_INVERSE, n)[begin]
    return mix(value + (end - begin).astype(np.uint64)), begin, end


def shingles(word: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words; a shorter sequence that isn't empty is one shingle."""
    if not len(word):
        return word
    width = min(size, len(word))
    total = np.zeros(len(word) - width + 1, np.uint64)
    for k in range(width):
        total += word[k : len(word) - width + 1 + k] * _SLOTS[k]
    return mix(total + np.uint64(width))


def batches(stream: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most about `limit` bytes of text, or one row."""
    for batch in stream:
        at = 0
        column = batch.column(batch.schema.get_field_index(text))
        _, rows = text_bytes(column)
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(rows, rows[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
