"""Arrow text columns as flat numpy arrays: words, and hashes of spans, without a loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, sign: int = 1) -> np.ndarray:
    if len(_powers[sign]) < n:
        factors = np.full(max(n, 1 << 20), _BASE if sign == 1 else _INVERSE, np.uint64)
        factors[0] = 1
        _powers[sign] = np.multiply.accumulate(factors)
    return _powers[sign][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes, one row at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def byte_values(data: np.ndarray) -> np.ndarray:
    """What each byte adds to a running sum, before its power; never zero."""
    return data.astype(np.uint64) + np.uint64(1)


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case."""
    return data + ((data - np.uint8(65)) < 26) * np.uint8(32)


def in_words(data: np.ndarray) -> np.ndarray:
    """Which bytes of lower-cased UTF-8 are letters or digits; all beyond ASCII count as letters."""
    return (data >= 128) | ((data - np.uint8(97)) < 26) | ((data - np.uint8(48)) < 10)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums from which `span_hashes` takes the hash of any span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(data) * powers(len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums), -1)[starts])


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, cut at row borders."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Starts and ends take turns.
    turns = np.concatenate(([0] * bool(inside[0]), np.flatnonzero(inside[1:] != inside[:-1]) + 1, [n] * bool(inside[-1]))).astype(np.int64)
    starts, ends = turns[::2], turns[1::2]
    inner = np.unique(offsets[(offsets > 0) & (offsets < n)])
    cut = inner[inside[inner - 1] & inside[inner]]
    if len(cut):
        starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    return starts, ends


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each span lies in; spans are in order."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def sliding(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring hashes, in order."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out = out * np.uint64(_BASE) + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)
