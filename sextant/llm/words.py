"""Spans and 64-bit hashes of words over the bytes of many texts at once.

All arithmetic is modulo 2**64 on numpy arrays; nothing here makes a Python object per word.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BASE = np.uint64(0x9E3779B97F4A7C15)
LONG = 4096


@functools.cache
def _powers(base: int) -> np.ndarray:
    out = np.full(LONG, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after another, and the n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09 to 0x0D; a text's edge ends a run."""
    ink = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], ink[:-1])) & ~edge[:-1] if len(data) else ink
    after = np.concatenate((ink[1:], [False])) & ~edge[1:] if len(data) else ink
    return np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit polynomial hash of every span, mixed with its length."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    lengths, powers, out = ends - starts, _powers(base), np.empty(n, np.uint64)
    step, total = 1 << 19, np.cumsum(lengths)
    at = 0
    while at < n:  # about half a million bytes at once
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step)))
        ls, first = lengths[at:to], np.concatenate(([0], np.cumsum(lengths[at:to])[:-1]))
        place = np.arange(int(ls.sum())) - np.repeat(first, ls)
        weight = powers[place & (LONG - 1)]
        if ls.max() > LONG:
            weight = weight * _powers(int(_MIX[0]))[(place >> 12) & (LONG - 1)]
        value = (data[place + np.repeat(starts[at:to], ls)].astype(np.uint64) + np.uint64(1)) * weight
        out[at:to] = np.add.reduceat(value, first)
        at = to
    return mix(out ^ (lengths.astype(np.uint64) * BASE))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, by doubling; len(h) - n + 1 of them (none if fewer words)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, width, out, done = h, 1, None, 0
    while n:
        if n & 1:
            part = power[done:]
            out = part if out is None else mix(out[: len(part)] * BASE + part[: len(out)])
            done += width
        n >>= 1
        if n:
            power, width = mix(power[:-width] * BASE + power[width:]), width * 2
    return out
