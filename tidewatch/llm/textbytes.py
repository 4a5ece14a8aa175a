"""Vectorised views of many texts at once, for use inside tasks: bytes, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
ROWS_AT_ONCE = 256
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_VALUES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base to the powers 0 to n - 1, and its inverse to the same powers."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the input."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Texts in one buffer, each between two line feeds: text i is ``data[starts[i]:ends[i]]``."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1)
        self.starts = self.ends - lengths
        self.lengths = lengths

    def lowered(self) -> np.ndarray:
        return _LOWER[self.data]

    def words(self, data: np.ndarray | None = None) -> Words:
        return Words(self, self.data if data is None else data)


class Words:
    """Runs of bytes other than ASCII white space: starts, ends, text numbers and 64-bit hashes."""

    def __init__(self, texts: Texts, data: np.ndarray) -> None:
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, texts.starts)  # of each text
        self.count = np.searchsorted(self.starts, texts.ends) - self.first
        self.text = np.repeat(np.arange(len(texts.lengths)), self.count)
        self.data = data

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.data))
        sums = np.cumsum(_VALUES[self.data] * up)
        raw = (sums[self.ends - 1] - sums[self.starts - 1]) * down[self.starts]
        return mixed(raw ^ (self.ends - self.starts).astype(np.uint64))


def chunked(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts) of a binary column in runs of about ``limit`` bytes; null is the empty text."""
    first, run, size = 0, [], 0
    for lo in range(0, len(texts), ROWS_AT_ONCE):
        for i, t in enumerate(texts.slice(lo, ROWS_AT_ONCE).to_pylist(), lo):
            t = t or b""
            if run and size + len(t) > limit:
                yield first, run
                first, run, size = i, [], 0
            run.append(t)
            size += len(t)
    if run:
        yield first, run
