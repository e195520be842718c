"""Words of Arrow string batches as numpy arrays: byte spans, 64-bit hashes, n-gram hashes.

All of it works on the UTF-8 bytes of a bounded slice of rows at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: UTF-8 bytes in one slice, unless a single text has more.
SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def is_not_space() -> np.ndarray:
    """Word bytes of [^\\x20\\x09-\\x0D]+."""
    table = np.ones(256, bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return table


def is_alphanumeric() -> np.ndarray:
    """Word bytes of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z are lower case; bytes of other letters count."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x41:0x5B] = True
    table[0x80:] = True
    return table


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self) -> None:
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, 2 * len(self.power))
            self.power = self._run(int(_BASE), n)
            self.inverse = self._run(pow(int(_BASE), -1, 1 << 64), n)

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out, have, step = np.ones(n, np.uint64), 1, base
        while have < n:  # the second half is the first, times base**have
            more = min(have, n - have)
            np.multiply(out[:more], np.uint64(step), out=out[have : have + more])
            have, step = have + more, step * step % (1 << 64)
        return out


_POWERS = _Powers()


@dataclass
class Words:
    data: np.ndarray  #: lower-cased bytes of all texts
    starts: np.ndarray  #: byte at which each word starts
    ends: np.ndarray
    first: np.ndarray  #: index of each text's first word, and the number of words at the end
    hashes: np.ndarray

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def scan(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: np.ndarray) -> Words:
    """``data``: bytes; ``offsets``: where texts start in it, and its end."""
    data, n = lower[data], len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = word_bytes[data]
    here = inside[1:]
    starts = here & ~inside[:-1]
    ends = ~here & inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a word ends with its text
    starts[cuts] = ends[cuts] = True
    starts, ends = np.flatnonzero(starts[:n] if n else starts[:0]), np.flatnonzero(ends)
    _POWERS.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.power[:n], out=total[1:])
    hashes = (total[ends] - total[starts]) * _POWERS.inverse[starts]
    return Words(data, starts, ends, np.searchsorted(starts, offsets), mixed(hashes + (ends - starts).astype(np.uint64)))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, at each word that has k - 1 after it (texts' ends are up to the caller)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] + np.uint64(k)
    for j in range(1, k):
        out = out * _BASE + hashes[j : j + n]
    return mixed(out)


def grams_at(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The same hashes at some words only, each of which has k - 1 after it."""
    out = hashes[at] + np.uint64(k)
    for j in range(1, k):
        out = out * _BASE + hashes[at + j]
    return mixed(out)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for slices of the batches with about ``limit`` bytes of text; null texts are empty."""
    for batch in batches:
        texts = batch.column(column)
        wide = texts.type == pa.large_string()
        if not wide and texts.type != pa.string():
            texts = texts.cast(pa.string())
        if not len(texts):
            continue
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to
