"""Lempel-Ziv coding of byte streams: 0, n, n literals; 1, length, distance (two bytes).

Chained searches take candidates from one stable sort of the hashes of all positions and compare them eight bytes at a
time for all positions at once, so that only the walk over the tokens is a loop.  The plain greedy search depends on its own
parse and walks the positions outside matches.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np

from blockloom.config import GlobalLz, TileLz

# Fixed values of the format: the hash of three bytes, the shortest match, the most literals or bytes of a token.
HASH_FACTOR, HASH_SHIFT = 0x1E35A7BD, 16
SHORTEST, MOST = 3, 255


class Damaged(ValueError):
    """A stream that can't be decoded."""


def triples(v: np.ndarray) -> np.ndarray:
    return v[:-2].astype(np.uint32) << 16 | v[1:-1].astype(np.uint32) << 8 | v[2:]


def slots_of(v: np.ndarray) -> np.ndarray:
    """The 16-bit hash of the three bytes at each position that has them."""
    return ((triples(v) * np.uint32(HASH_FACTOR)) >> np.uint32(HASH_SHIFT)).astype(np.uint16)


class Matcher:
    """What all searches share: positions in the order of their slots, and words of eight bytes."""

    def __init__(self, data: bytes):
        self.v = np.frombuffer(data, np.uint8)
        self.n = len(data)
        slots = slots_of(self.v)
        self.order = np.argsort(slots, kind="stable").astype(np.int64)
        self.sorted = slots[self.order]
        self.three = triples(self.v)
        self.words = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.v, np.zeros(8, np.uint8)]), 8)[: self.n].copy().view(np.uint64)[:, 0]

    def earlier(self, back: int) -> np.ndarray:
        """For each position with three bytes the ``back``-th last one before it in its slot, or -1."""
        out = np.full(len(self.order), -1, np.int64)
        if back < len(self.order):
            same = self.sorted[back:] == self.sorted[:-back]
            out[self.order[back:][same]] = self.order[:-back][same]
        return out

    def lengths(self, at: np.ndarray, ref: np.ndarray, most: int = MOST) -> np.ndarray:
        """How many bytes from ``at`` on are those from ``ref`` on."""
        limit = np.minimum(most, self.n - at)
        out = np.zeros(len(at), np.int64)
        left = np.arange(len(at))
        while len(left):
            a, b = at[left] + out[left], ref[left] + out[left]
            unequal = self.words[a] ^ self.words[b]
            low = unequal & (~unequal + np.uint64(1))
            step = np.where(unequal == 0, 8, np.log2(np.where(low == 0, 1, low).astype(np.float64)).astype(np.int64) >> 3)
            out[left] += step
            left = left[(unequal == 0) & (out[left] < limit[left])]
        return np.minimum(out, limit)

    def best(self, depth: int, window: int, nice: int = MOST, short_distance: int | None = None, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
        """(length, distance) of each position's longest match among the last ``depth`` positions of its slot, the nearest of equal ones.

        A match of ``nice`` bytes ends the search; matches of three bytes beyond ``short_distance`` don't count.
        """
        length, distance = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        open_ = np.ones(len(self.order), bool)
        for back in range(1, depth + 1):
            ref = self.earlier(back)
            at = np.flatnonzero(open_ & (ref >= 0))
            at = at[at - ref[at] <= window]
            if not len(at):
                break
            open_[:] = False
            open_[at] = True
            at = at[self.three[at] == self.three[ref[at]]]
            got = self.lengths(at, ref[at], most)
            if short_distance is not None:
                got[(got == SHORTEST) & (at - ref[at] > short_distance)] = 0
            more = got > length[at]
            length[at[more]], distance[at[more]] = got[more], (at - ref[at])[more]
            open_[at[got >= nice]] = False
        return length, distance


def literals(out: bytearray, data: bytes, start: int, end: int) -> None:
    for at in range(start, end, MOST):
        part = data[at : min(at + MOST, end)]
        out += bytes((0, len(part))) + part


def written(data: bytes, matches: Iterable[tuple[int, int, int]]) -> bytes:
    """The stream of some matches (place, length, distance) in order, and literals between them."""
    out, pending, pack = bytearray(), 0, struct.Struct("<BBH").pack
    for at, length, distance in matches:
        if at > pending:
            literals(out, data, pending, at)
        out += pack(1, length, distance & 0xFFFF)
        pending = at + length
    literals(out, data, pending, len(data))
    return bytes(out)


def common(data: bytes, ref: int, pos: int, most: int = MOST) -> int:
    """How many bytes from ``pos`` on are those from ``ref`` on."""
    most = min(most, len(data) - pos)
    unequal = int.from_bytes(data[ref : ref + most], "little") ^ int.from_bytes(data[pos : pos + most], "little")
    return (unequal & -unequal).bit_length() - 1 >> 3 if unequal else most


def greedy_parse(data: bytes, window: int) -> Iterator[tuple[int, int, int]]:
    """One probe at each position outside matches, of the last such position of its slot."""
    v = np.frombuffer(data, np.uint8)
    slots, three = slots_of(v).tolist(), triples(v).tolist()
    latest, pos, size = [-1] * (1 << 16), 0, len(slots)
    while pos < size:
        slot = slots[pos]
        ref, latest[slot] = latest[slot], pos
        if ref < 0 or three[ref] != three[pos] or pos - ref > window:
            pos += 1
            continue
        n = common(data, ref, pos)
        yield pos, n, pos - ref
        pos += n


def chosen(length: np.ndarray, distance: np.ndarray, put_off: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The longest match of each position that is reached, but where it is put off for the next one's."""
    good = np.flatnonzero((length >= SHORTEST) & ~put_off)
    places, k, pos, n = good.tolist(), 0, 0, len(good)
    at_or_after = np.searchsorted(good, np.arange(len(length) + 1)).tolist()
    sizes, ways = length.tolist(), distance.tolist()
    while pos < len(sizes) and (k := at_or_after[pos]) < n:
        at = places[k]
        yield at, sizes[at], ways[at]
        pos = at + sizes[at]


def lz_compress(data: bytes, params: TileLz = TileLz()) -> bytes:
    """Greedy by default, with one probe a position; chains of earlier positions and lazy matching by ``params``."""
    if len(data) < SHORTEST:
        return bytes((0, len(data))) + data if data else b""
    if params.chain_depth <= 0 and not params.lazy:
        return written(data, greedy_parse(data, params.window))
    length, distance = Matcher(data).best(max(params.chain_depth, 1), params.window, params.nice_length)
    put_off = np.zeros(len(length), bool)
    if params.lazy:
        put_off[:-1] = length[1:] > length[:-1] + 1
    return written(data, chosen(length, distance, put_off))


def lz_global(data: bytes, params: GlobalLz = GlobalLz(), lazy: bool = False) -> bytes:
    """Chained search over the whole stream; ``lazy`` leaves a match for a longer one at the next position, or one as long and nearer."""
    if len(data) < SHORTEST:
        return bytes((0, len(data))) + data if data else b""
    length, distance = Matcher(data).best(params.chain_depth, params.window, params.nice_length, params.short_match_max_distance, params.max_length)
    put_off = np.zeros(len(length), bool)
    if lazy:
        put_off[:-1] = (length[1:] > length[:-1]) | ((length[1:] == length[:-1]) & (distance[1:] < distance[:-1]))
        put_off[-SHORTEST:] = False
    return written(data, chosen(length, distance, put_off))


def candidates(found: Matcher, params: GlobalLz) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, distances), a row for each position: its longest matches in its chain, the nearer of equal ones first, 0 for none."""
    n, keep = found.n, params.optimal_matches
    length, distance = np.zeros((n, keep), np.int64), np.zeros((n, keep), np.int64)
    open_ = np.ones(len(found.order), bool)
    for back in range(1, params.chain_depth + 1):
        ref = found.earlier(back)
        at = np.flatnonzero(open_ & (ref >= 0))
        at = at[at - ref[at] <= params.window]
        if not len(at):
            break
        open_[:] = False
        open_[at] = True
        at = at[found.three[at] == found.three[ref[at]]]
        got, far = found.lengths(at, ref[at], params.max_length), at - ref[at]
        open_[at[got >= params.nice_length]] = False
        good = (got > SHORTEST) | (far <= params.short_match_max_distance)
        at, got, far = at[good], got[good], far[good]
        for j in range(keep):  # insert into the sorted rows; what is pushed out moves on
            before = (got > length[at, j]) | ((got == length[at, j]) & (far < distance[at, j]))
            i = at[before]
            kept = length[i, j].copy(), distance[i, j].copy()
            length[i, j], distance[i, j] = got[before], far[before]
            got[before], far[before] = kept
    return length, distance


def lz_optimal(data: bytes, params: GlobalLz = GlobalLz()) -> bytes:
    """The parse of the fewest bytes, then tokens, over runs of literals and each position's longest matches.

    A match takes 4 bytes, a run of literals 2 and its own, ``optimal_literals`` of them at most.  At equal cost matches go
    before literals, longer before shorter, nearer before farther.
    """
    n = len(data)
    if n < SHORTEST:
        return bytes((0, n)) + data if data else b""
    length, distance = candidates(Matcher(data), params)
    some = np.flatnonzero(length[:, 0])
    ways = dict(zip(some.tolist(), zip(length[some].tolist(), distance[some].tolist(), strict=True), strict=True))
    step = 1 << 32  # costs: bytes times this, plus tokens
    best, came, how = [0] + [1 << 62] * n, [0] * (n + 1), [0] * (n + 1)
    runs: deque[tuple[int, int]] = deque()  # starts of runs that may still be the best, with cost less place in bytes, ascending
    for p in range(n + 1):
        while runs and runs[0][1] < p - params.optimal_literals:
            runs.popleft()
        if runs:
            cost = runs[0][0] + p * step
            if cost < best[p] or (cost == best[p] and not how[p] and runs[0][1] < came[p]):
                best[p], came[p], how[p] = cost, runs[0][1], 0
        here = best[p] + (2 - p) * step + 1
        while runs and runs[-1][0] > here:
            runs.pop()
        runs.append((here, p))
        if p in ways:
            cost = best[p] + 4 * step + 1
            for size, far in zip(*ways[p], strict=True):
                end = p + size
                if size and (cost < best[end] or (cost == best[end] and (size, -far) > (end - came[end], -how[end]))):
                    best[end], came[end], how[end] = cost, p, far
    found, p = [], n
    while p:
        if how[p]:
            found.append((came[p], p - came[p], how[p]))
        p = came[p]
    return written(data, reversed(found))


def lz_tokens(data: bytes, strict: bool = True) -> Iterator[tuple[int, int, int, bytes]]:
    """(tag, length, distance, literals); a damaged stream ends early, or is an error if ``strict``."""
    pos, size = 0, len(data)
    while pos < size:
        tag = data[pos]
        if tag == 1 and pos + 4 <= size:
            yield 1, data[pos + 1], data[pos + 2] | data[pos + 3] << 8, b""
            pos += 4
        elif tag == 0 and pos + 1 < size and pos + 2 + data[pos + 1] <= size:
            n = data[pos + 1]
            if n:
                yield 0, n, 0, data[pos + 2 : pos + 2 + n]
            pos += 2 + n
        elif strict:
            raise Damaged(f"byte {pos}")
        else:
            return


def lz_expand(tokens: Iterable[tuple[int, int, int, bytes]], strict: bool = True, size: int | None = None) -> bytes:
    out = bytearray()
    for tag, length, distance, plain in tokens:
        if size is not None and len(out) >= size:
            break
        if tag == 0:
            out += plain
            continue
        start = len(out) - distance
        if start < 0 or not distance:
            if strict:
                raise Damaged("distance beyond the start")
            break
        if distance >= length:
            out += out[start : start + length]
        else:  # an overlapping match repeats its own output
            out += (bytes(out[start:]) * (length // distance + 1))[:length]
    if size is not None:
        out = out[:size]
        if strict and len(out) != size:
            raise Damaged("too short")
    return bytes(out)


def lz_decompress(data: bytes, size: int | None = None, strict: bool = True) -> bytes:
    return lz_expand(lz_tokens(data, strict), strict, size)
