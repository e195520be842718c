"""Range coding of many streams at once: step by step, one step for all lanes of all streams.

The bytes are those of ``codecs.rans_encode``; streams have frequencies of their own, which are gathered by stream.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from blockloom.operators.joined import batches as in_batches, begins, ragged
from blockloom.operators.lz import Damaged

TOTAL_BITS, LOWER, LANES = 12, 1 << 16, 8
TOTAL = 1 << TOTAL_BITS
#: Symbols that are coded at once, unless a single stream has more.
BATCH = 1 << 20
#: So few sequences are coded one by one.
FEW = 32


def models(counts: np.ndarray) -> np.ndarray:
    """Rows of counts to rows of frequencies that add up to 4096, each at least 1; the rule of ``codecs.model``."""
    whole = counts.sum(axis=1, keepdims=True)
    freq = np.maximum(1, (counts * TOTAL + whole // 2) // np.maximum(whole, 1))
    over = freq.sum(axis=1) - TOTAL
    while (over > 0).any():  # one from each symbol that can spare it, in symbol order
        spare = (freq > 1) & (over > 0)[:, None]
        spare &= np.cumsum(spare, axis=1) <= np.maximum(over, 0)[:, None]
        freq -= spare
        over -= spare.sum(axis=1)
    lacks = np.flatnonzero(over < 0)
    freq[lacks, freq[lacks].argmax(axis=1)] -= over[lacks]
    return freq


def batches(sizes: list[int]) -> list[range]:
    return in_batches(sizes, BATCH)


def by_length(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sequences from the longest to the shortest, how many of them still have symbols at each step, where each step starts
    if they lie one after another, and the first step that is left with few."""
    order = np.argsort(-steps, kind="stable")
    most = int(steps[order[0]]) if len(steps) else 0
    active = np.searchsorted(-steps[order], -np.arange(1, most + 1), "right")
    return order, active, begins(active), int(np.searchsorted(-active, -FEW, "right"))


def packed(freqs: np.ndarray) -> np.ndarray:
    """Frequencies and what is below them in one number each."""
    f = freqs.astype(np.int64)
    return (f << 16 | np.cumsum(f, axis=1) - f).astype(np.uint32)


def rows_of(freqs: np.ndarray, streams: int) -> np.ndarray:
    """The row of frequencies of each stream: its own, one for as many streams in a row, or the only one."""
    return np.arange(streams) // max(1, streams // max(1, len(freqs)))


def encode_many(streams: list[np.ndarray], freqs: np.ndarray, lanes: int = LANES) -> list[bytes]:
    """The coded bytes of each stream of symbols under its row of frequencies (see rows_of()).

    Each lane of each stream is a sequence of its own; symbols are laid out step by step.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    steps = np.maximum(0, sizes[:, None] + lanes - 1 - np.arange(lanes)).ravel() // lanes
    order, active, begin, few = by_length(steps)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    within = ragged(sizes)
    owner = np.repeat(np.arange(len(streams)), sizes)
    place = begin[within // lanes] + rank[owner * lanes + within % lanes]
    symbol = np.concatenate([*streams, np.zeros(0, np.uint8)])
    del within
    entry = packed(freqs).ravel()[symbol + rows_of(freqs, len(streams))[owner] * freqs.shape[1]]
    del owner, symbol
    table = np.empty(len(place), np.uint32)
    table[place] = entry
    del entry
    size, low = table >> 16, table & 0xFFFF
    limit = size << TOTAL_BITS
    held = np.empty(len(place), np.uint32)  # the states before each symbol
    state = np.full(len(order), LOWER, np.uint32)
    for r in range(int(active[few]) if few < len(active) else 0):
        state[r] = encode_rest(begin[few : int(steps[order[r]])] + r, size, low, held)
    eight, twelve = np.uint32(8), np.uint32(TOTAL_BITS)
    for t in range(min(few, len(active)) - 1, -1, -1):
        n, here = int(active[t]), slice(int(begin[t]), int(begin[t + 1]))
        x, f, most = state[:n], size[here], limit[here]
        held[here] = x
        y = x >> eight
        z = x >> (((x >= most).view(np.uint8) + (y >= most).view(np.uint8)) << 3)
        whole = z // f
        z -= whole * f
        z += low[here]
        whole <<= twelve
        np.add(z, whole, out=x)
    count = (held >= limit).view(np.uint8) + (held >> 8 >= limit).view(np.uint8)
    held, count = held[place], count[place]
    # in the stream symbols go forwards, and the bytes of each backwards
    kept = np.stack([count == 2, count >= 1], axis=1)
    body = np.stack([held >> 8 & 255, held & 255], axis=1).astype(np.uint8)[kept]
    ends = begins(count)[begins(sizes)].tolist()
    heads = state[rank].astype(">u4").reshape(-1, lanes)
    return [heads[k].tobytes() + body[ends[k] : ends[k + 1]].tobytes() for k in range(len(streams))]


def encode_rest(place: np.ndarray, size: np.ndarray, low: np.ndarray, held: np.ndarray) -> int:
    """Codes the end of one sequence, last symbol first; its states are kept in ``held``."""
    x, seen = LOWER, []
    for f, below in zip(size[place[::-1]].tolist(), low[place[::-1]].tolist(), strict=True):
        seen.append(x)
        while x >= f << TOTAL_BITS:
            x >>= 8
        x = (x // f << TOTAL_BITS) + x % f + below
    held[place[::-1]] = seen
    return x


@dataclass
class Coded:
    """Coded streams end to end, and where to go on in them: a row of states and a place for each."""

    raw: np.ndarray
    end: np.ndarray
    pos: np.ndarray
    state: np.ndarray

    @classmethod
    def of(cls, streams: list[bytes], lanes: int = LANES) -> Coded:
        have = np.array([len(x) for x in streams], np.int64)
        start = begins(have)
        raw = np.concatenate([np.frombuffer(b"".join(streams), np.uint8), np.zeros(4 * lanes + 2, np.uint8)])
        head = start[:-1, None] + 4 * np.arange(lanes)
        head[have < 4 * lanes] = 0
        state = sum(raw[head + k].astype(np.int64) << 24 - 8 * k for k in range(4))
        return cls(raw, start[1:], start[:-1] + 4 * lanes, state)


def decode_many(streams: list[bytes], sizes: np.ndarray, freqs: np.ndarray, lanes: int = LANES) -> list[np.ndarray | None]:
    """The symbols of each coded stream under its row of frequencies (see rows_of()); None for one that is cut off."""
    return decode_from(Coded.of(streams, lanes), np.asarray(sizes, np.int64), freqs, rows_of(freqs, len(streams)))[0]


def decode_from(coded: Coded, sizes: np.ndarray, freqs: np.ndarray, model: np.ndarray, every: int = 0) -> tuple[list[np.ndarray | None], list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """(symbols or None of each stream, [(streams, symbols before, places, states)] at each step that ``every`` divides)."""
    lanes = coded.state.shape[1]
    order, active, begin, few = by_length(-(-sizes // lanes) if lanes > 1 else sizes)
    few = int(np.searchsorted(-active, -max(1, FEW // lanes), "right"))
    pairs = coded.raw[:-1].astype(np.uint16) << 8 | coded.raw[1:]
    last = len(pairs) - 1
    width = freqs.shape[1]
    table = np.repeat(np.tile(np.arange(width, dtype=np.uint8 if width <= 256 else np.int64), len(freqs)), freqs.ravel())
    entries = packed(freqs).ravel()
    state, pos, end, row = coded.state[order], coded.pos[order], coded.end[order], model[order]
    slots, base = (row * TOTAL)[:, None], (row * width)[:, None]
    left = (sizes[order] - 1) % lanes  # the last lane with a symbol in the last step
    out = np.empty(int(begin[-1]) * lanes, table.dtype)
    points = []
    over = pos > end
    for t in range(min(few, len(active))):
        n, stay = int(active[t]), int(active[t + 1]) if t + 1 < len(active) else 0
        x, at = state[:n], pos[:n]
        if every and t % every == 0:
            points.append((order[:n], np.full(n, t * lanes), at.copy(), x.copy()))
        slot = x & TOTAL - 1
        symbol = table[slots[:n] + slot]
        out[int(begin[t]) * lanes : int(begin[t + 1]) * lanes] = symbol.ravel()
        entry = entries[base[:n] + symbol].astype(np.int64)
        x = (entry >> 16) * (x >> TOTAL_BITS)
        x += slot
        x -= entry & 0xFFFF
        need = (x < LOWER).view(np.uint8) + (x < 256).view(np.uint8)
        ends = np.cumsum(need, axis=1, dtype=np.int64)
        ends += at[:, None]
        if stay < n:  # lanes without a symbol come last, so what they read tells nothing
            gone = np.arange(stay, n)
            over[gone] |= ends[gone, left[gone]] > end[gone]
        place = ends - need
        np.minimum(place, last, out=place)
        need <<= 3
        pos[:n] = ends[:, -1]
        x <<= need
        x |= pairs[place] >> (16 - need)
        state[:n] = x
    for r in range(int(active[few]) if few < len(active) else 0):
        over[r] = pos[r] > end[r] or decode_rest(r, few, int(sizes[order[r]]), coded, state[r].tolist(), int(pos[r]), int(end[r]), table[int(row[r]) * TOTAL :][:TOTAL], entries[int(row[r]) * width :][:width], begin, out, every, points, order)
    got: list[np.ndarray | None] = [None] * len(sizes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    within = ragged(sizes)
    flat = out[(begin[within // lanes] + np.repeat(rank, sizes)) * lanes + within % lanes]
    at = begins(sizes).tolist()
    for k, bad in zip(order.tolist(), over.tolist(), strict=True):
        got[k] = None if bad else flat[at[k] : at[k + 1]]
    return got, points


def decode_rest(r: int, step: int, count: int, coded: Coded, states: list[int], pos: int, end: int, table: np.ndarray, entries: np.ndarray, begin: np.ndarray, out: np.ndarray, every: int, points: list, order: np.ndarray) -> bool:
    """Decodes the end of one stream from a step on; whether it is cut off."""
    lanes, found = len(states), []
    symbols, entry = table.tolist(), entries.tolist()
    data = memoryview(coded.raw)
    for k in range(step * lanes, count):
        lane = k % lanes
        if every and not lane and k // lanes % every == 0:
            points.append((order[r : r + 1], np.array([k]), np.array([pos]), np.array([states])))
        x = states[lane]
        slot = x & TOTAL - 1
        s = symbols[slot]
        found.append(s)
        x = (entry[s] >> 16) * (x >> TOTAL_BITS) + slot - (entry[s] & 0xFFFF)
        while x < LOWER:
            if pos >= end:
                return True
            x = x << 8 | data[pos]
            pos += 1
        states[lane] = x
    k = np.arange(step * lanes, count)
    out[(begin[k // lanes] + r) * lanes + k % lanes] = found
    return False


def restart_many(streams: list[bytes], sizes: np.ndarray, freqs: np.ndarray, interval: int) -> tuple[Coded, np.ndarray, np.ndarray]:
    """Where decoders could start every ``interval`` symbols (a multiple of the lanes): places and states, and the stream and
    the number of symbols before of each; in order."""
    coded = Coded.of(streams)
    _, points = decode_from(coded, sizes, freqs, rows_of(freqs, len(streams)), interval // LANES)
    if not points:
        return Coded(coded.raw, *np.zeros((2, 0), np.int64), np.zeros((0, LANES), np.int64)), *np.zeros((2, 0), np.int64)
    stream, before, pos, state = (np.concatenate(x) for x in zip(*points, strict=True))
    order = np.lexsort((before, stream))
    stream, before = stream[order], before[order]
    return Coded(coded.raw, coded.end[stream], pos[order], state[order]), stream, before


def checked(symbols: np.ndarray | None) -> np.ndarray:
    if symbols is None:
        raise Damaged("bytes are cut off")
    return symbols
