"""Lempel-Ziv coding of many streams at once, end to end in one array.

The bytes are those of ``lz``.  What depends on its own parse goes step by step, one step for all streams; where few
streams are left, one by one.  All else is array work over the bytes of all streams.
"""

from __future__ import annotations

from collections import deque

import numpy as np

from blockloom.config import GlobalLz, TileLz
from blockloom.operators.lz import HASH_FACTOR, HASH_SHIFT, MOST, SHORTEST, common, lz_optimal, triples

#: Bytes that are worked on at once, unless a single stream has more.
BATCH = 1 << 21
#: Pairs of positions that the parse of the fewest bytes looks at for the streams of one go.
PARSED = 12 << 20
#: So few streams are walked, or parsed, one by one.
FEW = 48
FEW_PARSED = 16
#: The bits of a word's first bytes.
THREE = np.uint64(0xFFFFFF)
FOUR = np.uint64(0xFFFFFFFF)


def batches(sizes: list[int], most: int | None = None) -> list[range]:
    """Streams in order, as many at once as make up ``most`` bytes."""
    most = BATCH if most is None else most
    out, start, held = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + n > most:
            out.append(range(start, k))
            start, held = k, 0
        held += n
    return [*out, range(start, len(sizes))] if sizes else []


def begins(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def ragged(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. below each size, end to end."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def cut(flat: np.ndarray, begin: np.ndarray) -> list[bytes]:
    whole, at = flat.tobytes(), begin.tolist()
    return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


class Joined:
    """Streams end to end; the positions that have three bytes in the order of their slots, those of a stream together."""

    def __init__(self, streams: list[bytes]):
        whole = b"".join(streams)
        self.whole, self.n = whole, len(whole)
        self.sizes = np.array([len(x) for x in streams], np.int64)
        self.begin = begins(self.sizes)
        self.v = np.frombuffer(whole, np.uint8)
        if self.n < SHORTEST:
            self.order, self.new = np.zeros(0, np.int32), np.zeros(0, bool)
            return
        three = triples(self.v)
        slots = ((three * np.uint32(HASH_FACTOR)) >> np.uint32(HASH_SHIFT)).astype(np.uint16)
        usable = np.ones(self.n, bool)
        for back in (1, 2):
            last = self.begin[1:] - back
            usable[last[last >= 0]] = False
        usable = usable[:-2]
        order = np.argsort(slots, kind="stable")
        owner = np.repeat(np.arange(len(streams), dtype=np.uint32), self.sizes)[:-2]
        wide = np.uint32 if len(streams) < 1 << 16 else np.uint64
        both = (slots.astype(wide) << wide(16 if wide is np.uint32 else 32) | owner)[order]
        keep = usable[order]
        self.order, both = order[keep].astype(np.int32), both[keep]
        self.new = np.ones(len(both), bool)
        self.new[1:] = both[1:] != both[:-1]
        padded = np.concatenate([self.v, np.zeros(8, np.uint8)])
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: self.n].copy().view(np.uint64)[:, 0]

    def longer(self, at: np.ndarray, ref: np.ndarray, got: np.ndarray, limit: np.ndarray) -> None:
        """Carries on where ``got`` is 8: how many bytes from ``at`` on are those from ``ref`` on, ``limit`` of them at most."""
        left = np.flatnonzero((got == 8) & (limit > 8))
        while len(left):
            step = equal_bytes(self.words[at[left] + got[left]] ^ self.words[ref[left] + got[left]])
            got[left] += step
            left = left[step == 8]
            left = left[got[left] < limit[left]]
        np.minimum(got, limit, out=got)


def equal_bytes(unequal: np.ndarray) -> np.ndarray:
    """The number of zero bytes at the low end of each word."""
    low = unequal & (~unequal + np.uint64(1))
    place = (low.astype(np.float64).view(np.int64) >> 52) - 1023 >> 3
    place[unequal == 0] = 8
    return place


def greedy(data: Joined, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, source) at each position where the plain greedy parse has a match, else length 0.

    The latest position of a slot starts as its first one, for that is reached before any other, unless a match goes over
    it, which only its last two bytes can.  So only positions whose slot has occurred are visited.
    """
    length, source = np.zeros(data.n, np.uint8), np.zeros(data.n, np.int32)
    if not len(data.order):
        return length, source
    group = np.zeros(data.n, np.int32)
    group[data.order] = np.cumsum(data.new, dtype=np.int32) - 1
    latest = data.order[data.new]
    again = np.zeros(data.n, bool)
    again[data.order[~data.new]] = True
    after = np.where(again, np.arange(data.n, dtype=np.int32), np.int32(data.n))
    after = np.append(np.minimum.accumulate(after[::-1])[::-1], np.int32(data.n))
    words, wide = data.words, int(data.sizes.max()) > window
    lost = np.zeros(data.n, bool)  # what matches go over, of it the first positions of their slots
    pos, end = data.begin[:-1], data.begin[1:]
    while len(pos) > FEW:
        q = after[pos]
        on = q < end
        if not on.all():
            q, end = q[on], end[on]
        slot = group[q]
        ref = latest[slot]
        latest[slot] = q
        pos = q + np.int64(1)
        unequal = words[q] ^ words[ref]
        hit = ((unequal & THREE) == 0) & ~lost[ref]
        if wide:
            hit &= q - ref <= window
        hit = np.flatnonzero(hit)
        if len(hit):
            at, ref, n = q[hit], ref[hit], equal_bytes(unequal[hit])
            data.longer(at, ref, n, np.minimum(MOST, end[hit] - at))
            length[at], source[at] = n, ref
            pos[hit] = at = at + n
            lost[at - 1] = True
            lost[at - 2] = True
    views = [memoryview(x) for x in (after, group, latest, words, lost, length, source)]
    for p, e in zip(pos.tolist(), end.tolist(), strict=True):
        walk(data.whole, p, e, window, *views)
    return length, source


def walk(whole: bytes, pos: int, end: int, window: int, after, group, latest, words, lost, length, source) -> None:
    """The rest of greedy() for one stream."""
    while (q := after[pos]) < end:
        slot = group[q]
        ref = latest[slot]
        latest[slot] = q
        pos = q + 1
        unequal = words[q] ^ words[ref]
        if unequal & 0xFFFFFF or lost[ref] or q - ref > window:
            continue
        n = min((unequal & -unequal).bit_length() - 1 >> 3, end - q) if unequal else common(whole, ref, q, min(MOST, end - q))
        length[q], source[q] = n, ref
        pos = q + n
        lost[pos - 1] = lost[pos - 2] = True


def written(data: Joined, at: np.ndarray, length: np.ndarray, distance: np.ndarray) -> list[bytes]:
    """The streams of some matches (place, length, distance), ascending, and literals between them."""
    if not data.n:
        return [b""] * len(data.sizes)
    length = length.astype(np.int64)
    edge = np.zeros(data.n + 1, np.int8)
    edge[at] += 1
    edge[at + length] -= 1
    plain = np.cumsum(edge[:-1], dtype=np.int8) == 0
    first = np.zeros(data.n + 1, bool)
    first[data.begin] = True
    starts = plain & first[:-1]
    starts[1:] |= plain[1:] & ~plain[:-1]
    starts = np.flatnonzero(starts)
    ends = plain & first[1:]
    ends[:-1] |= plain[:-1] & ~plain[1:]
    ends[-1] |= plain[-1]
    runs = np.flatnonzero(ends) + 1 - starts
    pieces = -(-runs // MOST)
    skipped = ragged(pieces) * MOST
    heads = np.repeat(starts, pieces) + skipped
    counts = np.minimum(MOST, np.repeat(runs, pieces) - skipped)
    cost = plain.astype(np.int64)
    cost[heads] = 3
    cost[at] = 4
    place = begins(cost)
    out = np.zeros(int(place[-1]), np.uint8)
    out[place[heads] + 1] = counts
    there = place[at]
    out[there], out[there + 1], out[there + 2], out[there + 3] = 1, length, distance & 255, distance >> 8 & 255
    body = place[:-1].copy()
    body[heads] += 2
    out[body[plain]] = data.v[plain]
    return cut(out, place[data.begin])


def lz_compress_many(streams: list[bytes], params: TileLz = TileLz()) -> list[bytes]:
    """lz_compress() of each stream in the plain greedy form."""
    out: list[bytes] = []
    for part in batches([len(x) for x in streams]):
        data = Joined([streams[k] for k in part])
        length, source = greedy(data, params.window)
        at = np.flatnonzero(length)
        out += written(data, at, length[at], at - source[at])
    return out


# ---- the parse of the fewest bytes

#: A cost: bytes, tokens, and in its low bits 0xFFFFFF less the match that leads there (length << 16 | 0xFFFF - distance), or less 0 for literals.
BYTES, TOKEN, PLAIN = 1 << 43, 1 << 24, 0xFFFFFF
NEVER = 1 << 62
#: Streams from this size on are parsed one by one, for their costs take more bits.
LONG = 1 << 18
#: Positions that are searched at once, so that what is held of them stays in the cache.
CHUNK = 1 << 15


def pairs(data: Joined, depth: int) -> np.ndarray:
    """How many positions of chains are looked at in each stream, at most."""
    rank = np.arange(len(data.order), dtype=np.int32)
    rank -= np.maximum.accumulate(np.where(data.new, rank, 0))
    held = np.zeros(data.n + 1, np.int64)
    held[data.order] = np.minimum(rank, depth)
    return np.diff(begins(held[:-1])[data.begin])


def longest(data: Joined, params: GlobalLz) -> np.ndarray:
    """Rows of ``length << 16 | 0xFFFF - distance`` in the order of ``data.order``: each position's longest matches in its
    chain, the nearer of equal ones first, 0 for none."""
    order, keep, nice = data.order, params.optimal_matches, params.nice_length
    rank = np.arange(len(order), dtype=np.int32)
    rank -= np.maximum.accumulate(np.where(data.new, rank, 0))
    words = data.words[order]
    limit = np.minimum(np.repeat(data.begin[1:].astype(np.int32), data.sizes)[order] - order, params.max_length)
    found = []  # (places in order, distances, equal bytes up to 8), chunk by chunk, the nearest first
    for first in range(0, len(order), CHUNK):
        last = min(first + CHUNK, len(order))
        found.append(([np.zeros(0, np.int32)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint8)]))
        most = min(params.chain_depth, int(rank[first:last].max()))
        for back in range(1, most + 1):
            here = slice(max(first, back), last)
            before = slice(here.start - back, last - back)
            deep = rank[here] >= back
            if np.count_nonzero(deep) * 8 < last - first:  # few: one by one
                here = np.flatnonzero(deep) + here.start
                before, deep = here - back, True
            unequal, far = words[here] ^ words[before], order[here] - order[before]
            good = (unequal & THREE) == 0
            good &= (far <= params.short_match_max_distance) | (unequal & FOUR == 0)
            good &= (far <= params.window) & deep
            good = np.flatnonzero(good)
            if len(good):
                i = here[good] if isinstance(here, np.ndarray) else good + here.start
                for held, x in zip(found[-1], (i, far[good], equal_bytes(unequal[good])), strict=True):
                    held.append(x.astype(held[0].dtype))
    parts = [sum(map(len, x[0])) for x in found]
    where, away, equal = (np.concatenate([x for held in found for x in held[k]]) for k in range(3))
    del words, found
    # where eight bytes are equal and at the next place too, with the same distance, the length is one more than there
    long = np.flatnonzero(equal == 8).astype(np.int32)
    at = order[where[long]]
    by_far = np.argsort(away[long].astype(np.int64) << 32 | at)
    long, at = long[by_far], at[by_far]
    del by_far
    far = away[long].astype(np.int32)
    ends = np.ones(len(long), bool)
    ends[:-1] = (far[1:] != far[:-1]) | (at[1:] != at[:-1] + 1)
    ends = np.flatnonzero(ends)
    tail = np.full(len(ends), 8)
    data.longer(at[ends], at[ends] - far[ends], tail, limit[where[long[ends]]])
    runs = np.diff(ends, prepend=-1)
    equal[long] = np.minimum(np.repeat(tail + at[ends], runs) - at, MOST)
    del long, at, far
    out = np.zeros((len(order), keep), np.int32)
    first = begin = 0
    for part in parts:
        i, far, got = (x[begin : begin + part].astype(np.int32) for x in (where, away, equal))
        begin += part
        got = np.minimum(got, limit[i])
        usable = (got > SHORTEST) | (far <= params.short_match_max_distance)
        ended = np.flatnonzero(got >= nice)
        if len(ended):  # what is farther than the first match that long has not been looked at
            nearest = np.full(CHUNK, 1 << 30, np.int32)
            np.minimum.at(nearest, i[ended] - first, far[ended])
            usable &= far <= nearest[i - first]
        key, i = got << 16 | 0xFFFF - far, i - first
        best = np.zeros((keep, min(CHUNK, len(order) - first)), np.int32)
        insert(best, i[usable], key[usable])
        out[first : first + CHUNK] = best.T
        first += CHUNK
    return out


def insert(best: np.ndarray, i: np.ndarray, key: np.ndarray) -> None:
    """Rows of the largest keys of each place."""
    for row in best:
        np.maximum.at(row, i, key)
        left = key < row[i]
        i, key = i[left], key[left]


def fewest(data: Joined, params: GlobalLz) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of the matches of each stream's parse of the fewest bytes, then tokens; see ``lz.lz_optimal``.

    Places are laid out step by step, those of the longest streams first.
    """
    by_size = np.argsort(-data.sizes, kind="stable")
    sizes = data.sizes[by_size]
    rank = np.empty(len(sizes), np.int64)
    rank[by_size] = np.arange(len(sizes))
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 1), "right")
    begin = begins(active)
    total = int(begin[-1])
    place = (begin[ragged(data.sizes)] + np.repeat(rank, data.sizes)).astype(np.int32)[data.order]
    rows = np.zeros((total, params.optimal_matches), np.int32)
    rows[place] = longest(data, params)
    del place
    rows[:, 1:][rows[:, 1:] >> 16 == rows[:, :-1] >> 16] = 0  # as long and farther: never better
    come = np.flatnonzero(rows.ravel())
    key = rows.ravel()[come]
    del rows
    come //= params.optimal_matches
    at = np.searchsorted(come, begin).tolist()
    few = max(1, int(np.searchsorted(-active, -FEW_PARSED, "right")))
    rest = come[at[few] :].copy() if few < len(active) else None
    step = np.repeat(np.arange(len(active), dtype=np.int32), active)[come]
    come -= begin[step]  # the stream
    go = come + begin[step + (key >> 16)]
    come, more = come.astype(np.int32), 4 * BYTES + TOKEN - key.astype(np.int64)
    del step
    cost, plain = np.full(total, NEVER, np.int64), np.zeros(total, np.int16)
    cost[: len(sizes)] = PLAIN
    span = params.optimal_literals
    ring = np.full((span, len(sizes)), NEVER, np.int64)  # costs of runs that start at the last places, less place in bytes
    run, start, check = np.full(len(sizes), NEVER, np.int64), np.zeros(len(sizes), np.int64), 0
    places = begin.tolist()
    for p in range(min(few, len(active))):
        first, after = places[p], places[p + 1]
        n = after - first
        best, least, since = cost[first:after], run[:n], start[:n]
        if p >= check:
            old = np.flatnonzero(since < p - span)
            if len(old):
                held = ring[(np.arange(p, p + span) % span)[:, None], old]
                since[old] = held.argmin(axis=0) + (p - span)
                least[old] = held.min(axis=0)
            check = int(since.min()) + span + 1
        np.subtract(p, since, out=plain[first:after], casting="unsafe")
        np.minimum(least + p * BYTES, best, out=best)
        clean = best | PLAIN
        here = clean + ((2 - p) * BYTES + TOKEN)
        ring[p % span, :n] = here
        np.copyto(since, p, where=here < least)
        np.minimum(here, least, out=least)
        a, b = at[p], at[p + 1]
        if a < b:
            to = go[a:b]
            cost[to] = np.minimum(clean[come[a:b]] + more[a:b], cost[to])
    if few < len(active):
        for r in range(int(active[few])):
            mine = begin[few : int(sizes[r]) + 1] + r
            parse_rest(mine, few, ring[np.arange(few, few + span) % span, r], span, rest, key[at[few] :], cost, plain)
    del come, key, go, more
    # back from the ends
    length, distance = np.zeros(data.n, np.uint8), np.zeros(data.n, np.int32)
    some = np.flatnonzero(sizes)
    place, row, first = sizes[some], some, data.begin[:-1][by_size[some]]
    while len(row) > FEW:
        there = begin[place] + row
        way = PLAIN - (cost[there] & PLAIN)
        match = way > 0
        place = place - np.where(match, way >> 16, plain[there])
        there, way = (first + place)[match], way[match]
        length[there], distance[there] = way >> 16, 0xFFFF - (way & 0xFFFF)
        if not place.all():
            on = place > 0
            place, row, first = place[on], row[on], first[on]
    costs, runs, lengths, distances = memoryview(cost), memoryview(plain), memoryview(length), memoryview(distance)
    for p, r, b in zip(place.tolist(), row.tolist(), first.tolist(), strict=True):
        while p:
            way = PLAIN - (costs[places[p] + r] & PLAIN)
            if way:
                p -= way >> 16
                lengths[b + p], distances[b + p] = way >> 16, 0xFFFF - (way & 0xFFFF)
            else:
                p -= runs[places[p] + r]
    found = np.flatnonzero(length)
    return found, length[found], distance[found]


def parse_rest(place: np.ndarray, step: int, ring: np.ndarray, span: int, come: np.ndarray, key: np.ndarray, cost: np.ndarray, plain: np.ndarray) -> None:
    """The rest of fewest() for one stream, from a step on; ``place`` has its places."""
    best, literals = cost[place].tolist(), []
    low, high = np.searchsorted(come, place).tolist(), np.searchsorted(come, place, "right").tolist()
    runs: deque[tuple[int, int]] = deque()

    def begun(here: int, p: int) -> None:
        while runs and runs[-1][0] > here:
            runs.pop()
        runs.append((here, p))

    for k, here in enumerate(ring.tolist()):
        if here < NEVER:
            begun(here, step - span + k)
    for k, (a, b) in enumerate(zip(low, high, strict=True)):
        p = step + k
        while runs[0][1] < p - span:
            runs.popleft()
        literals.append(p - runs[0][1])
        best[k] = min(best[k], runs[0][0] + p * BYTES)
        now = best[k] | PLAIN
        begun(now + (2 - p) * BYTES + TOKEN, p)
        now += 4 * BYTES + TOKEN
        for match in key[a:b].tolist() if a < b else ():
            to = k + (match >> 16)
            best[to] = min(best[to], now - match)
    cost[place], plain[place] = best, literals


def lz_optimal_many(streams: list[bytes], params: GlobalLz = GlobalLz()) -> list[bytes]:
    """lz_optimal() of each stream."""
    out = {k: lz_optimal(x, params) for k, x in enumerate(streams) if len(x) >= LONG}
    rest = [k for k in range(len(streams)) if k not in out]
    for some in batches([len(streams[k]) for k in rest]):
        looks = pairs(Joined([streams[rest[k]] for k in some]), params.chain_depth)
        for part in batches(looks.tolist(), PARSED):
            mine = [rest[some[k]] for k in part]
            data = Joined([streams[k] for k in mine])
            found = fewest(data, params) if data.n >= SHORTEST else np.zeros((3, 0), np.int64)
            out |= zip(mine, written(data, *found), strict=True)
    return [out[k] for k in range(len(streams))]


# ---- tokens and back


class Tokens:
    """The tokens of LZ streams end to end: (tag, length, distance), each stream's number of them, and all literals.

    ``whole`` is False for streams that can't be read to their end; their tokens are those before the damage.
    """

    def __init__(self, streams: list[bytes]):
        sizes = np.array([len(x) for x in streams], np.int64)
        begin = begins(sizes)
        d = np.concatenate([np.frombuffer(b"".join(streams), np.uint8), np.zeros(4, np.uint8)])
        n = int(begin[-1])
        tag, step = d[:n], d[1 : n + 1].astype(np.int32) + 2
        step[tag == 1] = 4
        after = np.arange(n, dtype=np.int32) + step
        after[(tag > 1) | (after > np.repeat(begin[1:], sizes))] = n + 1
        last = begin[1:] - 1
        last = last[(sizes > 0)]
        after[last] = n + 1  # a lone tag
        seen = np.zeros(n, bool)
        self.whole = np.ones(len(streams), bool)
        some = np.flatnonzero(sizes)
        pos, end = begin[:-1][some], begin[1:][some]
        while len(some) > FEW:
            seen[pos] = True
            pos = after[pos]
            on = pos < end
            if not on.all():
                self.whole[some[pos > end]] = False
                some, pos, end = some[on], pos[on], end[on]
        view, there = memoryview(after), memoryview(seen)
        for k, p, e in zip(some.tolist(), pos.tolist(), end.tolist(), strict=True):
            while p < e:
                there[p] = True
                p = view[p]
            self.whole[k] = p == e
        at = np.flatnonzero(seen)
        at = at[after[at] <= n]  # without the damaged ones
        keep = (d[at] == 1) | (d[at + 1] > 0)  # empty runs of literals say nothing
        at = at[keep]
        self.tag, self.length = d[at], d[at + 1]
        self.distance = np.where(self.tag == 1, d[at + 2] | d[at + 3].astype(np.int32) << 8, 0)
        self.count = np.diff(np.searchsorted(at, begin))
        runs = np.where(self.tag == 0, self.length, 0).astype(np.int64)
        self.literals = d[np.repeat(at + 2, runs) + ragged(runs)]

    def expanded(self, sizes: list[int] | None = None) -> list[bytes | None]:
        """The bytes of each stream, of a given size or all; None for damaged ones."""
        owner = np.repeat(np.arange(len(self.count)), self.count)
        length = self.length.astype(np.int64)
        ahead = begins(length)
        first = ahead[begins(self.count)]  # where each stream starts
        start = ahead[:-1]
        matches = self.tag == 1
        wrong = matches & ((self.distance == 0) | (self.distance > start - first[:-1][owner]))
        good = self.whole.copy()
        if sizes is not None:
            want = np.asarray(sizes, np.int64)
            late = start - first[:-1][owner] >= want[owner]  # not looked at any more
            good = (np.diff(first) >= want) & (good | (np.bincount(owner, late, len(want)) > 0))
            wrong &= ~late
        good[owner[wrong]] = False
        total = int(ahead[-1])
        out = np.zeros(total, np.uint8)
        far = np.repeat(np.where(matches, self.distance, 0), length)
        plain = np.repeat(~matches, length)
        out[plain] = self.literals
        come = np.arange(total, dtype=np.int32) - far
        np.maximum(come, 0, out=come)  # of damaged streams
        left = copies = np.flatnonzero(~plain & (far > 0))
        source = come[left]
        plain |= far == 0
        while len(left):  # from copy to copy, twice as far each time
            source = come[source]
            come[left] = source
            on = ~plain[source]
            left, source = left[on], source[on]
        out[copies] = out[come[copies]]
        got = cut(out, first)
        return [None if not ok else x if sizes is None else x[:n] for x, ok, n in zip(got, good.tolist(), sizes or [0] * len(got), strict=True)]


    def streams(self) -> dict[str, list[bytes]]:
        """codecs.token_streams() of each stream, compact."""
        matches, begin = self.tag == 1, begins(self.count)
        far, plain = begins(matches)[begin], begins(np.where(matches, 0, self.length))[begin]
        distance = self.distance[matches]
        return {
            "types": cut(self.tag, begin),
            "lengths": cut(self.length, begin),
            "near": cut((distance & 255).astype(np.uint8), far),
            "far": cut((distance >> 8).astype(np.uint8), far),
            "literals": cut(self.literals, plain),
        }


def rebuilt_many(streams: dict[str, list[bytes]]) -> list[bytes]:
    """codecs.rebuilt() of the token streams of each stream."""
    flat = {k: np.frombuffer(b"".join(v), np.uint8) for k, v in streams.items()}
    matches, length = flat["types"] != 0, flat["lengths"]
    place = begins(np.where(matches, 4, 2 + length.astype(np.int64)))
    out, plain = np.zeros(int(place[-1]), np.uint8), np.ones(int(place[-1]), bool)
    head, there = place[:-1], place[:-1][matches]
    for at, values in ((head, matches), (head + 1, length), (there + 2, flat["near"]), (there + 3, flat["far"])):
        out[at], plain[at] = values, False
    out[plain] = flat["literals"]
    return cut(out, place[begins(np.array([len(x) for x in streams["types"]], np.int64))])


def lz_decompress_many(streams: list[bytes], sizes: list[int] | None = None) -> list[bytes | None]:
    """lz_decompress() of each stream; None for damaged ones."""
    out: list[bytes | None] = []
    for part in batches([len(x) for x in streams] if sizes is None else [max(len(x), n) for x, n in zip(streams, sizes, strict=True)]):
        out += Tokens([streams[k] for k in part]).expanded(None if sizes is None else [sizes[k] for k in part])
    return out
