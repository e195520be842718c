"""Secrets by fixed patterns and a password guess-cost dynamic programme.

The patterns fix the base spans.  The method looks at values in a credential context (a credential
word, an assignment, a value) and adds, as kind ``guess``, those that are hard to guess: the cost
of a value is the cheapest way to cut it into common words, dates, repeats, keyboard walks and
brute-force spans, in powers of ten of guesses, found by dynamic programming over its positions.
"password: changeme" is cheap and not reported, random strings are.

Offsets count code points, ends are exclusive.  Defined results: null text is empty and has no
spans; null ids and repeated rows are scanned one by one; an empty table gives an empty result;
whole texts and whole values are looked at whatever their length (a value of n characters costs time
n log n at most); other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from blockloom.llm.pii import Span, joined
from blockloom.llm.shared import map_arrow
from blockloom.llm.textscan import slices

# Fixed patterns: they must match these definitions exactly.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: One of these is in every match of ASSIGN, in lower case.
ASSIGN_WORDS = ("passw", "secret", "token", "api")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "guess")

#: A credential word, also with a part of a name after it, an assignment and a value; after "is" or a bare "bearer"
#: the value needs a digit or a sign, or prose would match.
CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|bearer|(?:api|access|private|auth)[_-]?key)"""
    r"""(?:[_-](?:access|api|key|token|value|id|code|hash|text|string)){0,3}["']?(?:\s*+(?:=>|:=|[:=])|\s++is\s(?=\s*+["']?[^\s"',;<>]*[0-9!#$%&*+/=@^_~]))|bearer\s(?=\s*+[^\s"',;<>]*[0-9+/=_]))\s*+["']?([^\s"',;<>]{6,})""",
    re.I | re.A,
)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "credential", "bearer", "key")
#: Reported from 10**10 guesses on.
HARD = 10.0
SEGMENT = math.log10(2)
#: Common parts of passwords, most common first (fixed values).
COMMON_WORDS = tuple(
    """password pass admin welcome login letmein master dragon monkey sunshine princess football baseball
    shadow superman batman trustno hello freedom whatever secret token change changeme default root test
    testing user guest example sample dummy placeholder your here insert replace none null true false demo
    qwerty love god summer winter spring autumn monday friday january march april june july august computer
    internet server system database access account private public key value string hidden redacted mypassword
    please enter new old temp temporary company home office one two three four five""".split()
)
WORD_RANK = {w: k + 1 for k, w in enumerate(COMMON_WORDS)}
WORD_SIZES = sorted({len(w) for w in COMMON_WORDS})
LEET = str.maketrans("013457@$!", "oleastasi")
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")


def neighbours() -> dict[str, frozenset[str]]:
    """Keys next to each other on a keyboard whose rows are set off by half a key."""
    at = {c: (r, k + r / 2) for r, row in enumerate(ROWS) for k, c in enumerate(row) if c != " "}
    return {c: frozenset(d for d, (s, y) in at.items() if d != c and abs(r - s) <= 1 and abs(x - y) <= 1) for c, (r, x) in at.items()}


NEIGHBOURS = neighbours()
_YEAR, _MONTH, _DAY, _SIGN = r"(?:19|20)[0-9]{2}", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])", r"[-/._]?"
#: Patterns of dates and years, and what each costs; each matches one length at most from a place.
DATES = (
    (re.compile(_YEAR + _SIGN + _MONTH + _SIGN + _DAY), math.log10(365 * 120)),
    (re.compile(_DAY + _SIGN + _MONTH + _SIGN + _YEAR), math.log10(365 * 120)),
    (re.compile(_YEAR), math.log10(120)),
)


def char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 2.0


def word_cost(part: str) -> float | None:
    low = part.lower()
    rank, extra = WORD_RANK.get(low), 0.0
    if rank is None:
        rank, extra = WORD_RANK.get(low.translate(LEET)), SEGMENT
    if rank is None:
        return None
    if part != low:
        extra += SEGMENT if part[1:] == low[1:] or part.isupper() else len(part) * SEGMENT
    return math.log10(rank + 1) + extra


class Chains:
    """The cheapest start of segments that are chains of steps: ``least`` steps or more, each ``stride`` characters.

    A chain of n steps is charged for the next number of the form 2**j + least - 1, so its length costs
    one of a few values.  For each of them the cheapest start is a minimum over 2**j places that are
    ``stride`` apart, made of two minima over half as many; a value costs time n log n, however long its chains.
    """

    def __init__(self, stride: int, least: int):
        self.stride, self.least = stride, least
        self.lows: list[dict[int, float]] = []
        self.whole: dict[int, float] = {}  # by residue: over all starts of the chain that goes on

    def end(self) -> None:
        if self.whole:
            self.lows, self.whole = [], {}

    def cheapest(self, best: list[float], end: int, steps: int, weight: float) -> float:
        """The least of best[start] + weight * log10(charged steps) over chains to ``end``, of which the longest has ``steps`` steps."""
        last = end - self.stride * self.least
        starts, row = steps - self.least + 1, last % self.stride
        self.whole[row] = low = min(self.whole.get(row, math.inf), best[last])
        here, j, out = best[last], 0, math.inf
        while True:
            if len(self.lows) == j:
                self.lows.append({})
            self.lows[j][last] = here
            if 1 << j >= starts:
                return min(out, low + weight * LENGTHS[self.least][j])
            out = min(out, here + weight * LENGTHS[self.least][j])
            here = min(here, self.lows[j].get(last - (self.stride << j), math.inf))
            j += 1


#: By the least number of steps: log10 of what a chain in class j is charged for.
LENGTHS = {least: [math.log10((1 << j) + least - 1) for j in range(40)] for least in (2, 3)}


def charged(steps: int, least: int) -> float:
    """log10 of the steps that a chain of so many is charged for."""
    return LENGTHS[least][(steps - least).bit_length() if steps > least else 0]


WALK_COST, RUN_COST = math.log10(47 * 4), math.log10(62)
LONGEST_UNIT = 8


def guess_cost(value: str) -> float:
    """log10 of the guesses for a value: the cheapest segmentation, over all segments of all kinds.

    Segments: common words; dates and years; walks over neighbouring keys, and runs of
    rising or falling code points, of 3 characters or more; a unit of 1 to 8 characters twice or more (one
    character three times or more); brute-force spans.
    """
    n = len(value)
    best = [0.0] + [math.inf] * n
    low = "".join(x if len(x := c.lower()) == 1 else c for c in value)
    leet = low.translate(LEET)
    spent = [0.0, *itertools.accumulate(map(char_cost, value))]
    steps = (
        (lambda k: low[k] in NEIGHBOURS.get(low[k - 1], ()), WALK_COST, 2.0),
        (lambda k: ord(value[k]) == ord(value[k - 1]) + 1, RUN_COST, 1.0),
        (lambda k: ord(value[k]) == ord(value[k - 1]) - 1, RUN_COST, 1.0),
    )
    lines = [(follows, cost, weight, Chains(1, 3)) for follows, cost, weight in steps]
    line_from = [0] * len(lines)
    repeats = [(unit, Chains(unit, 3 if unit == 1 else 2)) for unit in range(1, LONGEST_UNIT + 1)]
    repeat_from = [0] * len(repeats)
    ahead: dict[int, float] = {}  # the cheapest segment so far that ends at a later place
    open_brute = math.inf  # the cheapest way to position k with a brute-force span that goes on
    for k in range(n):
        here = best[k] + SEGMENT
        for size in WORD_SIZES:
            if (low[k : k + size] in WORD_RANK or leet[k : k + size] in WORD_RANK) and (cost := word_cost(value[k : k + size])) is not None:
                ahead[k + size] = min(ahead.get(k + size, math.inf), here + cost)
        if "0" <= value[k] <= "3":
            for pattern, cost in DATES:
                if m := pattern.match(value, k):
                    ahead[m.end()] = min(ahead.get(m.end(), math.inf), here + cost)
        end = k + 1
        open_brute = min(open_brute, here) + char_cost(value[k])
        cheapest = min(open_brute, ahead.pop(end, math.inf))
        for i, (follows, cost, weight, chains) in enumerate(lines):
            if k and not follows(k):
                line_from[i] = k
                chains.end()
            elif (length := end - line_from[i]) >= 3:
                cheapest = min(cheapest, SEGMENT + cost + chains.cheapest(best, end, length, weight))
        for i, (unit, chains) in enumerate(repeats):
            if k >= unit and value[k] != value[k - unit]:
                repeat_from[i] = k - unit + 1
                chains.end()
            elif (times := (end - repeat_from[i]) // unit) >= chains.least:
                word = word_cost(value[end - unit : end]) if unit >= 3 else None
                cost = spent[end] - spent[end - unit] if word is None else min(word, spent[end] - spent[end - unit])
                cheapest = min(cheapest, SEGMENT + cost + chains.cheapest(best, end, times, 1.0))
        best[end] = cheapest
    return best[n]


def base_spans(text: str, low: str) -> list[Span]:
    out: list[Span] = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m.group()) >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def credential_values(text: str, low: str) -> list[tuple[int, int, float]]:
    """(start, end, cost) of the values in a credential context."""
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    return [(*m.span(1), guess_cost(m.group(1))) for m in CONTEXT.finditer(text)]


def scan_batches(batches: Iterable[pa.RecordBatch], hard: float) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        base, spans, costs = [], [], []
        for text in texts:
            low = text.lower()
            b = base_spans(text, low)
            values = credential_values(text, low)
            added = [("guess", x, y) for x, y, cost in values if cost >= hard and not any(p < y and x < q for _, p, q in b)]
            base.append(b)
            spans.append(joined(b + added, KINDS))
            costs.append(max((c for _, _, c in values), default=None))
        counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in BASE_KINDS]
        sums = [hashlib.sha256(joined(b, KINDS).encode()).hexdigest() for b in base]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *counts, pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array(costs, pa.float64())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "hardest"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hard: float = HARD) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, hardest (log10 guesses of the hardest credential value)."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(plain, lambda batches: scan_batches(batches, hard), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, hardest double")
