"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns (``KINDS``, emails to phone numbers) fix the base spans.  The field adds spans: words
are symbols of their *shape* (digits, letters, signs), labels are O and B-/I- of each kind, and the
weights of a shape at the word itself, before it and after it, and those of the transitions, are
fitted by gradient ascent on the log-likelihood of a small labelled table (``training_table``).
Decoding is Viterbi, in numpy, for all islands of a slice of documents at once: a word may carry a
label only within REACH words of one that has a digit, an @ or a cue word (an emission of minus
infinity elsewhere, in training too), so plain prose needs no decoding.  An island whose labels reach
its edge grows by REACH words and is decoded again.

Offsets count code points, ends are exclusive.  Defined results: null text is empty and has no
spans; null ids and repeated rows are scanned one by one; an empty table gives an empty result;
whole texts are scanned whatever their length; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from blockloom.llm.shared import map_arrow
from blockloom.llm.textscan import is_not_space, lower_ascii, scan, slices

# Fixed patterns: they must match these definitions exactly.
#: A match can only start where a run of digits starts, so nothing else is tried: time is linear in long runs.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: In the order of the digest; the field also knows national ids.
KINDS = ("email", "ip", "card", "phone", "national_id")
BASE_KINDS = KINDS[:4]

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # each match has one @: what may stand before it, back to the last match, then the domain
        lo = at
        while lo > free and text[lo - 1] in LOCAL_CHARS:
            lo -= 1
        if lo < at and (m := DOMAIN.match(text, at)):
            out.append(("email", lo, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if re.search(r"[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = re.sub(r"[^0-9]", "", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


# ---- the conditional random field

REACH = 2
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Words that announce or spell out personal data (fixed values).
CUES = ("at", "dot", "phone", "tel", "telephone", "mobile", "call", "fax", "email", "mail", "ip", "address", "card", "visa", "mastercard", "iban", "ssn", "security", "passport", "id", "no", "number")
PUNCTUATION = ".,;:!?\"'()[]<>"


def shape(word: str) -> str:
    """The symbol of a word: signs as they are, digits 9 and letters a, runs counted up to four."""
    core = word.strip(PUNCTUATION.replace("(", "").replace(")", ""))
    low = core.lower()
    if low in CUES:
        return f"cue {low}"
    if not re.search(r"[0-9@]", core):
        return "word"
    out = re.sub(r"[A-Za-z]+", "a", re.sub(r"[^\x00-\x7f]+", "a", core))
    runs = re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 20)}.", out)
    return runs if len(runs) <= 24 else runs[:24] + "~"


def features(symbol: str) -> tuple[str, ...]:
    """What weights belong to: the symbol, and parts that unseen symbols share with seen ones."""
    if symbol == "word" or symbol.startswith("cue "):
        return (symbol,)
    signs = "".join(sorted(set(re.sub(r"[0-9a~.]", "", symbol))))
    runs = re.findall(r"9([0-9]+)\.", symbol)
    digits = sum(map(int, runs))
    return (symbol, f"signs {signs}", f"runs {min(len(runs), 5)} {'a' in symbol}", f"digits {min(digits, 17)}", f"form {'a' in symbol} {'@' in symbol} {min(len(runs), 5)} {signs}")


def training_table(seed: int = 7, copies: int = 40) -> list[list[tuple[str, str]]]:
    """Small sentences of (word, label), made by rule: examples of each kind, and look-alikes labelled O."""
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(rng.choice(list("abdegilmnorstu"), rng.integers(3, 9)))
    octet = lambda: str(rng.integers(1, 255))

    def examples() -> list[tuple[str, str]]:
        phone = [f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]
        card = [digits(16), " ".join(digits(4) for _ in range(4)), "-".join(digits(4) for _ in range(4))]
        email = [f"{name()}.{digits(2)}@{name()}.com", f"{name()}@{name()}.{name()}.org", f"{name()} at {name()} dot com"]
        out = [("phone", p) for p in phone] + [("card", c) for c in card] + [("email", e) for e in email]
        out += [("ip", ".".join(octet() for _ in range(4))), ("national_id", f"{digits(3)}-{digits(2)}-{digits(4)}")]
        plain = [digits(4), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"${digits(2)}.{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(2)}%", f"{digits(1)},{digits(3)}", f"v{digits(1)}.{digits(2)}", f"@{name()}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"({digits(4)})", f"{name()}{digits(2)}", f"AKIA{name().upper()}{digits(6)}", f"password={name()}{digits(8)}", f'"{name()}{digits(12)}{name()}"', digits(2), digits(1), f"{digits(3)}-{digits(3)}", f"is at {name()}", f"call {name()}", f"no {digits(3)}", f"{name()} at {digits(2)}:{digits(2)}", "phone", "email", f"id {digits(6)}", digits(9), digits(20)]
        return out + [("O", p) for p in plain]

    lead = {"phone": "phone", "email": "email", "ip": "ip", "card": "card", "national_id": "ssn", "O": "no"}
    table = []
    for _ in range(copies):
        for kind, value in examples():
            row = [(name(), "O") for _ in range(rng.integers(1, 5))]
            if kind == "national_id" or rng.random() < 0.3:
                row.append((lead[kind] + ":" * int(rng.integers(0, 2)), "O"))
            words = value.split(" ")
            row += [(w, "O" if kind == "O" else ("B-" if k == 0 else "I-") + kind) for k, w in enumerate(words)]
            if rng.random() < 0.2:
                row[-1] = (row[-1][0] + str(rng.choice([".", ","])), row[-1][1])
            table.append(row + [(name(), "O") for _ in range(rng.integers(1, 5))])
    return table


def loud(symbol: str) -> bool:
    return symbol != "word"


def allowed() -> np.ndarray:
    """Transitions: I- follows B- or I- of its kind only."""
    k = len(LABELS)
    out = np.zeros((k, k))
    for a, x in enumerate(LABELS):
        for b, y in enumerate(LABELS):
            if y[0] == "I" and x[2:] != y[2:]:
                out[a, b] = -np.inf
    return out


class Field:
    """Weights by (place, feature): place 0 the word itself, 1 the word before, 2 the word after."""

    def __init__(self) -> None:
        self.index: dict[tuple[int, str], int] = {}
        self.weights = np.zeros((0, len(LABELS)))
        self.moves = np.zeros((len(LABELS), len(LABELS)))
        self.start = np.zeros(len(LABELS))
        self.start[[k for k, x in enumerate(LABELS) if x[0] == "I"]] = -np.inf
        self.known: dict[str, np.ndarray] = {}

    def rows(self, symbols: list[str], place: int, grow: bool) -> list[list[int]]:
        out = []
        for s in symbols:
            keys = [(place, f) for f in features(s)]
            if grow:
                for key in keys:
                    self.index.setdefault(key, len(self.index))
            out.append([self.index[key] for key in keys if key in self.index])
        return out

    def parts(self, symbol: str) -> np.ndarray:
        """(3, labels): what the symbol adds to the emission of its own word, the next and the one before."""
        got = self.known.get(symbol)
        if got is None:
            got = np.stack([self.weights[r].sum(axis=0) if (r := self.rows([symbol], place, False)[0]) else np.zeros(len(LABELS)) for place in range(3)])
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[symbol] = got
        return got

    def fit(self, table: list[list[tuple[str, str]]], rounds: int = 60, rate: float = 0.3, ridge: float = 1e-4) -> Field:
        """Gradient ascent (Adagrad) on the penalised log-likelihood, all sentences of a length at once."""
        label = {x: k for k, x in enumerate(LABELS)}
        by_length: dict[int, list[tuple[list[list[int]], list[int], list[bool]]]] = {}
        for row in table:
            symbols = [shape(w) for w, _ in row]
            marks = [loud(s) for s in symbols]
            near = [any(marks[max(0, k - REACH) : k + REACH + 1]) for k in range(len(row))]
            own, before, after = (self.rows(symbols, place, True) for place in range(3))
            feats = [own[k] + (before[k - 1] if k else []) + (after[k + 1] if k + 1 < len(row) else []) for k in range(len(row))]
            by_length.setdefault(len(row), []).append((feats, [label[y] for _, y in row], near))
        n_labels = len(LABELS)
        width = max(len(f) for rows in by_length.values() for feats, _, _ in rows for f in feats)
        pad = len(self.index)
        batches = []
        for rows in by_length.values():
            x = np.full((len(rows), len(rows[0][0]), width), pad)
            for i, (feats, _, _) in enumerate(rows):
                for t, f in enumerate(feats):
                    x[i, t, : len(f)] = f
            mask = np.where(np.array([near for _, _, near in rows])[:, :, None] | (np.arange(n_labels) == 0), 0.0, -1e9)
            by_feature = np.argsort(x.ravel(), kind="stable")
            ends = np.searchsorted(x.ravel()[by_feature], np.arange(pad + 1))
            used = np.flatnonzero(np.diff(np.append(ends, x.size)))
            batches.append((x, np.array([y for _, y, _ in rows]), mask, by_feature // width, ends[used], used))
        w, m = np.zeros((pad + 1, n_labels)), np.zeros((n_labels, n_labels))
        w2, m2 = np.full_like(w, 1e-8), np.full_like(m, 1e-8)
        bar, start = np.maximum(allowed(), -1e9), np.maximum(self.start, -1e9)
        total = sum(len(b[1]) for b in batches)
        one = lambda a: a / a.sum(axis=-1, keepdims=True)
        for _ in range(rounds):
            gw, gm = -ridge * total * w, -ridge * total * m
            move = np.exp(m + bar - m.max())
            for x, y, mask, words, ends, used in batches:
                n, length = y.shape
                e = w[x].sum(axis=2) + mask
                e = np.exp(e - e.max(axis=2, keepdims=True)).swapaxes(0, 1)
                f, b = np.ones((length, n, n_labels)), np.ones((length, n, n_labels))
                f[0] = one(e[0] * np.exp(start))
                for t in range(1, length):
                    f[t] = one(f[t - 1] @ move * e[t])
                for t in range(length - 2, -1, -1):
                    b[t] = one((e[t + 1] * b[t + 1]) @ move.T)
                surplus = (np.eye(n_labels)[y] - one(f * b).swapaxes(0, 1)).reshape(-1, n_labels)
                gw[used] += np.add.reduceat(surplus[words], ends)
                for t in range(1, length):
                    after = e[t] * b[t]
                    gm -= move * ((f[t - 1] / ((f[t - 1] @ move) * after).sum(axis=1, keepdims=True)).T @ after)
                    gm += np.bincount(y[:, t - 1] * n_labels + y[:, t], minlength=n_labels**2).reshape(n_labels, n_labels)
            gw[pad] = 0
            w2 += gw**2
            m2 += gm**2
            w += rate * gw / np.sqrt(w2)
            m += rate * gm / np.sqrt(m2)
        self.weights, self.moves = w[:pad], m + allowed()
        return self

    def viterbi(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of many islands: emissions (islands, words, labels), padded at the end."""
        n, length, k = emissions.shape
        back = np.zeros((length, n, k), np.int8)
        score = emissions[:, 0] + self.start
        final = score.copy()
        for t in range(1, length):
            ways = score[:, :, None] + self.moves[None]
            back[t] = ways.argmax(axis=1)
            score = ways.max(axis=1) + emissions[:, t]
            on = lengths > t
            final[on] = score[on]
        out = np.zeros((n, length), np.int64)
        rows = np.arange(n)
        at = final.argmax(axis=1)
        for t in range(length - 1, -1, -1):
            last = lengths - 1 == t
            at = np.where(last, final.argmax(axis=1), at)
            out[:, t] = at
            if t:
                at = np.where(lengths > t, back[t][rows, at], at)
        return out


@functools.cache
def trained() -> Field:
    return Field().fit(training_table())


def word_symbols(words) -> tuple[np.ndarray, dict[int, str]]:
    """Which words may be loud, by bytes: those with a digit or @, or in the list of cues; their symbols."""
    n = len(words.starts)
    mark = np.zeros(256, np.uint8)
    mark[0x30:0x3A] = mark[ord("@")] = 1
    rich = np.zeros(n, bool)
    if n:
        total = np.concatenate([[0], np.cumsum(mark[words.data], dtype=np.int32)])
        rich = total[words.ends] > total[words.starts]
    size = words.ends - words.starts
    maybe = np.flatnonzero(~rich & (size <= 16))
    cues = maybe[cue_filter()[(words.hashes[maybe] & np.uint64(0xFFFF)).astype(np.int64)]]
    at = np.union1d(np.flatnonzero(rich), cues)
    return at, {int(k): s for k in at if (s := shape(words.word(int(k)).decode())) != "word"}


@functools.cache
def cue_filter() -> np.ndarray:
    """True at the low 16 bits of the hashes of cue words, also with a sign after them."""
    out = np.zeros(1 << 16, bool)
    for cue in CUES:
        for tail in ("", *PUNCTUATION):
            data = np.frombuffer((cue + tail).encode(), np.uint8)
            out[int(scan(data, np.array([0, len(data)]), is_not_space(), lower_ascii()).hashes[0]) & 0xFFFF] = True
    return out


def field_spans(words, field: Field) -> Iterator[tuple[str, int, int]]:
    """(kind, first byte, end byte) in the slice's bytes of all spans that the field finds."""
    _, symbols = word_symbols(words)
    loud_at = np.array([k for k, s in symbols.items() if loud(s)], np.int64)
    if not len(loud_at):
        return
    text = np.searchsorted(words.first, loud_at, "right") - 1
    low, high = words.first[text], words.first[text + 1]
    lo, hi = np.maximum(loud_at - REACH, low), np.minimum(loud_at + REACH + 1, high)
    known: dict[tuple[int, int], list[int]] = {}
    while True:
        new = np.ones(len(lo), bool)
        new[1:] = (lo[1:] > np.maximum.accumulate(hi)[:-1]) | (low[1:] != low[:-1])
        at = np.flatnonzero(new)
        lo, hi, low, high = lo[at], np.maximum.reduceat(hi, at), low[at], high[at]
        islands = list(zip(lo.tolist(), hi.tolist(), strict=True))
        fresh = np.array([k for k, x in enumerate(islands) if x not in known], np.int64)
        known.update(zip([islands[k] for k in fresh], decode(field, symbols, lo[fresh], hi[fresh], low[fresh], high[fresh]), strict=True))
        left = np.array([known[x][0] != 0 for x in islands]) & (lo > low)
        right = np.array([known[x][-1] != 0 for x in islands]) & (hi < high)
        if not (left | right).any():
            break
        lo, hi = np.where(left, np.maximum(lo - REACH, low), lo), np.where(right, np.minimum(hi + REACH, high), hi)
    for a, b in islands:
        best = known[a, b]
        t = 0
        while t < b - a:
            if best[t] == 0:
                t += 1
                continue
            stop = t + 1
            while stop < b - a and LABELS[best[stop]][0] == "I":
                stop += 1
            yield LABELS[best[t]][2:], int(words.starts[a + t]), int(words.ends[a + stop - 1])
            t = stop


def decode(field: Field, symbols: dict[int, str], begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[list[int]]:
    """The best labels of each island of words begin..end, in a text of the words low..high."""
    lengths = end - begin
    order = np.argsort(lengths, kind="stable")
    plain = field.parts("word")
    out: list[list[int]] = [[]] * len(begin)
    for group in np.array_split(order, max(1, len(order) // 2000)):
        size, most = lengths[group], int(lengths[group].max())
        e = np.zeros((len(group), most, len(LABELS)))
        for i, g in enumerate(group.tolist()):
            a, b = int(begin[g]), int(end[g])
            parts = [field.parts(symbols[k]) if k in symbols else plain for k in range(a, b)]
            for t, part in enumerate(parts):
                e[i, t] = part[0]
                if a + t > low[g]:
                    e[i, t] += (parts[t - 1] if t else field.parts(symbols.get(a - 1, "word")))[1]
                if a + t + 1 < high[g]:
                    e[i, t] += (parts[t + 1] if t + 1 < len(parts) else field.parts(symbols.get(b, "word")))[2]
        best = field.viterbi(e, size)
        for i, g in enumerate(group.tolist()):
            out[g] = best[i, : size[i]].tolist()
    return out


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def plausible(kind: str, value: str) -> bool:
    """What a span of the field must have to be reported."""
    digits = len(re.sub(r"[^0-9]", "", value))
    return {"email": "@" in value or re.search(r"\bdot\b", value, re.I) is not None, "ip": digits >= 4, "card": 12 <= digits <= 19, "phone": 9 <= digits <= 15, "national_id": digits == 9}[kind]


def scan_batches(batches: Iterable[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    table, lower = is_not_space(), lower_ascii()
    keep = frozenset(PUNCTUATION) - frozenset("()")
    for rows, data, offsets in slices(batches):
        words = scan(data, offsets, table, lower)
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        base = [base_spans(t) for t in texts]
        spans = [set(x) for x in base]
        for kind, lo, hi in field_spans(words, field):
            k = int(np.searchsorted(offsets, lo, "right")) - 1
            start = len(raw[int(offsets[k]) : lo].decode())
            value = raw[lo:hi].decode()
            while value and value[0] in keep:
                value, start = value[1:], start + 1
            while value and value[-1] in keep:
                value = value[:-1]
            end = start + len(value)
            if plausible(kind, value) and not any(a < end and start < b for _, a, b in base[k]):
                spans[k].add((kind, start, end))
        counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in BASE_KINDS]
        sums = [hashlib.sha256(joined(b, KINDS).encode()).hexdigest() for b in base]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *counts, pa.array(sums, pa.string()), pa.array([joined(s, KINDS) for s in spans], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined)."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    return map_arrow(plain, lambda batches: scan_batches(batches, sent.value), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
