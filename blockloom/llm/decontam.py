"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` k-grams in a row the one with the smallest hash is kept (the last of equal ones), in
documents and in benchmark items alike.  A span of ``K + WINDOW - 1`` shared words holds the same k-grams
on both sides and so keeps the same one: every window of ten shared words has a shared fingerprint.  The
documents' fingerprints are joined with the benchmark's; around each match the windows of ten words
that hold it are looked up among the benchmark's windows, compared word by word as bytes, and extended
to spans of consecutive windows.  Items of fewer than ten words are one window, looked up as a whole.
Hashes only find candidates.  Work is in proportion to matched places, however often words repeat:
a window is looked up once, whatever the number of places that it has in the benchmark.

The executors cut the benchmark into pieces of at most ``PIECE_WORDS`` words that overlap by nine, and pieces
travel in blocks of about ``BLOCK_WORDS`` words or ``BLOCK_BYTES`` bytes: one broadcast each, made one after
another, and a pass of its own over the rows for every further block, so neither a large benchmark
nor a passage that a third of all documents share needs a shuffle.

Defined results: null text and text without words give no words and no hits; null items and items
without words are ignored; rows of the benchmark with one id are one item; null ids and repeated
rows of the documents are judged one by one; an empty table on either side gives no hits.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from blockloom.llm.shared import cut, map_arrow
from blockloom.llm.textscan import Words, grams, grams_at, is_alphanumeric, lower_ascii, scan, slices

ITEM_WINDOW = 10
K = 5
WINDOW = ITEM_WINDOW - K + 1
PIECE_WORDS = 20_000
BLOCK_WORDS = 1_000_000
BLOCK_BYTES = 32 << 20
#: A bit for each of 2**16 values of a hash's low bits spares most lookups.
SIEVE = 1 << 16
FOUND = "found array<struct<item:string,lo:int,hi:int>>"


def room(first: np.ndarray) -> np.ndarray:
    """For each word the number of words from it to its text's end."""
    return np.repeat(first[1:], np.diff(first)) - np.arange(int(first[-1]))


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the k-grams that are the last smallest one in a window of their text."""
    h = grams(hashes, K)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), h[:0]
    low = h[:n].copy()
    for j in range(1, WINDOW):
        np.minimum(low, h[j : j + n], out=low)
    kept, open_ = np.zeros(len(h), bool), room(first)[:n] >= ITEM_WINDOW
    for j in range(WINDOW - 1, -1, -1):
        least = open_ & (h[j : j + n] == low)
        kept[j : j + n] |= least
        open_ &= ~least
    at = np.flatnonzero(kept)
    return at, h[at]


def equal_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word i of one side has the bytes of word j of the other."""
    size = a.ends[i] - a.starts[i]
    same = size == b.ends[j] - b.starts[j]
    size = np.where(same, size, 0)
    ends = np.cumsum(size)
    step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
    unequal = a.data[np.repeat(a.starts[i], size) + step] != b.data[np.repeat(b.starts[j], size) + step]
    same[np.repeat(np.arange(len(size)), size)[unequal]] = False
    return same


class Windows:
    """The distinct windows of ``size`` words of a block: sorted hashes, a place of each, and the items that have it."""

    def __init__(self, block: Block, size: int, at: np.ndarray):
        self.size = size
        hashes = grams_at(block.words.hashes, at, size)
        self.hashes, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        self.place = at[first]
        pairs = np.unique(back.astype(np.int64) * len(block.ids) + block.item_of[at])
        window, item = pairs // len(block.ids), pairs % len(block.ids)
        start = np.searchsorted(window, np.arange(len(self.hashes) + 1))
        #: by set number the items, first of all those of one item; the windows' set numbers
        self.sets: list[np.ndarray] = [np.array([k]) for k in range(len(block.ids))]
        self.set_of = item[start[:-1]]
        known: dict[bytes, int] = {}
        for k in np.flatnonzero(np.diff(start) > 1).tolist():
            items = item[start[k] : start[k + 1]]
            name = known.setdefault(items.tobytes(), len(self.sets))
            if name == len(self.sets):
                self.sets.append(items)
            self.set_of[k] = name


def sieve_of(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(SIEVE, bool)
    out[(hashes % np.uint64(SIEVE)).astype(np.int64)] = True
    return out


def located(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are known, and the places of those."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = np.flatnonzero(known[at] == hashes)
    return hit, at[hit]


class Block:
    """Some pieces of benchmark items, ready for lookups."""

    def __init__(self, pieces: list[tuple[str, bytes]]):
        self.ids = sorted({i for i, _ in pieces})
        number = {x: k for k, x in enumerate(self.ids)}
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in pieces])]).astype(np.int64)
        self.words = scan(np.frombuffer(b"".join(t for _, t in pieces), np.uint8), offsets, is_alphanumeric(), lower_ascii())
        first = self.words.first
        lengths = np.diff(first)
        self.item_of = np.repeat(np.array([number[i] for i, _ in pieces], np.int64), lengths)
        self.vocabulary, self.sample, self.word_ids = np.unique(self.words.hashes, return_index=True, return_inverse=True)
        of_piece, left = np.repeat(lengths, lengths), room(first)
        self.windows = [Windows(self, int(n), np.flatnonzero((of_piece == n) & (left == n))) for n in np.unique(lengths[(lengths > 0) & (lengths < ITEM_WINDOW)])]
        self.sieves = [sieve_of(w.hashes) for w in self.windows]
        at = np.flatnonzero(left >= ITEM_WINDOW)
        if len(at):
            self.windows.append(Windows(self, ITEM_WINDOW, at))
            self.prints = np.unique(fingerprints(self.words.hashes, first)[1])
            self.sieves.append(sieve_of(self.prints))

    def starts(self, words: Words, windows: Windows, sieve: np.ndarray) -> np.ndarray:
        """Words of the documents at which one of the windows may start."""
        left = room(words.first)
        if windows.size < ITEM_WINDOW:
            h = grams(words.hashes, windows.size)
            at = np.flatnonzero(sieve[(h % np.uint64(SIEVE)).astype(np.int64)])
        else:
            at, h = fingerprints(words.hashes, words.first)
            some = np.flatnonzero(sieve[(h % np.uint64(SIEVE)).astype(np.int64)])
            at = at[some[located(self.prints, h[some])[0]]]
            at = np.unique(at[:, None] - np.arange(WINDOW)) if len(at) else at
            at = at[at >= 0]
        return at[left[at] >= windows.size]

    def matches(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, end word) of the spans of consecutive windows that a text of a slice shares with an item."""
        for windows, sieve in zip(self.windows, self.sieves, strict=True):
            at = self.starts(words, windows, sieve)
            if not len(at):
                continue
            hit, window = located(windows.hashes, grams_at(words.hashes, at, windows.size))
            at = at[hit]
            steps = np.arange(windows.size)
            used = np.unique(at[:, None] + steps)
            ids = np.minimum(np.searchsorted(self.vocabulary, words.hashes[used]), len(self.vocabulary) - 1)
            ids[~equal_words(words, used, self.words, self.sample[ids])] = -1
            own = ids[np.searchsorted(used, at)[:, None] + steps]
            same = (own == self.word_ids[windows.place[window][:, None] + steps]).all(axis=1)
            yield from self.spans(words, windows, at[same], windows.set_of[window[same]])

    def spans(self, words: Words, windows: Windows, at: np.ndarray, sets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        if not len(at):
            return
        text = np.searchsorted(words.first, at, "right") - 1
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(text) != 0) | (np.diff(sets) != 0)]))
        last = np.append(begin[1:], len(at)) - 1
        open_: dict[int, tuple[int, int, int]] = {}
        for t, s, lo, hi in zip(text[begin].tolist(), sets[begin].tolist(), at[begin].tolist(), (at[last] + windows.size).tolist(), strict=True):
            for item in windows.sets[s].tolist():
                was = open_.get(item)
                if was and was[0] == t and lo <= was[2]:
                    open_[item] = (t, was[1], hi)
                    continue
                if was:
                    yield was[0], item, was[1], was[2]
                open_[item] = (t, lo, hi)
        for item, (t, lo, hi) in open_.items():
            yield t, item, lo, hi


def cut_pieces(batches: Iterable[pa.RecordBatch], piece_words: int) -> Iterator[pa.RecordBatch]:
    """(item, words, text): lower-cased words joined by blanks; pieces of one item overlap by all but one word of a window."""
    table, lower, step = is_alphanumeric(), lower_ascii(), piece_words - ITEM_WINDOW + 1
    for rows, data, offsets in slices(batches):
        words = scan(data, offsets, table, lower)
        out: list[tuple[str, int, str]] = []
        for item, a, b in zip(rows.column("item").to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            for k in range(a, max(a + 1, b - ITEM_WINDOW + 1) if b > a else a, step):
                part = [words.word(j) for j in range(k, min(k + piece_words, b))]
                out.append((item, len(part), b" ".join(part).decode()))
        items, sizes, texts = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string())], ["item", "words", "text"])


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, block_bytes: int = BLOCK_BYTES, piece_words: int = PIECE_WORDS) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's pieces, as many at a time as a block holds."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    pieces = cut(map_arrow(items, lambda batches: cut_pieces(batches, piece_words), "item string, words int, text string").distinct())
    held, n, size = [], 0, 0
    for item, words, text in pieces.toLocalIterator():
        held.append((item, text.encode()))
        n, size = n + words, size + len(held[-1][1])
        if n >= block_words or size >= block_bytes:
            yield held
            held, n, size = [], 0, 0
    if held:
        yield held


def find(batches: Iterable[pa.RecordBatch], block, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    block, table, lower = block.value, is_alphanumeric(), lower_ascii()
    for rows, data, offsets in slices(batches):
        words = scan(data, offsets, table, lower)
        found = [list(x) if x else [] for x in rows.column("found").to_pylist()]
        for text, item, lo, hi in block.matches(words):
            start = int(words.first[text])
            found[text].append({"item": block.ids[item], "lo": lo - start, "hi": hi - start})
        columns = [pa.array(np.diff(words.first), pa.int64()) if c == "n_words" else pa.array(found, schema.field("found").type) if c == "found" else rows.column(c) for c in schema.names]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, n_words, found: an (item, first word, end word) for every span of windows shared with an item."""
    spark = docs.sparkSession
    found = pa.list_(pa.struct([("item", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("found", found)])
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(FOUND.split(" ", 1)[1]).alias("found"))
    some = blocks(benchmark, item_col, item_text_col, block_words)
    for items in itertools.chain([next(some, [])], some):  # at least one pass, which counts words
        sent = spark.sparkContext.broadcast(Block(items))
        out = map_arrow(out, lambda batches, sent=sent: find(batches, sent, schema), f"doc_id long, text string, n_words long, {FOUND}")
    return out


def covered(found: list[dict]) -> int:
    """Words in the union of the spans."""
    n, end = 0, 0
    for lo, hi in sorted((x["lo"], x["hi"]) for x in found):
        n += max(0, hi - max(lo, end))
        end = max(end, hi)
    return n


def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column("found").to_pylist()
        hit = [covered(x or []) for x in found]
        items = [sorted({y["item"] for y in x or []}) for x in found]
        sums = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sums, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())], names)


def contamination_digest(found: DataFrame) -> DataFrame:
    return map_arrow(found.select("doc_id", "n_words", "found"), digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_hits(batches: Iterable[pa.RecordBatch], block, text_col: str) -> Iterator[pa.RecordBatch]:
    block, table, lower = block.value, is_alphanumeric(), lower_ascii()
    for rows, data, offsets in slices(batches, text_col):
        keep = np.ones(len(rows), bool)
        for text, *_ in block.matches(scan(data, offsets, table, lower)):
            keep[text] = False
        yield rows.filter(pa.array(keep))


def contaminated_out(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without hits, with all their columns."""
    out = docs
    for items in blocks(benchmark, item_col, item_text_col, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(Block(items))
        out = map_arrow(out, lambda batches, sent=sent: without_hits(batches, sent, text_col), docs.schema)
    return out
