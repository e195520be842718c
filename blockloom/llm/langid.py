"""Language identification with hyperdimensional profiles.

Each symbol (any letter in lower case, or one blank for everything else) has a random vector of its own, of +1 and -1 in
DIMENSIONS dimensions.  A trigram's vector binds them: the first symbol's vector rotated by two
places, the second's by one and the third's as it is, multiplied component by component.  A text's
vector bundles (adds) its trigrams' vectors; a language's prototype bundles the unit vectors of its
training texts.  A text gets the language whose prototype, less the mean of all prototypes, has the
largest cosine with the text's unit vector, less the same mean.

Training takes about FIT_ROWS labelled rows outside fold 0 (a bounded sample, chosen by a hash of
id and text); its sums are added per task and then per language and dimension, so what reaches the
driver is one vector for each language.  Whole texts count, in training and in prediction.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text
if nothing could be learned; rows with null ids or null languages are never learned from; equally
close languages are taken in code-point order; repeated rows are predicted one by one; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from blockloom.llm.shared import fold, map_arrow
from blockloom.llm.textscan import mixed, slices

DIMENSIONS = 1024
#: The bound on the training sample: about so many rows.
FIT_ROWS = 20_000
#: Trigram vectors that a worker keeps; beyond, they are made anew for each text.
KEPT_GRAMS = 1 << 16
#: Makes cosines into a probability scale (softmax).
SHARPNESS = 25.0
UNKNOWN = "und"


@functools.cache
def symbol_table() -> np.ndarray:
    """Code point to symbol: 0 for all but letters, for those the code point of the lower-case letter."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


@functools.cache
def symbol_vectors() -> np.ndarray:
    """Those of the blank and the letters of Latin-1."""
    return (np.random.default_rng(40961).integers(0, 2, (256, DIMENSIONS), np.int8) * 2 - 1).astype(np.int8)


def vectors_of(symbols: np.ndarray) -> np.ndarray:
    """The vectors of any symbols; beyond Latin-1 they are bits of a 64-bit mix of the code point."""
    out = symbol_vectors()[symbols & 255]
    wide = np.flatnonzero(symbols > 255)
    if len(wide):
        words = DIMENSIONS // 64
        bits = mixed(mixed(symbols[wide].astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)) + np.uint64(40961))
        out[wide] = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1
    return out


def bound(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    return np.roll(vectors_of(first), 2, axis=1) * np.roll(vectors_of(second), 1, axis=1) * vectors_of(third)


class Grams:
    """Vectors of trigrams of Latin-1, made when first seen.  Codes: three symbols of 8 bits."""

    def __init__(self) -> None:
        self.row = np.zeros(1 << 24, np.int32)  # 1 + place; pages that no trigram touches stay unmapped
        self.vectors = np.zeros((1024, DIMENSIONS), np.int8)
        self.n = 0

    @staticmethod
    def bind(codes: np.ndarray) -> np.ndarray:
        return bound(codes >> 16, (codes >> 8) & 255, codes & 255)

    def of(self, codes: np.ndarray) -> np.ndarray:
        at = self.row[codes]
        new = codes[at == 0]
        if len(new):
            if self.n + len(new) > KEPT_GRAMS:
                return self.bind(codes)
            while self.n + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[self.n : self.n + len(new)] = self.bind(new)
            self.row[new] = np.arange(self.n + 1, self.n + len(new) + 1)
            self.n += len(new)
            at = self.row[codes]
        return self.vectors[at - 1]


@functools.cache
def grams() -> Grams:
    """One for each worker process."""
    return Grams()


def bundle(text: str) -> np.ndarray | None:
    """The unit vector of a text; None if it has no letter."""
    s = symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate([[0], s, [0]]).astype(np.int64)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    if not s.any():
        return None
    s = np.concatenate([s, [0]]) if len(s) < 3 else s
    codes, n = np.unique((s[:-2] << 42) | (s[1:-1] << 21) | s[2:], return_counts=True)
    out = np.zeros(DIMENSIONS, np.float32)
    three = codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF
    narrow = (three[0] | three[1] | three[2]) < 256
    latin = ((three[0] << 16) | (three[1] << 8) | three[2])[narrow]
    for k in range(0, len(latin), 8192):
        out += n[narrow][k : k + 8192].astype(np.float32) @ grams().of(latin[k : k + 8192]).astype(np.float32)
    first, second, third = (x[~narrow] for x in three)
    for k in range(0, len(first), 1024):
        out += n[~narrow][k : k + 1024].astype(np.float32) @ bound(first[k : k + 1024], second[k : k + 1024], third[k : k + 1024]).astype(np.float32)
    length = float(np.linalg.norm(out))
    return out / length if length else out


def texts_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[str]:
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield raw[a:b].decode()


def training_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, vector) sums of the task."""
    sums: dict[str, np.ndarray] = {}
    for rows, data, offsets in slices(batches):
        for lang, text in zip(rows.column("lang").to_pylist(), texts_of(data, offsets), strict=True):
            v = bundle(text)
            if v is not None:
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["lang", "vector"])


class Profiles:
    def __init__(self, sums: dict[str, np.ndarray]):
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
        self.langs = sorted(sums)
        prototypes = unit(np.stack([sums[x] for x in self.langs])) if sums else np.zeros((0, DIMENSIONS))
        self.mean = prototypes.mean(axis=0) if len(sums) > 1 else np.zeros(DIMENSIONS)
        self.prototypes = unit(prototypes - self.mean).astype(np.float32)

    def predict(self, text: str) -> tuple[str, float]:
        v = bundle(text) if self.langs else None
        if v is None:
            return UNKNOWN, 0.0
        v = v - self.mean
        cosines = self.prototypes @ v / max(float(np.linalg.norm(v)), 1e-12)
        best = int(np.argmax(cosines))
        return self.langs[best], float(1 / np.exp(SHARPNESS * (cosines - cosines[best])).sum())


def predict_batches(batches: Iterable[pa.RecordBatch], profiles) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        got = [profiles.value.predict(t) for t in texts_of(data, offsets)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS):
    """A broadcast Profiles, learned from about ``fit_rows`` labelled rows that are not held out."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col).cast("long")) != 0))
    n = known.select(id_col).count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(1 << 40)) < int(fit_rows / n * (1 << 40)))
    sums = map_arrow(known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), training_sums, "lang string, vector array<double>")
    by_place = sums.select("lang", F.posexplode("vector").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    vectors: dict[str, np.ndarray] = {}
    for lang, place, x in by_place.collect():
        vectors.setdefault(lang, np.zeros(DIMENSIONS))[place] = x
    return docs.sparkSession.sparkContext.broadcast(Profiles(vectors))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score."""
    profiles = fit(docs, id_col, text_col, lang_col)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col).cast("long")) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return map_arrow(plain, lambda batches: predict_batches(batches, profiles), "doc_id long, held_out boolean, lang_pred string, score double")
