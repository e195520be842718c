"""Toxicity by class-conditional Kneser-Ney character models with shared backoff counts.

Text is lower-cased, letters are symbols of an alphabet of 255, everything else is one blank; a history doesn't reach beyond its word.
With N(hw) the counts of both classes together, N_c(hw) those of class c, and T(h) the number of different symbols that follow
h, the probability of a symbol w after its six predecessors h is, for both classes c,

    p_c(w | h) = (1 - g(h)) * q_c(w | h) + g(h) * p(w | h'),    g(h) = D * T(h) / N(h),
    q_c(w | h) = (N_c(hw) + S * r(w | h)) / (N_c(h) + S),       r(w | h) = max(N(hw) - D, 0) / (N(h) - D * T(h)),

with h' the history less its first symbol and p(w | h') the interpolated Kneser-Ney distribution of the
continuation counts of both classes together (p_c(w | h) = p(w | h') where nobody has seen h).  So the classes share
their backoff counts: a rare expression that no labelled text has costs both the same, whatever they know of its history,
and one that is known only to one class is held against the pooled distribution r, which enters with S
observations.  The counts come from every labelled row that is not held out.

Counting runs over whole texts, n-grams are combined per partition before the shuffle, and all Kneser-Ney sums are
aggregates over the table of distinct n-grams.  What a scorer needs of it is log p_toxic - log p_ordinary of the
7-grams that were seen (``Ratios``, found exactly); that of all others is 0 by the formula, not by default.  The table grows
with the distinct n-grams, so beyond BROADCAST_GRAMS it isn't broadcast: each text's n-grams are joined with it by a shuffle.

A toxic document is ordinary prose with toxic expressions: each word is toxic with a chance of EXPRESSIONS.  With d_w the
difference of a word's two log-likelihoods, the document's is the sum of log(1 - E + E * exp(d_w)), normalised by the
square root of its number of words.  A logistic fit of that one number puts it on a probability scale (toxic rows count
MISS_COST times); it is made on a sample of labelled rows (about CALIBRATION_ROWS), scored by class counts that leave the sample out.

Defined results: texts that are null, empty or without letters get the share of toxic labels as
score; labels that are null or not 0/1, or belong to no document, are ignored, of repeated labels
the highest counts; without usable labels of both classes every score is that share (0 if there are
no labels); rows with null ids are scored, never learned from; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from blockloom.llm.shared import cut, fold, map_arrow

ORDER = 7
SYMBOL_BITS = 8
DISCOUNT = 0.75
#: S: what the shared distribution weighs, in observations.
SHARED_WEIGHT = 10.0
#: E: the chance that a word of a toxic document is a toxic expression.
EXPRESSIONS = 0.01
#: Up to so many distinct n-grams are broadcast (12 bytes each and up to 16 of the index); more are joined by a shuffle.
BROADCAST_GRAMS = 8_000_000
#: A toxic document that is missed weighs as much as so many ordinary ones that are flagged.
MISS_COST = 3.0
#: The bound on the sample for the logistic fit: so many rows and, by chance, up to 5 % more.
CALIBRATION_ROWS = 20_000
#: Up to so many labels are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 500_000
SLICE_CHARS = 1 << 18
#: Distinct n-grams that a counting task holds before it hands them on.
HELD_GRAMS = 1 << 18
_HASH = np.uint64(0x9E3779B97F4A7C15)


def symbol_table() -> np.ndarray:
    """Code point to symbol: 0 for all but letters; letters beyond Latin-1 share 96 symbols that have no letter there."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x30000):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low if low < 256 else 1 + low % 96
    return out


_SYMBOLS: list[np.ndarray] = []


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each between two blanks, with blanks in a row made one; the place at which each text starts (a blank)."""
    if not _SYMBOLS:
        _SYMBOLS.append(symbol_table())
    raw = np.frombuffer("".join(f"\0{t}\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])
    s = _SYMBOLS[0][raw]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    keep[starts[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], at[np.minimum(starts, len(s))]


def gram_keys(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 7-gram that ends at each symbol; what lies before the symbol's word counts as blank.

    A blank's own 7-gram is the end of the word before it; the blank that starts a text has none (0).
    """
    n = len(s)
    key, places = np.zeros(n, np.uint64), np.arange(n)
    last_blank = np.maximum.accumulate(np.where(s == 0, places, -1))
    began = np.concatenate([[-1], last_blank[:-1]])[:n]  # the blank before a symbol's word, also for the blank after it
    inside = places - began
    for back in range(min(ORDER, n)):
        shifted = s[: n - back].astype(np.uint64) << np.uint64(SYMBOL_BITS * back)
        if back:
            shifted[inside[back:] <= back] = 0
        key[back:] |= shifted
    key[starts[:-1]] = 0
    return key


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        at, texts, size = 0, [], 0
        for k, x in enumerate(batch.column("text")):
            text = x.as_py() or ""
            if texts and size + len(text) > limit:
                yield batch.slice(at, k - at), texts
                at, texts, size = k, [], 0
            texts.append(text)
            size += len(text)
        if texts:
            yield batch.slice(at), texts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.concatenate([c for _, c in parts])
    return keys, np.stack([np.bincount(back, counts[:, j], len(keys)).astype(np.int64) for j in range(counts.shape[1])], axis=1)


def count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, rest, sample) with the task's sums over its labelled texts, those of the sample apart: ordinary ones in the low 32 bits, toxic ones above."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def out() -> pa.RecordBatch:
        keys, sums = parts[0]
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(sums[:, j] | (sums[:, j + 1] << 32)) for j in (0, 2))], ["gram", "rest", "sample"])

    for rows, texts in text_slices(batches):
        s, starts = symbols(texts)
        key = gram_keys(s, starts)
        kind = rows.column("label").to_numpy(zero_copy_only=False) + 2 * rows.column("sampled").to_numpy(zero_copy_only=False)
        kind = np.repeat(kind, np.diff(starts))
        for c in range(4):
            keys, n = np.unique(key[(kind == c) & (key != 0)], return_counts=True)
            if len(keys):
                counts = np.zeros((len(keys), 4), np.int64)
                counts[:, c] = n
                parts.append((keys, counts))
                held += len(keys)
        if held > 4 * HELD_GRAMS:
            parts = [merged(parts)]
            held = len(parts[0][0])
            if held > HELD_GRAMS:
                yield out()
                parts, held = [], 0
    if parts:
        parts = [merged(parts)]
        yield out()


def shorter(grams: DataFrame, order: int, n: str) -> DataFrame:
    """p(last symbol | history) of n-grams of ``order`` symbols, from counts in column ``n``; lower orders use continuation counts."""
    mask = (1 << (SYMBOL_BITS * (order - 1))) - 1
    if order == 1:
        total, size = grams.agg(F.sum(n), F.count("*")).first()
        return grams.select("gram", ((F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + DISCOUNT * (size or 1) / (1 << SYMBOL_BITS)) / float(total or 1)).alias("p"))
    below = grams.groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count("*").alias("c"))
    low = shorter(cut(below), order - 1, "c").select(F.col("gram").alias("low"), F.col("p").alias("p_low"))
    history = F.shiftrightunsigned("gram", SYMBOL_BITS)
    of = grams.groupBy(history.alias("history")).agg(F.sum(n).alias("of_history"), F.count("*").alias("types"))
    both = grams.select("gram", n, history.alias("history"), F.col("gram").bitwiseAND(mask).alias("low")).join(of, "history").join(low, "low")
    p = (F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * F.col("p_low")) / F.col("of_history")
    return both.select("gram", p.alias("p"))


LOW = (1 << (SYMBOL_BITS * (ORDER - 1))) - 1


def backoff(grams: DataFrame) -> DataFrame:
    """(low, p_low): p(w | h') of the 7-grams' last six symbols."""
    below = grams.groupBy(F.col("gram").bitwiseAND(LOW).alias("gram")).agg(F.count("*").alias("c"))
    return shorter(cut(below), ORDER - 1, "c").select(F.col("gram").alias("low"), F.col("p").alias("p_low"))


def log_ratios(grams: DataFrame, lower: DataFrame) -> DataFrame:
    """(gram, ratio): log p_toxic - log p_ordinary of every 7-gram with counts (gram, ordinary, toxic)."""
    n, history, low = F.col("ordinary") + F.col("toxic"), F.shiftrightunsigned("gram", SYMBOL_BITS), F.col("gram").bitwiseAND(LOW)
    grams = grams.where(n > 0)
    of = grams.groupBy(history.alias("history")).agg(F.sum("ordinary").alias("n_ordinary"), F.sum("toxic").alias("n_toxic"), F.count("*").alias("types"))
    both = grams.withColumns({"history": history, "low": low}).join(of, "history").join(lower, "low")
    total = F.col("n_ordinary") + F.col("n_toxic")
    back = DISCOUNT * F.col("types") / total
    pooled = (n - DISCOUNT) / (total - DISCOUNT * F.col("types"))
    log_p = {c: F.log((1 - back) * (F.col(c) + SHARED_WEIGHT * pooled) / (F.col(f"n_{c}") + SHARED_WEIGHT) + back * F.col("p_low")) for c in ("ordinary", "toxic")}
    return both.select("gram", (log_p["toxic"] - log_p["ordinary"]).cast("float").alias("ratio"))


class Ratios:
    """Exact n-grams and their log-ratios, sorted by hash, with the start of each of at least twice as many buckets."""

    def __init__(self, grams: np.ndarray, ratios: np.ndarray) -> None:
        bits = max(1, int(2 * len(grams)).bit_length())
        hashes = grams.view(np.uint64) * _HASH  # an odd factor: no two n-grams share one
        order = np.argsort(hashes)
        self.shift = np.uint64(64 - bits)
        self.hashes, self.ratios = hashes[order], ratios[order].astype(np.float32)
        ends = np.cumsum(np.bincount((self.hashes >> self.shift).astype(np.int64), minlength=1 << bits))
        self.start = np.concatenate([[0], ends]).astype(np.int32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The log-ratio of each n-gram, 0 for those that aren't in the table."""
        out = np.zeros(len(keys), np.float32)
        hashes = keys * _HASH
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end, hashes = at[left], end[left], hashes[left]
        while len(left):
            hit = self.hashes[at] == hashes
            out[left[hit]] = self.ratios[at[hit]]
            more = ~hit & (at + 1 < end)
            left, at, end, hashes = left[more], at[more] + 1, end[more], hashes[more]
        return out


def score_table(ratios: DataFrame) -> Ratios:
    got = ratios.select("gram", F.col("ratio").cast("float").alias("ratio")).toArrow().combine_chunks()
    return Ratios(got.column("gram").to_numpy(), got.column("ratio").to_numpy())


def text_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__row, gram): the distinct n-grams of each text."""
    for rows, texts in text_slices(batches):
        s, starts = symbols(texts)
        key = gram_keys(s, starts)
        found = [np.unique(key[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        names = np.repeat(rows.column("__row").to_numpy(), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate(found).view(np.int64))], ["__row", "gram"])


def with_own(rows: DataFrame, ratios: DataFrame | None) -> DataFrame:
    """With a table that is not broadcast, the n-grams of a text that are in it are a column of the row."""
    if ratios is None:
        return rows
    keyed = rows.withColumn("__row", F.xxhash64("text"))
    grams = map_arrow(keyed.where("text is not null").select("__row", "text").distinct(), text_grams, "__row long, gram long")
    own = grams.join(ratios, "gram").groupBy("__row").agg(F.collect_list("gram").alias("__grams"), F.collect_list("ratio").alias("__ratios"))
    return keyed.join(own, "__row", "left").drop("__row")


def table_of(rows: pa.RecordBatch, sent) -> Ratios:
    """The broadcast table, or that of the rows' own n-grams."""
    if sent is not None:
        return sent
    empty = pa.array([], pa.int64()), pa.array([], pa.float32())
    grams, ratios = (rows.column(c).flatten() if rows.num_rows else e for c, e in zip(("__grams", "__ratios"), empty, strict=True))
    grams, first = np.unique(grams.to_numpy(), return_index=True)
    return Ratios(grams, ratios.to_numpy()[first])


def judged(texts: list[str], table: Ratios) -> tuple[np.ndarray, np.ndarray]:
    """Per text the length-normalised difference of its log-likelihoods, and its number of words."""
    s, starts = symbols(texts)
    ratio = table.of(gram_keys(s, starts))
    ratio[starts[:-1]] = 0
    sums = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
    begins = np.flatnonzero((s[:-1] == 0) & (s[1:] != 0)) + 1
    ends = np.flatnonzero((s[1:] == 0) & (s[:-1] != 0)) + 1  # the blank after a word is scored with it
    first = np.searchsorted(begins, starts)
    word = np.log1p(EXPRESSIONS * np.expm1(np.clip(sums[ends + 1] - sums[begins], -50, 50)))
    n = np.diff(first)
    total = np.concatenate([[0.0], np.cumsum(word)])
    return (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(n, 1)), n


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method on standardised columns; weights for the columns as they are, with the constant last."""
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def score_texts(batches: Iterable[pa.RecordBatch], model, names: list[str]) -> Iterator[pa.RecordBatch]:
    table, weights, prior = model.value
    for rows, texts in text_slices(batches):
        x, n = judged(texts, table_of(rows, table))
        score = np.where(n > 0, 1 / (1 + np.exp(-np.clip(x * weights[0] + weights[1], -50, 50))), prior)
        own = {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}
        yield pa.RecordBatch.from_arrays([own[c] if c in own else rows.column(c) for c in names], names)


def raw_scores(batches: Iterable[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    for rows, texts in text_slices(batches):
        x, n = judged(texts, table_of(rows, table.value))
        yield pa.RecordBatch.from_arrays([rows.column("label").cast(pa.int32()), pa.array(n, pa.int64()), pa.array(x)], ["label", "words", "difference"])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(doc_id, text, fold, label) of the rows to learn from: fold 0 is held out, its labels are dropped here."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = cut(known.withColumn("fold", fold(F.col("doc_id"))).where("fold != 0"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.join(F.broadcast(known) if known.count() <= BROADCAST_LABELS else known, "doc_id")


def sent_ratios(grams: DataFrame, lower: DataFrame):
    """The broadcast table of n-grams (None if there are too many), and the log-ratios if they are too many for it."""
    ratios = log_ratios(grams, lower)
    far = cut(ratios) if grams.count() > BROADCAST_GRAMS else None
    return (score_table(ratios) if far is None else None), far


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", calibration_rows: int = CALIBRATION_ROWS):
    """A broadcast (table, weights, prior), and the log-ratios if they are too many for it (its table is None then)."""
    spark = docs.sparkSession
    rows = labelled(docs, labels, id_col, text_col, label_col)
    n = rows.where("fold = 1").select("doc_id").count()
    sampled = F.col("fold") == 1
    if n > calibration_rows:  # those of smallest hash, about as many
        share = min(1.0, (calibration_rows + 6 * calibration_rows**0.5) / n)
        sampled &= F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = rows.withColumn("sampled", sampled.cast("int"))
    counted = map_arrow(rows.select("text", "label", "sampled"), count_grams, "gram long, rest long, sample long")
    ordinary, toxic = (lambda c: F.sum(F.col(c).bitwiseAND((1 << 32) - 1))), (lambda c: F.sum(F.shiftright(c, 32)))
    sums = counted.groupBy("gram").agg(ordinary("rest").alias("ordinary"), toxic("rest").alias("toxic"), ordinary("sample").alias("more_ordinary"), toxic("sample").alias("more_toxic"))
    grams = cut(sums)
    lower = cut(backoff(grams))

    table, far = sent_ratios(grams.select("gram", "ordinary", "toxic"), lower)
    sent = spark.sparkContext.broadcast(table)
    seen = map_arrow(with_own(rows.where("sampled = 1").select("text", "label"), far), lambda batches: raw_scores(batches, sent), "label int, words long, difference double").toPandas()
    sent.unpersist()
    y = seen["label"].to_numpy(float)
    prior = float(y.mean()) if len(y) else 0.0
    seen = seen[seen["words"] > 0]
    y = seen["label"].to_numpy(float)
    if len(set(y)) == 2:
        weights = logistic_fit(seen[["difference"]].to_numpy(float), y) + [0.0, np.log(MISS_COST)]
    else:
        odds = min(max(prior, 1e-6), 1 - 1e-6)
        weights = np.array([0.0, np.log(odds / (1 - odds))])

    every = grams.select("gram", (F.col("ordinary") + F.col("more_ordinary")).alias("ordinary"), (F.col("toxic") + F.col("more_toxic")).alias("toxic"))
    table, far = sent_ratios(every, lower)
    return spark.sparkContext.broadcast((table, weights, prior)), far


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    model, far = fit(docs, labels, id_col, text_col, label_col)
    names = ["doc_id", "held_out", "score", "predicted"]
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col).cast("long")) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return map_arrow(with_own(plain, far), lambda batches: score_texts(batches, model, names), "doc_id long, held_out boolean, score double, predicted int")


def keep_ordinary(batches: Iterable[pa.RecordBatch], model, names: list[str]) -> Iterator[pa.RecordBatch]:
    table, weights, prior = model.value
    for rows, texts in text_slices(batches):
        x, n = judged(texts, table_of(rows, table))
        yield rows.select(names).filter(pa.array(np.where(n > 0, x * weights[0] + weights[1] < 0, prior < 0.5)))


def toxic_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (columns doc_id, text and any others) that are not predicted to be toxic."""
    model, far = fit(docs, labels)
    names = docs.columns
    return map_arrow(with_own(docs, far), lambda batches: keep_ordinary(batches, model, names), docs.schema)
