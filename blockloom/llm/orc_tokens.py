"""Token ids as ORC files: run-length encoded integers, row indexes, Bloom filters on the ids.

``write_tokens`` range-partitions documents by id, encodes whole texts batch by batch and writes
one ORC file per partition, rows in ascending id order.  ORC's integer run-length encoding packs
the ids, its row index and its Bloom filter on ``doc_id`` let ``read_tokens`` skip stripes and row
groups, and a file is read stripe by stripe in parallel.  Each row holds the number of ids before
it within its file (``file_start``); the files' totals, one number each, turn that into global
positions.

Defined results: null text is encoded as empty and has the end id alone; null ids come first;
rows with equal ids are ordered by a hash of their text, equal rows are interchangeable; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from blockloom.llm.shared import map_arrow, new_path, partitions
from blockloom.llm.textscan import lower_ascii, slices

END_ID = 2
#: Entries of a worker's cache of encoded words, and the longest word in it.
CACHE_WORDS = 600_000
CACHE_CHARS = 48
#: Bytes of text that are encoded at once.
BATCH_BYTES = 4 << 20
SCHEMA = "doc_id long, part int, file_start long, n_tokens int, ids array<int>"


def byte_classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space, alnum, odd = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    alnum[0x30:0x3A] = alnum[0x41:0x5B] = alnum[0x61:0x7B] = True
    odd[0x1C:0x20] = odd[0xC4:] = True
    return space, alnum, odd


SPACE, ALNUM, ODD = byte_classes()
LOWER = lower_ascii()


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """(lower-cased words, index of each text's first word, which texts are odd).

    Words end at white space; a full stop or comma between a letter or digit and white space is a
    word of its own, as it is for the tokenizer.  Odd texts have characters beyond Latin-1, special
    tokens or separators that aren't white space to the tokenizer; they are to be encoded as a whole.
    """
    n = len(data)
    wide = np.zeros(n + 2, np.uint8)
    wide[1:-1] = data
    before, after = wide[:-2], wide[2:]
    at_start = np.zeros(n + 1, bool)
    at_start[offsets] = True
    bad = np.flatnonzero(ODD[data] | ((before == 0xC2) & (data == 0x85)) | ((data == 0x3C) & (after == 0x7C)))
    odd = np.diff(np.searchsorted(bad, offsets)) > 0
    low = LOWER[data]
    low += ((before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)).view(np.uint8) << 5
    gap = SPACE[data]
    blank = np.flatnonzero((data == 0xA0) & (before == 0xC2))  # a no-break space
    gap[blank] = gap[blank - 1] = True
    stop = np.flatnonzero((data == 0x2E) | (data == 0x2C))
    stop = stop[SPACE[after[stop]] & ~at_start[stop] & ~at_start[stop + 1]]
    last = before[stop]
    stop = stop[ALNUM[last] | ((last >= 0x80) & (last != 0x97) & (last != 0xB7) & (wide[stop - 1] == 0xC3))]
    kept = ~gap
    starts = kept.copy()
    starts[1:] &= gap[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    starts[cuts] = kept[cuts]
    starts[stop] = True
    place = np.flatnonzero(starts)
    at = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
    text = low[kept]
    words = pa.LargeStringArray.from_buffers(len(place), pa.py_buffer(np.append(at[place], len(text))), pa.py_buffer(text))
    return words, np.searchsorted(place, offsets), odd


#: The rules of a tokenizer file under which a text's ids are those of its words (fixed values).
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class Encoder:
    """Encodes texts with a tokenizer file of the ``tokenizers`` library, each distinct word once.

    A file with WORD_RULES, a BPE model with word ends and no added tokens but those in <| |> lower-cases, turns white space into
    single blanks and cuts there, so the ids of a text are the ids of its words in order; texts are encoded as a whole with any other file.  The library encodes the words that the cache hasn't;
    words of letters alone skip its normalizer and its regular expression, which leave them as they are.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.cache, self.cache_words = Tokenizer.from_file(path), {}, cache_words
        rules = json.loads(self.tokenizer.to_str())
        added = all(x["content"].startswith("<|") and not x["normalized"] and not x["lstrip"] and not x["rstrip"] for x in rules["added_tokens"])
        self.by_words = added and rules["model"].get("end_of_word_suffix") == "</w>" and {k: rules[k] for k in WORD_RULES} == WORD_RULES
        if not self.by_words:
            return
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.mark = int(self.direct("\x01")[0])

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def words(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        plain = [w for w in words if w.isalpha()]
        for k in range(0, len(plain), 5000):
            part = plain[k : k + 5000]
            ids = np.array(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends, raw = np.flatnonzero(self.ends[ids]) + 1, ids.tobytes()
            out.update(zip(part, [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], strict=True))
        rest = [w for w in words if not w.isalpha()]
        marked = [w for w in rest if "\x01" not in w]
        for k in range(0, len(marked), 5000):
            part = marked[k : k + 5000]
            ids = self.direct(" \x01 ".join(part) + " \x01")
            ends, raw = np.flatnonzero(ids == self.mark), ids.tobytes()
            out.update(zip(part, [raw[4 * a : 4 * b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True)], strict=True))
        out.update((w, self.direct(w).tobytes()) for w in rest if "\x01" in w)
        return out

    def known(self, distinct: list[str]) -> list[bytes]:
        own = self.cache.get
        out = [own(w) for w in distinct]
        new = [w for w, x in zip(distinct, out, strict=True) if x is None]
        if not new:
            return out
        if 2 * len(new) > len(distinct) and len(self.cache) >= self.cache_words:
            self.cache.clear()  # the texts have changed
        fresh = self.words(new)
        room = self.cache_words - len(self.cache)
        if room > 0:
            self.cache.update([(w, fresh[w]) for w in new[:room] if len(w) <= CACHE_CHARS])
        return [fresh[w] if x is None else x for w, x in zip(distinct, out, strict=True)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text; ``data``: UTF-8 bytes, ``offsets``: where texts start in it, and its end."""
        if not self.by_words:
            return [self.direct(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        words, first, odd = split_words(data, offsets)
        whole = {int(k): self.direct(data[offsets[k] : offsets[k + 1]].tobytes().decode()) for k in np.flatnonzero(odd)}
        if whole:
            use = np.ones(len(words), bool)
            for k in whole:
                use[first[k] : first[k + 1]] = False
            first = np.concatenate([[0], np.cumsum(use)])[first]
            words = words.filter(pa.array(use))
        coded = words.dictionary_encode()
        distinct = self.known(coded.dictionary.to_pylist())
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in distinct], dtype=np.int64)])
        taken = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(distinct), "<u4"))).take(coded.indices)
        flat, at = taken.values.to_numpy(), taken.offsets.to_numpy()[first]
        return [whole[k] if k in whole else flat[a:b] for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        raw = [x.encode() for x in texts]
        return self.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def encode_partition(batches: Iterable[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    coder, part, start = encoder(path), TaskContext.get().partitionId(), 0
    end = np.array([end_id], "<u4")
    for rows, data, offsets in slices(batches, limit=BATCH_BYTES):
        coded = coder.encode(data, offsets)
        lengths = np.array([len(x) + 1 for x in coded], np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.concatenate([y for x in coded for y in (x, end)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int32)))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(np.full(len(coded), part), pa.int32()), pa.array(start + ends[:-1]), pa.array(lengths, pa.int32()), ids], ["doc_id", "part", "file_start", "n_tokens", "ids"])
        start += int(ends[-1])


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", n_files: int | None = None, stripe_bytes: int = 16 << 20) -> None:
    n = n_files or partitions(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = plain.repartitionByRange(n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    coded = map_arrow(ordered, lambda batches: encode_partition(batches, tokenizer_path, end_id), SCHEMA)
    options = {"compression": "zstd", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    coded.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids); with ``doc_ids`` ORC's indexes and Bloom filters prune what is read."""
    files = spark.read.schema(SCHEMA).orc(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = files if doc_ids is None else files.where(F.col("doc_id").isin(doc_ids))
    # one row for each file: as bounded as the list of files that the driver holds anyway
    return rows.join(F.broadcast(totals), "part").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(tokens: DataFrame) -> DataFrame:
    return map_arrow(tokens, checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_and_read_back(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = path or new_path(spark, "orc_tokens")
    write_tokens(docs, path, tokenizer_path)
    return token_digest(read_tokens(spark, path))
