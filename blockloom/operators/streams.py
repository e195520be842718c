"""Statistics and differences of whole byte streams, one Arrow pass: what leaves a stream is a few rows, never one for each byte."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def delta(data: np.ndarray) -> np.ndarray:
    """Differences modulo 256; the first byte stays."""
    return np.diff(data, prepend=np.uint8(0))


def undelta(data: np.ndarray) -> np.ndarray:
    return np.cumsum(data, dtype=np.uint8)


def counts(data: np.ndarray) -> np.ndarray:
    """(byte, count) of the bytes that occur."""
    n = np.bincount(data, minlength=256)
    at = np.flatnonzero(n)
    return np.stack([at, n[at]], axis=1)


def contexts(data: np.ndarray, kinds: int = 8, most: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """The stream's parts by the low bits of a byte, in order; kinds over ``most`` count as 0."""
    kind = data % kinds
    kind = np.where(kind > most, 0, kind)
    for k in np.unique(kind).tolist():
        yield k, data[kind == k]


def weighted(data: np.ndarray, period: int, start: int = 0) -> int:
    """Sum of the values times their place in a cycle."""
    return int((data.astype(np.int64) * ((np.arange(len(data)) + start) % period + 1)).sum())


def map_rows(streams: DataFrame, rows_of: Callable[[np.ndarray], Iterable[tuple[int, ...]]], names: list[str], key: str = "stream_id", content: str = "content") -> DataFrame:
    """(key, names): the rows of whole numbers that a function makes of each stream; null streams have none."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if raw is not None:
                    got = [tuple(r) for r in rows_of(np.frombuffer(raw, np.uint8))]
                    rows += got
                    keys += [k] * len(got)
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns)], [key, *names])

    return streams.select(key, content).mapInArrow(each, f"{key} {dict(streams.dtypes)[key]}, " + ", ".join(f"{n} long" for n in names))


def total_counts(streams: DataFrame, content: str = "content") -> DataFrame:
    """(b, n) over all streams; a task adds up its own first."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if raw is not None:
                    total += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["b", "n"])

    return streams.select(content).mapInArrow(each, "b long, n long").groupBy("b").sum("n").withColumnRenamed("sum(n)", "n").where("n > 0")
