"""Counts of hashed values over all texts, by a fixed number of buckets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vexel.llm.words import U64, mix, text_chunks


def bucket(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix(values) >> U64(64 - bits)).astype(np.int64)


def bucket_counts(docs: DataFrame, values, bits: int) -> np.ndarray:
    """How many of values(texts), over the whole column text, fall into each of 2**bits buckets.

    Each task counts its texts, then slices of the counts are summed; the size of what is gathered is fixed.
    """
    width = min(bits, 14)
    slices = 1 << (bits - width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        held: list[np.ndarray] = []

        def add() -> None:
            found, counts = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
            total[found] += counts.astype(np.int32)
            held.clear()

        for batch in batches:
            for _, _, texts in text_chunks(batch, 0):
                held.append(bucket(values(texts), bits))
                if sum(map(len, held)) >= 1 << 20:
                    add()
        add()
        if total.any():
            packed = [zlib.compress(part.tobytes(), 1) for part in total.reshape(slices, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices, dtype=np.int32)), pa.array(packed, pa.binary())], names=["part", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(zlib.decompress(counts), np.int32)
                sums[part] = sums[part] + found if part in sums else found.astype(np.int64)
        packed = [zlib.compress(v.tobytes(), 1) for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])

    found = docs.select("text").mapInArrow(run, "part int, counts binary").repartition("part").mapInArrow(merge, "part int, counts binary")
    counts = np.zeros((slices, 1 << width), np.int64)
    for row in found.collect():
        counts[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return counts.ravel()
