"""Hashes that may be frequent, by a count-min sketch, so that only these are counted one by one.

A sketch has two rows of counters; a hash adds to one of each, named by its lowest and its highest bits,
and its least counter bounds how often it is there. Tasks count what they read and hand on counters, not
hashes; counters of a range are summed in one task as they come. The sketch is as large as the limit
asks for: with many counters for each hash that could be over it, few others are suspected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Counters of a row, as powers of two: at least, and at most (then a row is 16 MB); counters for each hash that could be over the limit; counters of a range; hashes gathered before they are counted.
LEAST, MOST, SPARE, RANGE_BITS, GATHER = 10, 23, 8, 10, 1 << 20


def row_bits(keys: int, limit: int, hash_bits: int) -> int | None:
    """Size of a row for so many keys; None if no size in bounds would tell much."""
    bits = max(LEAST, (SPARE * keys // max(1, limit)).bit_length())
    return min(bits, hash_bits) if bits <= MOST else None


def places(h: np.ndarray, bits: int, hash_bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h & (1 << bits) - 1, h >> max(0, hash_bits - bits)


def counters(keys: DataFrame, bits: int, hash_bits: int) -> np.ndarray:
    """The two rows of counters of (hash), up to 65535 each; not more than ``MOST`` says, so they may come to the driver."""
    span = 1 << min(bits, RANGE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, size = [np.zeros(1 << bits, np.uint32) for _ in range(2)], [], 0

        def add() -> None:
            h = np.concatenate(held)
            for row, at in zip(rows, places(h, bits, hash_bits), strict=True):
                row += np.bincount(at, minlength=len(row)).astype(np.uint32)

        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += batch.num_rows
            if size >= GATHER:
                add()
                held, size = [], 0
        if size:
            add()
        ranges = np.concatenate(rows).reshape(-1, span)
        some = np.flatnonzero(ranges.any(1))
        for a in range(0, len(some), 256):
            part = some[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([ranges[i].tobytes() for i in part.tolist()], pa.binary())], names=["range", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums.setdefault(r, np.zeros(span, np.int64))
                sums[r] += np.frombuffer(n.as_buffer(), np.uint32)
        for r, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.minimum(n, 65535).astype(np.uint16).tobytes()], pa.binary())], names=["range", "n"])

    found = keys.select("hash").mapInArrow(count, "range int, n binary").repartition("range").mapInArrow(total, "range int, n binary").toArrow()
    table = np.zeros((2 << bits) // span * span, np.uint16).reshape(-1, span)
    for r, n in zip(found["range"].to_pylist(), found["n"].to_pylist(), strict=True):
        table[r] = np.frombuffer(n, np.uint16)
    return table.reshape(2, -1)


def suspected(keys: DataFrame, limit: int, bits: int, hash_bits: int) -> DataFrame:
    """(hash): rows of ``keys`` whose hash may occur more than ``limit`` times; all of those that do are among them."""
    table = counters(keys, bits, hash_bits)
    most = min(limit, 65534)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = places(batch.column(0).to_numpy(), bits, hash_bits)
            over = (table[0][low] > most) & (table[1][high] > most)
            if over.any():
                yield batch.filter(pa.array(over))

    return keys.select("hash").mapInArrow(run, "hash bigint")
