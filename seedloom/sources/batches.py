"""Batches of reads under a capacity of bases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(lengths: np.ndarray, capacity: int, used: int, batch: int) -> tuple[np.ndarray, int, int]:
    """Batch numbers of the next reads of a stream, from what the current batch holds: a read that does not fit (each takes one base more than its length) opens the next batch; one beyond the capacity gets a batch to itself. Searches for each batch's end."""
    ends = np.cumsum(lengths + 1)
    out = np.empty(len(lengths), np.int64)
    at = before = 0
    while at < len(lengths):
        end = int(np.searchsorted(ends, capacity - used + before, side="right"))
        if end == at and used == 0:
            end = at + 1
        out[at:end] = batch
        if end == len(lengths):
            return out, used + int(ends[-1]) - before, batch
        before = int(ends[end - 1]) if end else 0
        at, used, batch = end, 0, batch + 1
    return out, used, batch


def batches(reads: DataFrame, capacity: int, stream: Column) -> DataFrame:
    """(stream, read_id, len, batch): greedy packing of each stream's reads in read order. Streams are packed apart, as files are.

    Where a batch begins depends on all before it, so a stream is read in order by one task, which holds no more of it than a batch of rows.
    """
    rows = reads.select(stream.alias("stream"), "read_id", F.col("len").cast("bigint").alias("len"))
    rows = rows.repartition("stream").sortWithinPartitions("stream", "read_id", "len")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, batch = None, 0, 0
        for part in parts:
            keys = part.column(0).to_pylist()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            lengths, out = part.column(2).to_numpy(), []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if last is None or keys[a] != last[0]:
                        last, used, batch = (keys[a],), 0, 0
                    got, used, batch = packed(lengths[a:b], capacity, used, batch)
                    out.append(got)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], names=["stream", "read_id", "len", "batch"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, batch bigint")
