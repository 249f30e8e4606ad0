"""Index files of the binary layout, read in parallel by ranges of buckets.

Layout, little-endian: five bytes of magic; w, k, map_size, max_occ, number of keys as u32; for each
bucket the number of keys in buckets up to it, u32; keys, u64 (position in bits 0-31, target 32-41,
strand 42, seed id above); number of targets, u32; for each a length byte, a name, a u32 length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from ..operators.index import SeedIndex
from ..params import IndexParams

#: Fixed values of the format.
MAGIC, HEADER = b"ALOHA", struct.Struct("<5I")
#: Buckets of one task at most; keys read at a time.
BUCKETS, KEYS = 1 << 22, 1 << 20


def read_at(uri: str, at: int, n: int) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(n, at)


def read_sfi(spark: SparkSession, uri: str) -> SeedIndex:
    """Index in an .sfi file. The driver reads the header and the targets' names; tasks read keys."""
    head = read_at(uri, 0, len(MAGIC) + HEADER.size)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError(f"{uri} is not an index file")
    w, k, bits, max_occ, n_keys = HEADER.unpack(head[len(MAGIC) :])
    map_at = len(MAGIC) + HEADER.size
    keys_at = map_at + 4 * (1 << bits)
    fs, path = pafs.FileSystem.from_uri(uri)
    names_at = keys_at + 8 * n_keys
    tail, at, targets = read_at(uri, names_at, fs.get_file_info(path).size - names_at), 4, []
    for i in range(struct.unpack_from("<I", tail)[0]):
        end = at + 1 + tail[at]
        targets.append((i, tail[at + 1 : end].decode(), struct.unpack_from("<I", tail, end)[0]))
        at = end + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                first = b * BUCKETS
                n = min(BUCKETS, (1 << bits) - first)
                ends = np.frombuffer(read_at(uri, map_at + 4 * first, 4 * n), np.uint32).astype(np.int64)
                begin = int(np.frombuffer(read_at(uri, map_at + 4 * (first - 1), 4), np.uint32)[0]) if first else 0
                for x in range(begin, int(ends[-1]), KEYS):
                    word = np.frombuffer(read_at(uri, keys_at + 8 * x, 8 * min(KEYS, int(ends[-1]) - x)), np.uint64)
                    bucket = np.searchsorted(ends, np.arange(x, x + len(word)), side="right") + first
                    h = (word >> np.uint64(43) << np.uint64(bits)).astype(np.int64) + bucket
                    part = lambda shift, mask, word=word: pa.array((word >> np.uint64(shift) & np.uint64(mask)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(h), part(32, 1023), part(0, 0x7FFFFFFF), part(42, 1)], names=["hash", "chrom_id", "loc", "str"])

    tasks = -(-(1 << bits) // BUCKETS)
    keys = spark.range(0, tasks, 1, tasks).mapInArrow(run, "hash bigint, chrom_id int, loc int, str int")
    return SeedIndex(keys, spark.createDataFrame(targets, "chrom_id int, name string, len int"), IndexParams(w, k, bits, max_occ))
