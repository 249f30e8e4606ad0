"""An index's keys as sorted arrays in the shared folder, which the tasks that cut reads into seeds look up themselves.

Mapping a collection onto itself makes dozens of anchors for each seed. Here no anchor goes through a
shuffle or a table: keys are dealt by their hash's lowest bits into buckets of bounded size, once, a file
for each, and a task maps these files into memory and meets its reads' seeds with them, some reads at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as fn
from ..shared import load_arrays, save_arrays, shared_path, written

#: Keys of a bucket, on average at most; one task sorts them.
KEYS = 1 << 22


@dataclass(frozen=True)
class Postings:
    """Folder of the buckets, how many of a hash's lowest bits name one, and the buckets that have keys."""

    folder: str
    bits: int
    some: frozenset


def mountable(folder: str) -> bool:
    """Whether workers see the folder as files."""
    return folder.startswith("file:") or "://" not in folder


def saved(keys: DataFrame, per_bucket: int = KEYS) -> Postings | None:
    """Postings of (hash, chrom_id, loc, str); None where the shared folder is in a store that cannot be mapped."""
    folder = shared_path(keys.sparkSession, "postings")
    if not mountable(folder):
        return None
    bits = (max(0, keys.count() - 1) // per_bucket).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        h, chrom, loc = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in range(3))
        rows.clear()
        of = h & (1 << bits) - 1
        for bucket in np.unique(of).tolist():
            own = np.flatnonzero(of == bucket)
            own = own[np.argsort(h[own])]
            hashes, begin = np.unique(h[own], return_index=True)
            t = chrom[own]
            small = -(1 << 31) <= t.min() and t.max() < 1 << 31
            save_arrays(folder, str(bucket), [hashes, np.append(begin, len(own)).astype(np.int32), t.astype(np.int32) if small else t, loc[own]])
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "n": pa.array([len(own)], pa.int64())})

    rows = keys.select("hash", F.col("chrom_id").cast("bigint").alias("chrom_id"), (F.shiftleft("loc", 1).bitwiseOR(F.col("str"))).cast("int").alias("at"))
    dealt = rows.repartitionById(1 << bits, F.col("hash").bitwiseAND((1 << bits) - 1).cast("int"))
    done = written(dealt.mapInArrow(run, "bucket bigint, n bigint"), "buckets")
    return Postings(folder, bits, frozenset(r.bucket for r in done.collect()))


class Reader:
    """Looks hashes up in a task."""

    def __init__(self, postings: Postings) -> None:
        self.postings, self.held = postings, {}

    def bucket(self, n: int) -> list[np.ndarray]:
        if n not in self.held:
            hashes, begin, chrom, loc = load_arrays(self.postings.folder, str(n))
            loc = loc.view(np.int32)
            wide = len(chrom) > len(loc) * 4
            self.held[n] = [hashes.view(np.int64), begin.view(np.int32), chrom.view(np.int64 if wide else np.int32), loc]
        return self.held[n]

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, first key, keys) of each hash."""
        of = h & (1 << self.postings.bits) - 1
        begin, n = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        order = np.lexsort((h, of))
        for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(h) else []:
            if int(of[own[0]]) not in self.postings.some:
                continue
            hashes, start, _, _ = self.bucket(int(of[own[0]]))
            at = np.minimum(np.searchsorted(hashes, h[own]), len(hashes) - 1)
            begin[own] = start[at]
            n[own] = np.where(hashes[at] == h[own], start[at + 1] - start[at], 0)
        return of, begin, n

    def keys(self, of: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, chrom_id, loc and strand) of all keys of what ``found`` says of some hashes."""
        order = np.argsort(of, kind="stable")
        which, chroms, locs = [], [], []
        for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(of) else []:
            _, _, chrom, loc = self.bucket(int(of[own[0]]))
            size = n[own]
            at = np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            which.append(np.repeat(own, size))
            chroms.append(chrom[at].astype(np.int64))
            locs.append(loc[at])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, chroms, locs))


def in_order(line: np.ndarray, chrom: np.ndarray, diag: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns in order of (line, chrom, diag, q): by one number that holds all four, where 64 bits do."""
    names = None
    for dense in (False, True):
        if dense:
            names, chrom = np.unique(chrom, return_inverse=True)
        parts = (line, chrom, diag, q)
        low = [int(x.min()) for x in parts]
        bits = [int(x.max() - a).bit_length() for x, a in zip(parts, low, strict=True)]
        if sum(bits) > 64:
            continue
        key = np.zeros(len(q), np.uint64)
        for x, a, b in zip(parts, low, bits, strict=True):
            key = key << np.uint64(b) | (x - a).astype(np.uint64) if b else key
        key.sort()
        out = []
        for a, b in zip(low[::-1], bits[::-1], strict=True):
            out.append((key & np.uint64((1 << b) - 1)).astype(np.int64) + a)
            key >>= np.uint64(b)
        line, chrom, diag, q = out[::-1]
        return line, chrom if names is None else names[chrom], diag, q
    order = np.lexsort((q, diag, chrom, line))
    return line[order], names[chrom[order]], diag[order], q[order]


def anchors_of(which: np.ndarray, chrom: np.ndarray, at: np.ndarray, read: np.ndarray, q: np.ndarray, strand: np.ndarray) -> tuple[np.ndarray, ...]:
    """(line, chrom, diag, q) in order, of keys met with seeds (read, q, strand); line: twice the read and the strand."""
    turned, q = strand[which] ^ at & 1, q[which]
    loc = (at >> 1).astype(np.int64)
    return in_order(2 * read[which] + turned, chrom, np.where(turned == 1, loc + q, loc - q + fn.DIAGONAL), q)
