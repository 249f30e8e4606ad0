"""Minimizers: the smallest canonical k-mer hash of each window of w k-mers.

Sequences are cut into blocks first, so that a chromosome is the work of many tasks. A block
overlaps its neighbours by one window and what windows reach over, and gives a seed where its
window picks another than the window before, so no seed comes twice and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as fn
from ..params import IndexParams
from .presence import may_hold

BLOCK = 1 << 18
#: Bases joined into one array at a time; as many as a core's cache holds.
CHUNK = 1 << 17
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
SEPARATOR = ord("N")


def blocks(seqs: DataFrame, p: IndexParams, size: int, carry: tuple[str, ...], every: bool = False) -> DataFrame:
    """(carry, start, lead, piece): windows from ``start`` on, ``size`` to a block; lead: the first is the last of the block before. every: sequences without a window have a block as well."""
    n = F.length("seq") - F.lit(p.w + p.k - 2)
    if every:
        seqs, n = seqs.withColumn("seq", F.coalesce("seq", F.lit(""))), F.greatest(n, F.lit(1))
    cut = seqs.filter(n > 0).select(*carry, "seq", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("b"))
    start = F.greatest(F.col("b") * size - 1, F.lit(0))
    lead = (F.col("b") > 0).cast("int")
    return cut.select(*carry, start.alias("start"), lead.alias("lead"), F.substr("seq", start + 1, lead + F.lit(size + p.w + p.k - 2)).alias("piece"))


def codes_table(dialect: str) -> np.ndarray:
    byte = np.arange(256)
    if dialect == "device":
        return np.where(byte == SEPARATOR, 7, byte >> 1 & 3).astype(np.uint8)
    return (byte >> 1 & 7).astype(np.uint8)


def mix(x: np.ndarray, k: int) -> np.ndarray:
    """``hash64`` on arrays."""
    u, mask = np.uint64, np.uint64((1 << 2 * k) - 1)
    x = (~x + (x << u(21))) & mask
    x ^= x >> u(24)
    x = (x * u(265)) & mask
    x ^= x >> u(14)
    x = (x * u(21)) & mask
    x ^= x >> u(28)
    return (x + (x << u(31))) & mask


def strings(letters: np.ndarray, k: int, first_low: bool) -> np.ndarray:
    """Numbers of the k-letter strings at each place, two bits a letter, put together from those of half the length; first_low: the first letter in the lowest bits."""
    n, out, size, part, span = len(letters) - k + 1, None, 0, letters, 1
    while True:
        if k & span:
            piece = part[size : size + n]
            if out is None:
                out = piece
            elif first_low:
                out = out | piece << np.uint64(2 * size)
            else:
                out = out << np.uint64(2 * span) | piece
            size += span
        if size == k:
            return out
        low, high = part[:-span], part[span:]
        part = low | high << np.uint64(2 * span) if first_low else low << np.uint64(2 * span) | high
        span *= 2


def least(key: np.ndarray, w: int) -> np.ndarray:
    """Minima of windows of ``w``, from those of half the width."""
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    return np.minimum(key[: len(key) - (w - span)], key[w - span :]) if span < w else key


def picks(codes: np.ndarray, p: IndexParams) -> tuple[np.ndarray, ...]:
    """(window, place, hash, strand) of the windows that pick another k-mer than the window before."""
    n = len(codes) - p.k + 1
    windows = n - p.w + 1
    if windows <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty
    base = (codes & 3).astype(np.uint64)
    forward, reverse = strings(base, p.k, False), strings(base ^ np.uint64(2), p.k, True)
    h = np.where(forward == reverse, NONE, mix(np.minimum(forward, reverse), p.k))
    bad = np.concatenate(([0], np.cumsum(codes >= 4)))
    clear = bad[p.w + p.k - 1 :] == bad[:windows]
    room = 64 - 2 * p.k
    if n < 1 << room:
        # hash and place in one number, so that the least is the pick
        at = np.arange(n, dtype=np.uint64)
        key = least(np.where(h == NONE, NONE, h << np.uint64(room) | (at if p.ties == "left" else np.uint64(n - 1) - at)), p.w)
        good = clear & (key != NONE)
        place = (key & np.uint64((1 << room) - 1)).astype(np.int64)
        place = place if p.ties == "left" else n - 1 - place
    else:
        best, place = h[:windows].copy(), np.arange(windows)
        for j in range(1, p.w):
            other = h[j : j + windows]
            take = other < best if p.ties == "left" else other <= best
            best[take] = other[take]
            place[take] = np.flatnonzero(take) + j
        good = clear & (best != NONE)
    again = np.concatenate(([False], good[:-1] & (place[1:] == place[:-1])))
    at = np.flatnonzero(good & ~again)
    chosen = place[at]
    return at, chosen, h[chosen], (forward > reverse)[chosen].astype(np.int64)


def minimizers(seqs: DataFrame, p: IndexParams, id_col: str, carry: tuple[str, ...] = (), within: np.ndarray | None = None, marks: bool = False) -> DataFrame:
    """(id, carry, hash, loc, str) of sequences (id, seq): loc is the place of the k-mer's last base from 0, str 1 if its reverse complement is the smaller.

    Windows with an ambiguous base give nothing, palindromes are never picked; null and short sequences
    have no seeds. ``within`` is a filter of hashes (``operators.presence``): seeds of others are left out
    where they are made. With ``marks``, ``carry`` is null beside seeds, and each sequence has a row of its
    own with it and no hash: so one pass over sequences leaves both.
    """
    table = codes_table(p.dialect)
    cols = (id_col, *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("piece")).to_numpy() + 1
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                joined = b"N".join(x.as_buffer() for x in rows.column("piece").cast(pa.binary()))
                window, place, h, strand = picks(table[np.frombuffer(joined, np.uint8)], p)
                begin = np.cumsum(sizes[a:b]) - sizes[a:b]
                of = np.searchsorted(begin, window, side="right") - 1
                keep = (window > begin[of]) | (rows.column("lead").to_numpy()[of] == 0)
                if within is not None:
                    keep &= may_hold(within, h, 2 * p.k)
                of, place, h, strand = of[keep], place[keep], h[keep], strand[keep]
                start = rows.column("start").to_numpy()
                loc = place - begin[of] + start[of] + p.k - 1
                taken = [rows.column(c).take(pa.array(of)) for c in (cols[:1] if marks else cols)]
                found = [pa.array(h.view(np.int64)), pa.array(loc.astype(np.int32)), pa.array(strand.astype(np.int32))]
                if marks:
                    first = pa.array(np.flatnonzero(start == 0))
                    own = [rows.column(c).take(first) for c in cols]
                    taken = [pa.concat_arrays([x, pa.nulls(len(of), x.type) if i else taken[0]]) for i, x in enumerate(own)]
                    found = [pa.concat_arrays([pa.nulls(len(first), x.type), x]) for x in found]
                yield pa.RecordBatch.from_arrays([*taken, *found], names=[*cols, "hash", "loc", "str"])

    cut = blocks(seqs, p, BLOCK, cols, marks)
    head = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in cols)
    return cut.mapInArrow(run, f"{head}, hash bigint, loc int, str int")


def first_picks(seq: np.ndarray, begin: int, most: int, p: IndexParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(place, hash, strand, more) of the next ``most`` seeds of codes whose k-mer starts at ``begin`` or later, as all windows of the sequence pick them; more: there are others behind. Looks no further than the seed behind the last."""
    # places never go down from window to window, so the windows that reach over the begin leave nothing out
    at, step = max(0, begin - p.w), max(256, 2 * most * (p.w + 1))
    found, n, last = [], 0, begin - 1
    while n <= most and at + p.w + p.k - 1 <= len(seq):
        _, place, h, strand = picks(seq[at : at + step + p.w + p.k - 2], p)
        place = place + at
        new = place > last
        if new.any():
            found.append((place[new], h[new], strand[new]))
            n += int(new.sum())
            last = int(place[-1])
        at += step
    parts = [np.concatenate(x) if found else np.zeros(0, kind) for x, kind in zip(zip(*found, strict=True) if found else ((), (), ()), (np.int64, np.uint64, np.int64), strict=True)]
    return *(x[:most] for x in parts), n > most


def extract(seqs: DataFrame, p: IndexParams, id_col: str, most: int) -> DataFrame:
    """(id, hash, loc, str, resume): the next ``most`` seeds of each sequence (id, seq, and optionally begin); resume, beside the last of them: the begin of a call that goes on (null if there are no more seeds).

    A sequence is one row, of which no more is looked at than the seeds need; calls that go on
    give, together, the seeds of ``minimizers``. Null and short sequences have none.
    """
    table = codes_table(p.dialect)
    begin = F.coalesce(F.col("begin").cast("int"), F.lit(0)) if "begin" in seqs.columns else F.lit(0)
    rows = seqs.filter("seq is not null").select(id_col, F.col("seq").cast("binary").alias("seq"), begin.alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, of = [], []
            for i, (seq, start) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                place, h, strand, more = first_picks(Codes(table, np.frombuffer(seq.as_buffer(), np.uint8)), start, most, p)
                on = np.full(len(place), -1)
                if more:
                    on[-1] = place[-1] + 1
                out.append((h.view(np.int64), place + p.k - 1, strand, on))
                of.append(np.full(len(place), i))
            if out:
                h, loc, strand, on = (np.concatenate(x) for x in zip(*out, strict=True))
                ids = batch.column(0).take(pa.array(np.concatenate(of)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(h), pa.array(loc.astype(np.int32)), pa.array(strand.astype(np.int32)), pa.array(on.astype(np.int32), mask=on < 0)], names=[id_col, "hash", "loc", "str", "resume"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, hash bigint, loc int, str int, resume int")


class Codes:
    """Base codes of a sequence, made where they are looked at."""

    def __init__(self, table: np.ndarray, data: np.ndarray) -> None:
        self.table, self.data = table, data

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, part: slice) -> np.ndarray:
        return self.table[self.data[part]]


def kmer_sums(seqs: DataFrame, p: IndexParams, id_col: str) -> DataFrame:
    """(id, n, n_reverse, least, most, total) of the canonical k-mers of sequences (id, seq), without palindromes and unclear k-mers: how many, on the reverse strand, and of their hashes. A row for each block, which is what leaves a task, comes before the sum."""
    if p.k > 21:
        raise ValueError("sums of longer k-mers do not fit 64 bits")
    p, table = replace(p, w=1), codes_table(p.dialect)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("piece")).to_numpy() + 1
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                codes = table[np.frombuffer(b"N".join(x.as_buffer() for x in rows.column("piece").cast(pa.binary())), np.uint8)]
                begin = np.cumsum(sizes[a:b]) - sizes[a:b]
                base = (codes & 3).astype(np.uint64)
                forward, reverse = strings(base, p.k, False), strings(base ^ np.uint64(2), p.k, True)
                bad = np.concatenate(([0], np.cumsum(codes >= 4)))
                ok = (bad[p.k :] == bad[: -p.k]) & (forward != reverse)
                ok[begin[rows.column("lead").to_numpy() == 1]] = False  # the block before has it
                h = mix(np.minimum(forward, reverse), p.k).view(np.int64)
                total = lambda x: np.add.reduceat(np.where(ok, x, 0), begin)
                found = [total(1), total(forward > reverse), np.minimum.reduceat(np.where(ok, h, (1 << 63) - 1), begin), np.maximum.reduceat(np.where(ok, h, -1), begin), total(h)]
                yield pa.RecordBatch.from_arrays([rows.column(id_col), *(pa.array(x.astype(np.int64)) for x in found)], names=[id_col, *NUMBERS])

    cut = blocks(seqs, p, BLOCK, (id_col,))
    found = cut.mapInArrow(run, f"`{id_col}` {cut.schema[id_col].dataType.simpleString()}, {', '.join(f'{x} bigint' for x in NUMBERS)}").filter("n > 0")
    return found.groupBy(id_col).agg(*[of(x).alias(x) for of, x in zip((F.sum, F.sum, F.min, F.max, F.sum), NUMBERS, strict=True)])


NUMBERS = ("n", "n_reverse", "least", "most", "total")
#: Windows of a block in SQL, and bits that tell a block's k-mers apart: a block has 256 and up to 256 more, as far as windows reach.
SQL_BLOCK, PLACE = 256, 10


def minimizers_sql(seqs: DataFrame, p: IndexParams, id_col: str) -> DataFrame:
    """``minimizers`` in SQL functions (letters A, C, G, T, U only); slower, and what the kernel is held against. A block's k-mers and windows are arrays of its row, so that nothing is shuffled or sorted."""
    cut = blocks(seqs, p, SQL_BLOCK, (id_col,)).withColumn("digits", F.translate("piece", "AaCcTtUuGg", "0011222233"))
    last = F.length("digits") - p.k
    # inline() keeps what it makes from being moved into the functions over arrays behind it, which would make it anew for each element
    once = lambda df, rest, **cols: df.select(id_col, "start", "lead", *rest, F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))
    cut = once(cut, [], digits=F.col("digits"), last=last, turned=F.reverse(F.translate("digits", "0123", "2301")), unclear=F.rlike("digits", F.lit("[^0-3]")))
    part = lambda text, at: fn.kmer(F.substr(text, at + 1, F.lit(p.k)))
    both = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.struct(part(F.col("digits"), i).alias("f"), part(F.col("turned"), F.col("last") - i).alias("r")))
    least = lambda x: F.struct(F.when(x["f"] != x["r"], F.least(x["f"], x["r"])).alias("h"), (x["f"] > x["r"]).cast("bigint").alias("z"))
    values = F.transform(both, least)
    each = lambda step: lambda x: F.struct(step(x["h"]).alias("h"), x["z"].alias("z"))
    for step in fn.hash_steps(p.k):
        values = F.transform(values, each(step))
    # hash, place and strand in one number, so that the least is the pick; no palindrome has one
    place = lambda i: i if p.ties == "left" else F.lit((1 << PLACE) - 1) - i
    keys = F.transform(values, lambda x, i: F.shiftleft(x["h"], PLACE + 1) + place(i) * 2 + x["z"])
    rows = once(cut, ["digits", "last", "unclear"], keys=keys)
    clear = lambda i: ~F.col("unclear") | ~F.rlike(F.substr("digits", i + 1, F.lit(p.w + p.k - 1)), F.lit("[^0-3]"))
    picks = F.transform(F.sequence(F.lit(0), F.col("last") - F.lit(p.w - 1)), lambda i: F.when(clear(i), F.array_min(F.slice("keys", i + 1, F.lit(p.w)))))
    rows = once(rows, [], picks=picks)
    fresh = F.filter(F.col("picks"), lambda x, i: x.isNotNull() & ~x.eqNullSafe(F.get("picks", i - 1)) & ((F.col("lead") == 0) | (i > 0)))
    rows = rows.select(id_col, "start", F.explode(fresh).alias("key"))
    at = place(F.shiftright("key", 1).bitwiseAND((1 << PLACE) - 1))
    return rows.select(id_col, F.shiftright("key", PLACE + 1).alias("hash"), (at + F.col("start") + p.k - 1).cast("int").alias("loc"), F.col("key").bitwiseAND(1).cast("int").alias("str"))
