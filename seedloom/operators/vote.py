"""Vote: anchors of a read fall into groups along the diagonal; the best groups are its records.

Along one strand, in order of target and diagonal, an anchor joins the group before it while it lies
within ``distance`` of the group's reference, which moves only to an anchor of smaller query
position. ``operators.fold`` finds all groups of a line at once; the form in SQL functions folds the
stretches that are wider than the distance anchor by anchor, and is what the other is held against.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as fn
from ..params import MapParams
from . import fold
from .postings import Postings, Reader, anchors_of

#: Target of the groups that are still open when a read's anchors end, behind any other; place of the groups at the origin, before any other.
LAST, AT_ORIGIN = (1 << 63) - 1, (1 << fn.TARGET_BITS) - 1


def positioned(anchors: DataFrame) -> DataFrame:
    """Anchors with T, the place of their diagonal, and L, their place, each over all targets."""
    base = F.shiftleft(F.col("chrom_id").cast("bigint"), fn.TARGET_BITS)
    return anchors.select("read_id", "len", "str", F.col("q_loc").cast("bigint").alias("q"), (base + F.col("diag")).alias("T"), (base + fn.target_position(F.col("diag"), F.col("q_loc").cast("bigint"), F.col("str"))).alias("L"))


def folded(stretch: Column, distance: int) -> Column:
    """Groups of a stretch of anchors (T, q, L) in order."""
    kind = "struct<T: bigint, q: bigint, ref: bigint, n: bigint, q_start: bigint, q_end: bigint, t_start: bigint, t_end: bigint>"

    def one(x: Column) -> Column:
        return F.struct(x["T"].alias("T"), x["q"].alias("q"), x["T"].alias("ref"), F.lit(1).cast("bigint").alias("n"), x["q"].alias("q_start"), x["q"].alias("q_end"), x["L"].alias("t_start"), x["L"].alias("t_end"))

    def step(acc: Column, x: Column) -> Column:
        g = acc["open"]
        lower = x["q"] < g["q_start"]
        more = F.struct(
            g["T"].alias("T"), g["q"].alias("q"), F.when(lower, x["T"]).otherwise(g["ref"]).alias("ref"), (g["n"] + 1).alias("n"),
            F.least(g["q_start"], x["q"]).alias("q_start"), F.greatest(g["q_end"], x["q"]).alias("q_end"), F.least(g["t_start"], x["L"]).alias("t_start"), F.greatest(g["t_end"], x["L"]).alias("t_end"),
        )
        joins = x["T"] <= g["ref"] + F.lit(distance)
        closed = F.when(g.isNull() | joins, acc["closed"]).otherwise(F.concat(acc["closed"], F.array(g)))
        return F.struct(closed.alias("closed"), F.when(g.isNotNull() & joins, more).otherwise(one(x)).alias("open"))

    start = F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("closed"), F.expr(f"cast(null as {kind})").alias("open"))
    return F.aggregate(stretch, start, step, lambda acc: F.concat(acc["closed"], F.array(acc["open"])))


def grouped(line: np.ndarray, chrom: np.ndarray, diag: np.ndarray, q: np.ndarray, p: MapParams) -> dict[str, np.ndarray]:
    """Groups of anchors in order of (line, chrom, diag, q), as columns; line: twice the read's number, from 0 without gaps, and the strand. Targets are a column of their own, so that their ids may be any."""
    n = len(q)
    strand = line & 1
    loc = np.where(strand == 1, diag - q, diag + q - fn.DIAGONAL)
    if chrom.min() < 0:
        loc = np.where(chrom < 0, (chrom << fn.TARGET_BITS) + loc, loc)
    turn = np.concatenate(([True], line[1:] != line[:-1]))
    origin = (chrom < 0) | (chrom == 0) & (diag <= p.distance) if p.compat_origin else np.zeros(n, bool)
    of = np.cumsum(turn | np.concatenate(([True], chrom[1:] != chrom[:-1])))
    rest = np.flatnonzero(~origin)
    begin = rest[fold.starts(diag[rest], q[rest], of[rest], p.distance)]
    # anchors at the origin stand before the others of their line, so groups are runs of all anchors
    near = np.flatnonzero(origin & (turn | np.concatenate(([True], ~origin[:-1]))))
    cut = np.sort(np.concatenate((begin, near)))
    least, most = (lambda x: np.minimum.reduceat(x, cut)), (lambda x: np.maximum.reduceat(x, cut))
    zero = origin[cut]
    row = {
        "line": line[cut], "vt_score": np.diff(np.concatenate((cut, [n]))), "q_start": np.where(zero, 0, least(q)), "q_end": np.where(zero, np.maximum(most(q), 0), most(q)), "t_start": np.where(zero, 0, least(loc)), "t_end": np.where(zero, np.maximum(most(loc), 0), most(loc)),
        "chrom_id": np.where(zero, 0, chrom[cut]), "chrom": np.where(zero, -1, chrom[cut]), "T": np.where(zero, AT_ORIGIN, diag[cut]), "q": np.where(zero, 0, q[cut]),
    }
    if p.compat_origin:
        # groups at the origin that have no anchor stand first in their line
        have = np.zeros(2 * (int(line[-1]) // 2 + 1), bool)
        have[row["line"][zero]] = True
        none = np.flatnonzero(~have)
        at = np.searchsorted(row["line"], none)
        row = {k: np.insert(v, at, {"line": none, "chrom": -1, "T": AT_ORIGIN}.get(k, 0)) for k, v in row.items()}
    top = np.concatenate(([True], row["line"][1:] != row["line"][:-1]))
    at = np.arange(len(top))
    row["grp"] = at - np.maximum.accumulate(np.where(top, at, 0)) + (0 if p.compat_origin else 1)
    ends = np.concatenate((top[1:], [True]))
    return row | {f"after_{k}": np.where(ends, last, np.concatenate((row[k][1:], [0]))) for k, last in (("chrom", LAST), ("T", 0), ("q", 0))}


def group_rows(row: dict[str, np.ndarray], ids: pa.Array, length: pa.Array) -> pa.RecordBatch:
    """Columns of ``grouped`` as ``GROUPS``; ids and length: of the reads, by number."""
    strand, of = pa.array(row["line"] & 1, pa.int32()), pa.array(row["line"] >> 1)
    point = lambda *c: pa.StructArray.from_arrays([*(pa.array(row[x]) for x in c), strand], ["chrom", "T", "q", "str"])
    words = [pa.array((row["chrom_id"] << fn.TARGET_BITS) + row[k]) for k in ("t_start", "t_end")]
    numbers = [pa.array(row[k]) for k in ("vt_score", "q_start", "q_end")]
    return pa.RecordBatch.from_arrays([ids.take(of), length.take(of), strand, pa.array(row["grp"], pa.int32()), *numbers, *words, pa.array(row["chrom_id"]), point("chrom", "T", "q"), point("after_chrom", "after_T", "after_q")], names=GROUPS)


GROUPS = ["read_id", "len", "str", "grp", "vt_score", "q_start", "q_end", "t_start", "t_end", "chrom_id", "first", "next"]


def group_schema(rows: DataFrame) -> str:
    kind = lambda c: rows.schema[c].dataType.simpleString()
    point = "struct<chrom: bigint, T: bigint, q: bigint, str: int>"
    return f"read_id {kind('read_id')}, len {kind('len')}, str int, grp int, vt_score bigint, q_start bigint, q_end bigint, t_start bigint, t_end bigint, chrom_id bigint, first {point}, next {point}"


def whole_reads(batches: Iterator[pa.RecordBatch], least: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows that stand together by read (column 0) in batches of whole reads, of so many rows at least but for the last."""
    kept: list[pa.RecordBatch] = []
    size = 0

    def joined(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        return pa.Table.from_batches([x for x in parts if x.num_rows]).combine_chunks().to_batches() if any(x.num_rows for x in parts) else []

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        ids = batch.column(0)
        same = pc.equal(ids, ids[batch.num_rows - 1]).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(same))  # the last read may go on
        if cut == 0 and len(kept) > 1 and kept[-2].column(0)[kept[-2].num_rows - 1] == ids[0]:
            continue
        yield from joined([*kept[:-1], batch.slice(0, cut)])
        kept, size = [batch.slice(cut)], batch.num_rows - cut
    yield from joined(kept)


def numbers_of(ids: pa.Array) -> np.ndarray:
    """Reads by number: ids are of any type, and equal ones stand together."""
    n = len(ids)
    return np.concatenate(([0], np.cumsum(pc.not_equal(ids.slice(1), ids.slice(0, n - 1)).to_numpy(zero_copy_only=False))))


def vote_groups(anchors: DataFrame, p: MapParams) -> DataFrame:
    """``vote_groups_sql``, by a kernel over sorted anchors. Anchors are dealt by read and sorted once; a task holds those of a batch, and of one read that goes on."""
    order = ["read_id", "str", "chrom_id", "diag", "q"]
    rows = anchors.select("read_id", "len", "str", F.col("chrom_id").cast("bigint").alias("chrom_id"), F.col("diag").cast("bigint").alias("diag"), F.col("q_loc").cast("bigint").alias("q")).repartition("read_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_reads(batches):
            read = numbers_of(part.column(0))
            strand, chrom, diag, q = (part.column(c).to_numpy() for c in range(2, 6))
            heads = pa.array(np.flatnonzero(np.concatenate(([True], read[1:] != read[:-1]))))
            yield group_rows(grouped(2 * read + strand, chrom, diag, q, p), part.column(0).take(heads), part.column(1).take(heads))

    return rows.mapInArrow(run, group_schema(rows))


#: Seeds gathered before they are looked up, and anchors worked on at a time; those of one read are not parted.
SEEDS, ANCHORS = 1 << 16, 1 << 18


def vote_seeds(seeds: DataFrame, keys: Postings, p: MapParams, only_covered: bool = False) -> DataFrame:
    """``vote_groups`` of the anchors that seeds (read_id, len, hash, loc, str) make with an index's postings: no anchor is a row. A read's seeds have to stand together. only_covered: the groups that ``covered`` leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Reader(keys)
        for part in whole_reads(batches, SEEDS):
            read = numbers_of(part.column(0))
            h, q, strand = (part.column(c).to_numpy() for c in range(2, 5))
            of, begin, n = index.found(h)
            met = np.flatnonzero(n)
            upto = np.cumsum(np.bincount(read, n))
            first = np.searchsorted(read, np.arange(read[-1] + 2))
            a = 0
            while a <= read[-1]:
                # as many reads as have so many anchors, one at least
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + ANCHORS, side="right")))
                own = met[np.searchsorted(met, first[a]) : np.searchsorted(met, first[b])]
                a = b
                if len(own):
                    yield done(part, index, own, read[own], of[own], begin[own], n[own], q[own].astype(np.int64), strand[own])

    def done(part: pa.RecordBatch, index: Reader, own: np.ndarray, read: np.ndarray, of: np.ndarray, begin: np.ndarray, n: np.ndarray, q: np.ndarray, strand: np.ndarray) -> pa.RecordBatch:
        which, chrom, at = index.keys(of, begin, n)
        # reads without an anchor have no group, so those with one are numbered anew
        fresh = np.concatenate(([True], read[1:] != read[:-1]))
        heads = pa.array(own[fresh])
        ids, length = part.column(0).take(heads), part.column(1).take(heads)
        row = grouped(*anchors_of(which, chrom, at, np.cumsum(fresh) - 1, q, strand), p)
        if only_covered:
            low = (np.float32(p.coverage) * length.to_numpy().astype(np.float32)).astype(np.int64)
            some = row["q_end"] - row["q_start"] >= low[row["line"] >> 1]
            row = {k: v[some] for k, v in row.items()}
        return group_rows(row, ids, length)

    return seeds.select("read_id", "len", "hash", "loc", "str").mapInArrow(run, group_schema(seeds))


def vote_groups_sql(anchors: DataFrame, p: MapParams) -> DataFrame:
    """(read_id, len, str, grp, vt_score, q_start, q_end, t_start, t_end, chrom_id, first, next): groups in order from 1, on each strand of each read.

    With ``compat_origin`` a group 0 at the origin exists on both strands of every read with
    anchors; it takes the anchors whose diagonal lies within ``distance`` of zero. first and next
    are the first anchors (chrom, T, q, str; T: the diagonal) of the group and of the one behind it. Starts
    and ends are words of target and place, in which targets from 2^33 on do not fit; the kernel orders
    and names targets by chrom_id, which may be any.

    Anchors are dealt by read once; all windows and groups that follow keep to that.
    """
    rows = positioned(anchors).repartition("read_id")
    origin = F.col("T") <= p.distance if p.compat_origin else F.lit(False)
    line = Window.partitionBy("read_id", "str").orderBy("T", "q")
    before = F.lag("T").over(line)
    opens = before.isNull() | (F.col("T") - before > p.distance)
    if p.compat_origin:
        opens = ~origin & (opens | (before <= p.distance))
    # anchors at the origin are stretch 0, the others count from 1
    rows = rows.withColumn("stretch", F.sum(opens.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    keys = ["read_id", "len", "str", "stretch"]
    whole = Window.partitionBy("read_id", "str", "stretch")
    wide = (F.max("T").over(whole) - F.min("T").over(whole) > p.distance) & (F.col("stretch") > 0)
    rows = rows.withColumn("wide", wide)
    measures = {"n": F.count(F.lit(1)), "q_start": F.min("q"), "q_end": F.max("q"), "t_start": F.min("L"), "t_end": F.max("L")}
    groups = rows.groupBy(*keys).agg(F.min(F.struct("T", "q")).alias("head"), *[c.alias(k) for k, c in measures.items()], F.collect_list(F.when(F.col("wide"), F.struct("T", "q", "L"))).alias("all"))
    zero = F.lit(0).cast("bigint")
    group = lambda t, q, *rest: F.struct(t.alias("T"), q.alias("q"), *[c.alias(k) for k, c in zip(measures, rest, strict=True)])
    at_origin = lambda n, q, t: group(F.lit(-1).cast("bigint"), zero, n, zero, q, zero, t)
    own = F.when(F.col("stretch") == 0, at_origin(F.col("n"), F.greatest("q_end", zero), F.greatest("t_end", zero))).otherwise(group(F.col("head.T"), F.col("head.q"), *[F.col(k) for k in measures]))
    parts = F.when(F.size("all") > 0, F.transform(folded(F.array_sort("all"), p.distance), lambda g: group(g["T"], g["q"], *[g[k] for k in measures]))).otherwise(F.array(own))
    tagged = lambda strand, gs: F.transform(gs, lambda g: F.struct(strand.cast("int").alias("str"), g.alias("g")))
    groups = groups.withColumn("parts", tagged(F.col("str"), parts))
    if p.compat_origin:
        # a read's first row brings the groups at the origin that have no anchor
        read = Window.partitionBy("read_id")
        missing = [F.when(F.max(((F.col("str") == s) & (F.col("stretch") == 0)).cast("int")).over(read) == 0, tagged(F.lit(s), F.array(at_origin(zero, zero, zero)))).otherwise(F.expr("slice(parts, 1, 0)")) for s in (0, 1)]
        top = F.row_number().over(read.orderBy("str", "stretch")) == 1
        groups = groups.withColumn("parts", F.when(top, F.concat("parts", *missing)).otherwise(F.col("parts")))
    groups = groups.select("read_id", "len", F.inline("parts")).select("read_id", "len", "str", "g.*")
    grp = F.row_number().over(line) - (1 if p.compat_origin else 0)
    first = F.struct(fn.chrom_of(F.col("T")).alias("chrom"), fn.position_of(F.col("T")).alias("T"), "q", "str")
    last = F.struct(F.lit(LAST).alias("chrom"), zero.alias("T"), zero.alias("q"), F.col("str").alias("str"))
    groups = groups.withColumn("grp", grp).withColumn("next", F.coalesce(F.lead(first).over(line), last))
    return groups.select("read_id", "len", "str", "grp", F.col("n").alias("vt_score"), "q_start", "q_end", "t_start", "t_end", F.when(F.col("T") == -1, 0).otherwise(fn.chrom_of(F.col("T"))).alias("chrom_id"), first.alias("first"), "next")


def covered(groups: DataFrame, p: MapParams) -> DataFrame:
    """Groups that span enough of their read."""
    return groups.filter(F.col("q_end") - F.col("q_start") >= fn.threshold(p.coverage, F.col("len")))


def top_records(groups: DataFrame, p: MapParams) -> DataFrame:
    """The best groups of each read, with rank from 0: by score, then by likeness of the spans, then by which was closed first."""
    diff = fn.span_difference(F.col("q_start"), F.col("q_end"), F.col("t_start"), F.col("t_end"))
    order = Window.partitionBy("read_id").orderBy(F.desc("vt_score"), diff, "next")
    # the filter stands on the number itself, so that tasks keep no more groups of a read before the exchange
    return groups.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.top).withColumn("rank", F.col("rank") - 1)


def decided(records: DataFrame, p: MapParams) -> DataFrame:
    """Records that stay: none of a read whose best two are level (where ties are rejected), and none far below the best. Adds best and second, the scores of ranks 0 and 1 among them."""
    of = Window.partitionBy("read_id")
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("vt_score"))).over(of)
    rows = records.withColumns({"best": at(0), "second": at(1)})
    if p.reject_ties:
        rows = rows.filter(F.col("second").isNull() | (F.col("best") != F.col("second")))
    low = fn.threshold(p.fraction, F.col("best"))
    rows = rows.filter((F.col("rank") == 0) | (F.col("vt_score") >= low))
    return rows.withColumn("second", F.when(F.col("second") >= low, F.col("second")))
