"""Hard negatives of anchors, by one-bit codes of rotated vectors.

A vector is rotated (signs and Hadamard transforms, so that no coordinate stands out) and coded by the
signs of its coordinates. With the code as a unit vector c, a row v is ``align`` times c and a rest
square to it, of known length. For an anchor u, <u, v> is ``align`` times <u, c>, which popcounts
over the bits of u's coordinates give up to u's rounding, and a part of the rest which the
Cauchy-Schwarz inequality bounds. So every score lies within a known interval, without exception,
and only rows whose interval reaches what an anchor still looks for are scored, in whole numbers.

Anchors are dealt into groups and rows into stripes, both of bounded size; each group meets each
stripe in one task, which hands on a few rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a stripe and anchors of a group, if they have no more than 64 components (of longer ones as many less), and words of codes that a task compares at a time.
STRIPE, GROUP, SLAB = 8192, 2048, 1 << 20
#: Bits of an anchor's coordinates; rounds of the rotation; its seed.
PLANES, ROUNDS, SEED = 8, 3, 20
#: Components scaled to whole numbers stay within these, so that scores fit 64 bits.
REACH = 1 << 26


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows turned by signs and Hadamard transforms, in as many coordinates as the next power of two, 64 at least; lengths and angles stay."""
    wide = max(64, 1 << (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), wide))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng(SEED).integers(0, 2, (ROUNDS, wide)) * 2 - 1
    for s in signs:
        out *= s
        step = 1
        while step < wide:
            pairs = out.reshape(len(x), -1, 2, step)
            out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(len(x), wide)
            step *= 2
        out /= np.sqrt(wide)
    return out


def words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def coded(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, align, rest) of rows of whole numbers: sign bits, length along the code, length square to it."""
    v = rotated(whole.astype(np.float64))
    align = np.abs(v).sum(1) / np.sqrt(v.shape[1])
    rest = np.sqrt(np.maximum((v * v).sum(1) - align * align, 0))
    return words(v > 0), align, rest


class Anchors:
    """Anchors with their coordinates in bit planes."""

    def __init__(self, whole: np.ndarray) -> None:
        u = rotated(whole.astype(np.float64))
        self.whole, self.real, self.wide = whole, whole.astype(np.float64), u.shape[1]
        self.length = np.sqrt((u * u).sum(1))
        top = (1 << (PLANES - 1)) - 1
        self.step = np.maximum(np.abs(u).max(1), 1e-9) / top
        q = np.rint(u / self.step[:, None]).astype(np.int64)
        self.off = np.sqrt(((u - q * self.step[:, None]) ** 2).sum(1))
        self.total = q.sum(1)
        self.planes = [words(((q + top) >> j & 1).astype(bool)) for j in range(PLANES)]
        self.low = top

    def intervals(self, code: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(middle, reach) of the scores of every anchor with every row: no score lies outside."""
        ones = np.zeros((len(self.whole), len(code)), np.int64)
        for j, plane in enumerate(self.planes):
            ones += np.bitwise_count(plane[:, None, :] & code[None]).sum(2, dtype=np.int64) << j
        ones -= self.low * np.bitwise_count(code).sum(1, dtype=np.int64)[None]
        # <u, c>: coordinates count plus where the code's bit is set, else minus
        along = (2 * ones - self.total[:, None]) * (self.step[:, None] / np.sqrt(self.wide))
        square = np.maximum(self.length[:, None] ** 2 - np.maximum(np.abs(along) - self.off[:, None], 0) ** 2, 0)
        reach = align[None] * self.off[:, None] + rest[None] * np.sqrt(square)
        slack = 1e-9 * self.length[:, None] * (align + rest)[None] + 1e-6
        return align[None] * along, reach + slack

    def scored(self, a: np.ndarray, rows: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Whole inner products of pairs. Where many pairs of a slab are left, one product of matrices has them all; in doubles, which hold whole numbers that small exactly."""
        if len(a) * 32 > len(self.whole) * len(rows) and int(np.abs(self.whole).max()) * int(np.abs(rows).max()) * rows.shape[1] < 1 << 53:
            return (self.real @ rows.T.astype(np.float64))[a, r].astype(np.int64)
        out = np.empty(len(a), np.int64)
        for i in range(0, len(a), 1 << 16):
            out[i : i + (1 << 16)] = np.einsum("ij,ij->i", self.whole[a[i : i + (1 << 16)]], rows[r[i : i + (1 << 16)]])
        return out


class Best:
    """The best few rows of each query so far: (query, score, id), higher scores first, then smaller ids; equal ones count once."""

    def __init__(self, n: int, most: int) -> None:
        self.most, self.floor = most, np.full(n, np.iinfo(np.int64).min)
        self.q, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        if not len(q):
            return
        q, score, row = np.concatenate((self.q, q)), np.concatenate((self.score, score)), np.concatenate((self.id, row))
        order = np.lexsort((row, -score, q))
        q, score, row = q[order], score[order], row[order]
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (score[1:] != score[:-1]) | (row[1:] != row[:-1])))
        q, score, row = q[new], score[new], row[new]
        first = np.searchsorted(q, q)
        turn = np.arange(len(q)) - first
        keep = turn < self.most
        self.q, self.score, self.id = q[keep], score[keep], row[keep]
        full = turn == self.most - 1
        self.floor[q[full]] = score[full]


def matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def slabs(table: pa.Table, anchors: int) -> Iterator[tuple]:
    """(ids, labels, code, align, rest, whole) of a stripe's rows in parts, few at first, so that something is known when many come."""
    ids, labels, align, rest = (table[c].to_numpy() for c in ("id", "label", "align", "rest"))
    code, whole = matrix(table["code"], np.uint64), matrix(table["whole"], np.int32).astype(np.int64)
    most = max(16, SLAB // (anchors * code.shape[1]))
    at, size = 0, -(-most // 8)
    while at < len(ids):
        part = slice(at, at + size)
        yield ids[part], labels[part], code[part], align[part], rest[part], whole[part]
        at, size = at + size, most


def code_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column, anchors: Column, scale: int) -> DataFrame:
    """(id, label, anchor, dim, code, align, rest, whole) of the rows that take part."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.transform(vector_col, lambda v: v.cast("double")).alias("x"))
    own = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            dims = lists.value_lengths().to_numpy()
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(of))
                values = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(of), dim)
                whole = np.clip(np.floor(scale * values), -REACH, REACH).astype(np.int32)
                code, align, rest = coded(whole)
                blobs = [pa.array([m.tobytes() for m in rows], pa.binary()) for rows in (code, whole)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.full(len(of), dim, np.int32)), blobs[0], pa.array(align), pa.array(rest), blobs[1]], names=["id", "label", "anchor", "dim", "code", "align", "rest", "whole"])

    return written(own.mapInArrow(run, "id bigint, label bigint, anchor boolean, dim int, code binary, align double, rest double, whole binary"), "codes")


def met(anchors: DataFrame, rows: DataFrame, stripes: int, groups: int, run, kind: str) -> DataFrame:
    """What ``run(anchors, rows)`` gives for every group of anchors and every stripe of rows."""
    left = anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    right = rows.withColumn("stripe", F.pmod(F.xxhash64("id"), F.lit(stripes)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ["dim", "grp", "stripe"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, kind)


def hard_negatives(vectors: DataFrame, anchors: Column | None = None, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 3, between: tuple[int, int] = (50, 95), scale: int = 256, stripe: int = STRIPE, group: int = GROUP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its nearest rows of the same label, the nearest rows of other labels whose score lies between these percentages of the positive's.

    ``anchors`` says which rows are anchors (without it: every row), ``label`` what a row's label is.
    Components become floor(scale * x), scores are their inner products; higher ones come first, ties
    by the smaller id. Rows without id, label or vector, with an empty one, or with a component that
    is null or not finite take no part; vectors of another length than the anchor's have no score with
    it. Rows of the anchor's own id are not among its positives. Rows of one id and label with one
    score count once, so repeated rows change nothing; rows that share an id, but neither label nor
    vector, are anchors each. Scaled components end at 2^26. No rows give no rows.
    """
    rows = code_rows(vectors, id_col, vector_col, label if label is not None else F.col("label"), anchors if anchors is not None else F.lit(True), scale)
    chosen = rows.filter("anchor").select("id", "label", "dim", "whole", F.xxhash64("label", "whole").alias("key"))
    chosen = written(chosen.distinct(), "anchors")
    weight = F.coalesce(F.sum(F.greatest("dim", F.lit(64)).cast("bigint")), F.lit(0))
    groups, stripes = (max(1, -(-x.agg(weight).first()[0] // (64 * most))) for x, most in ((chosen, group), (rows, stripe)))
    asked = chosen.withColumn("grp", F.pmod(F.xxhash64("id", "key", F.lit(1)), F.lit(groups)).cast("int"))

    def near(table: pa.Table, others: pa.Table) -> pa.Table:
        """The best rows of the same label in a stripe, for each anchor."""
        own, key, name = (table[c].to_numpy() for c in ("id", "key", "label"))
        best = Best(len(own), positives)
        if len(own) and others.num_rows:
            a = Anchors(matrix(table["whole"], np.int32).astype(np.int64))
            for ids, labels, code, align, rest, whole in slabs(others, len(own)):
                middle, reach = a.intervals(code, align, rest)
                open_ = (middle + reach >= best.floor[:, None]) & (labels[None] == name[:, None]) & (ids[None] != own[:, None])
                i, j = np.nonzero(open_)
                best.add(i, a.scored(i, whole, j), ids[j])
        return pa.table({"anchor_id": own[best.q], "key": key[best.q], "score": best.score, "row_id": best.id})

    ranks = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "row_id")
    found = met(asked, rows, stripes, groups, near, "anchor_id bigint, key bigint, score bigint, row_id bigint")
    found = found.withColumn("turn", F.row_number().over(ranks("anchor_id", "key"))).filter(F.col("turn") <= positives)
    wanted = found.select("anchor_id", "key", F.struct("turn", F.col("row_id").alias("positive_id"), "score").alias("p"))
    wanted = written(wanted.groupBy("anchor_id", F.col("key").alias("key_")).agg(F.sort_array(F.collect_list("p")).alias("ps")), "positives")
    sought = asked.join(wanted, (F.col("id") == F.col("anchor_id")) & (F.col("key") == F.col("key_"))).select("id", "label", "dim", "whole", "key", "grp", "ps")
    low, high = between

    def far(table: pa.Table, others: pa.Table) -> pa.Table:
        """The best rows of other labels within each positive's bounds in a stripe."""
        own, key, name = (table[c].to_numpy() for c in ("id", "key", "label"))
        lists = table["ps"].combine_chunks()
        ps = lists.flatten()
        of = np.repeat(np.arange(len(own)), lists.value_lengths().to_numpy())
        field = lambda c: ps.field(c).to_numpy()
        score, turn = field("score"), field("turn") - 1
        least, most = -(-low * score // 100), high * score // 100
        best = Best(len(of), negatives)
        query = np.full((len(own), positives), -1)
        query[of, turn] = np.arange(len(of))
        if len(own) and others.num_rows:
            a = Anchors(matrix(table["whole"], np.int32).astype(np.int64))
            for ids, labels, code, align, rest, whole in slabs(others, len(own)):
                middle, reach = a.intervals(code, align, rest)
                other = labels[None] != name[:, None]
                floors = np.maximum(least, best.floor)
                open_ = np.zeros(other.shape, bool)
                for t in range(positives):
                    q = query[:, t]
                    lo, hi = np.where(q >= 0, floors[q], 1), np.where(q >= 0, most[q], 0)
                    open_ |= ((middle + reach >= lo[:, None]) & (middle - reach <= hi[:, None])) & (lo <= hi)[:, None]
                i, j = np.nonzero(open_ & other)
                got = a.scored(i, whole, j)
                for t in range(positives):
                    q = query[i, t]
                    fits = (q >= 0) & (got >= floors[q]) & (got <= most[q])
                    best.add(q[fits], got[fits], ids[j[fits]])
        at = of[best.q]
        return pa.table({"anchor_id": own[at], "key": key[at], "positive_id": field("positive_id")[best.q], "positive_score": score[best.q], "score": best.score, "row_id": best.id})

    out = met(sought, rows, stripes, groups, far, "anchor_id bigint, key bigint, positive_id bigint, positive_score bigint, score bigint, row_id bigint")
    out = out.withColumn("rank", F.row_number().over(ranks("anchor_id", "key", "positive_id"))).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle(source: str = "embeddings") -> str:
    """The same for every fiftieth vector, in DuckDB SQL, without codes."""
    whole = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"
    return f"""WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {whole} AS v FROM {source} WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (SELECT DISTINCT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS s FROM (SELECT * FROM rows WHERE vec_id % 50 = 0) a JOIN rows r ON len(a.v) = len(r.v)),
    positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) AS n FROM scores WHERE label = anchor_label AND vec_id <> anchor_id) WHERE n <= 5),
    negatives AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY x.s DESC, x.vec_id) AS rank, x.vec_id AS negative_id, p.s AS positive_score, x.s AS negative_score
        FROM positives p JOIN scores x ON x.anchor_id = p.anchor_id AND x.label <> x.anchor_label AND 50 * p.s <= 100 * x.s AND 100 * x.s <= 95 * p.s)
    SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3"""
