"""The mapper's functions for SQL: hash64_<k> as SQL functions, minimizers and seeds as table functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..operators.minimizers import codes_table, picks
from ..params import IndexParams


def hash64_sql(k: int) -> str:
    """Body of a SQL function of x: nested queries, so that each step is written once."""
    mask = (1 << 2 * k) - 1
    left = lambda n: f"shiftleft(x & {mask >> n}L, {n})"
    steps = [f"((x ^ {mask}L) + {left(21)}) & {mask}L", "x ^ shiftright(x, 24)", f"(x * 265) & {mask}L", "x ^ shiftright(x, 14)", f"(x * 21) & {mask}L", "x ^ shiftright(x, 28)", f"(x + {left(31)}) & {mask}L"]
    body = "array(x)"
    for s in steps:
        body = f"transform({body}, x -> {s})"
    return f"{body}[0]"


def seeds_of(seqs: pa.Array, w: int, k: int) -> tuple[np.ndarray, list[pa.Array]]:
    """(place of the sequence, [hash, loc, str]) of the seeds of an array of sequences, in order. Sequences stand side by side with a letter between that no seed goes over."""
    parts = [x.as_buffer() if x.is_valid else b"" for x in seqs.cast(pa.binary())]
    sizes = np.array([len(x) + 1 for x in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    _, place, h, strand = picks(codes_table("host")[np.frombuffer(b"N".join(parts), np.uint8)], IndexParams(w, k))
    of = np.searchsorted(begin, place, side="right") - 1
    return of, [pa.array(h.view(np.int64)), pa.array((place - begin[of] + k - 1).astype(np.int32)), pa.array(strand.astype(np.int32))]


@udtf(returnType="hash: bigint, loc: int, str: int")
class Minimizers:
    """minimizers(seq, w, k): a row for each seed of a sequence, in order. For lateral joins, where Spark takes no function over Arrow batches; ``seeds`` is the one for tables."""

    def eval(self, seq: str, w: int, k: int) -> Iterator[tuple[int, int, int]]:
        if seq is not None:
            yield from zip(*(x.to_pylist() for x in seeds_of(pa.array([seq]), w, k)[1]), strict=True)


@arrow_udtf(returnType="id: bigint, hash: bigint, loc: int, str: int")
class Seeds:
    """seeds(TABLE(id, seq), w, k): a row for each seed of each sequence of a table, in the order of its rows."""

    def eval(self, rows: pa.RecordBatch, w: pa.Array, k: pa.Array) -> Iterator[pa.Table]:
        if rows.num_rows:
            of, found = seeds_of(rows.column("seq"), w[0].as_py(), k[0].as_py())
            yield pa.table([pc.cast(rows.column("id"), pa.int64()).take(pa.array(of)), *found], names=["id", "hash", "loc", "str"])


def register(spark: SparkSession, ks: tuple[int, ...] = (15, 19, 21)) -> None:
    for k in ks:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hash64_{k}(x BIGINT) RETURNS BIGINT RETURN {hash64_sql(k)}")
    spark.udtf.register("minimizers", Minimizers)
    spark.udtf.register("seeds", Seeds)
