"""Shared pieces: text expressions, written intermediates, ranks without a hot task, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import shared_path, written  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: For ``bytes.translate``: A-Z to a-z, every other byte as it is.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only. Where all is ASCII that is plain ``lower``, which needs no table."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """A text's name of 128 bits, for joins that go back to rows: ids may repeat or be null. Null texts have one of their own."""
    return F.coalesce(F.md5(text), F.lit("null"))


def own_name(what: str) -> str:
    """A column name that no table has, for joins beside columns of any name."""
    return f"__{what}_{uuid.uuid4().hex}"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dropped(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        for file in t.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key is frequent with so many rows, or this part of all rows if that is more; so there are at most as many frequent keys as the part says.
FREQUENT_ROWS, FREQUENT_PART = 10_000, 2_000


def joined_evenly(big: DataFrame, small: DataFrame, keys: list[str], value: str, rows: str) -> DataFrame:
    """``big`` with a column ``value`` of ``small``, inner; no task gets all rows of a frequent key.

    ``small`` is a written table with a row for each key and ``rows``, how often it is in ``big``.
    Its frequent keys, at most ``FREQUENT_PART``, are broadcast; rows with these are dealt by all
    their columns into the shuffle join that the others need.
    """
    least = max(FREQUENT_ROWS, big.count() // FREQUENT_PART)
    side = lambda df, k: df.select(*[F.col(x).alias(f"{x}_{k}") for x in keys], F.col(value).alias(f"value_{k}"))
    often = small.filter(F.col(rows) > least)
    first, hot = F.col(keys[0]), F.lit(False)
    if not often.isEmpty():
        big_ = big.join(F.broadcast(side(often, "hot")), [F.col(x) == F.col(f"{x}_hot") for x in keys], "left")
        hot = F.col("value_hot").isNotNull()
        first = F.when(hot, F.xxhash64(*big.columns)).otherwise(first)
    else:
        big_ = big.withColumn("value_hot", F.lit(None).cast(small.schema[value].dataType))
    dealt = big_.withColumn("__deal", first)
    on = (F.col("__deal") == F.col(f"{keys[0]}_one")) & ~hot
    for x in keys[1:]:
        on = on & (F.col(x) == F.col(f"{x}_one"))
    met = dealt.join(side(small, "one"), on, "left").withColumn(value, F.coalesce("value_hot", "value_one"))
    return met.filter(F.col(value).isNotNull()).select(*[c for c in big.columns if c != value], value)


def ranked(df: DataFrame, keys: list[str], order: Column, ties: list, n_rows: int, rank: str = "rank", weight: Column | None = None, rows_per_task: int = 4000) -> DataFrame:
    """Row number from 0 within ``keys``, in an order of the 64-bit hash ``order`` taken as unsigned.

    No task holds more than about ``rows_per_task`` rows of a key: rows are dealt into slices of
    the hash's range, slices are counted, and ranks are counted within a slice. ``n_rows`` bounds
    the rows of ``df``. With ``weight``, ``<rank>_before`` is the weight of all earlier rows.
    Repeated rows get ranks of their own.
    """
    slices = max(1, -(-n_rows // rows_per_task))
    share = F.lit(1 << 32)
    df = df.withColumn("__h", order).withColumn("__slice", F.floor(F.shiftrightunsigned("__h", 32) * F.lit(slices) / share).cast("int"))
    w = F.lit(0) if weight is None else weight
    df = df.withColumn("__w", w.cast("bigint"))
    sums = df.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"), F.sum("__w").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__slice").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__w0"))
    on = F.col("__slice") == F.col("__s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = Window.partitionBy(*keys, "__slice").orderBy(F.col("__h").bitwiseXOR(F.lit(-(1 << 63))), *ties)
    out = df.join(sums, on).withColumn(rank, (F.col("__n0") + F.row_number().over(within) - 1).cast("bigint"))
    if weight is not None:
        earlier = within.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"{rank}_before", F.col("__w0") + F.coalesce(F.sum("__w").over(earlier), F.lit(0)))
    return out.drop("__h", "__slice", "__w", "__n0", "__w0", "__s", *[f"__k{i}" for i in range(len(keys))])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (src, dst); component: the smallest node reachable.

    Alternating large-star and small-star rounds: every round links nodes to smaller ones until
    each points at its component's smallest. Rounds are written to the shared folder.
    """
    edges = written(edges.select("src", "dst").filter("src <> dst"), "edges")
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
        large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        down = large.filter("src <> dst").distinct()
        smallest = down.groupBy("src").agg(F.min("dst").alias("least"))
        small = down.join(smallest, "src").select(F.when(F.col("dst") == F.col("least"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("least").alias("dst"))
        edges = written(small.distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(src, dst))"), F.sum(F.expr("cast(xxhash64(dst, src) as decimal(20,0))"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("dst").alias("node")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots.select("node", F.col("node").alias("component")))
