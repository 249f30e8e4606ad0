"""Seed index: minimizers of the targets whose hash is not too frequent."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as fn
from ..params import IndexParams
from ..shared import if_small, written
from .minimizers import minimizers
from .postings import Postings, saved
from .presence import bit_words, presence, size_for
from .sketch import row_bits, suspected


#: Frequent hashes up to which they are broadcast, so that the keys are not shuffled to leave them out.
FEW = 1 << 20


@dataclass(frozen=True)
class SeedIndex:
    """keys (hash, chrom_id, loc, str); targets (chrom_id, name, len); within: the filter of the keys' hashes, where the index has one (``operators.presence``); postings: the keys as ``operators.postings`` looks them up, where they are saved so."""

    keys: DataFrame
    targets: DataFrame
    params: IndexParams
    within: np.ndarray | None = None
    postings: Postings | None = None


def rare(keys: DataFrame, max_occ: int, hash_bits: int | None = None) -> DataFrame:
    """Keys whose hash occurs at most ``max_occ`` times. Counts are made before the shuffle, and only the frequent hashes, few as they are, meet the keys.

    ``hash_bits``, of keys in a written table, has a sketch say first which hashes may be frequent, so
    that no others are counted and shuffled; where no sketch of bounded size could say, all are.
    """
    bits = row_bits(keys.count(), max_occ, hash_bits) if hash_bits else None
    counted = keys if bits is None else suspected(keys, max_occ, bits, hash_bits)
    frequent = written(counted.groupBy("hash").count().filter(F.col("count") > max_occ).select("hash"), "frequent")
    return keys.join(if_small(frequent, FEW), "hash", "left_anti")


def seed_table(targets: DataFrame, p: IndexParams) -> DataFrame:
    """Seeds of targets (chrom_id, name, len, seq) in the shared folder, and in rows without a hash the targets' names and lengths: targets are read once for both, however many indexes are made of it."""
    return written(minimizers(targets.select("chrom_id", "name", "len", "seq"), p, "chrom_id", ("name", "len"), marks=True), "seeds")


def index_of(table: DataFrame, p: IndexParams) -> SeedIndex:
    """Index of a ``seed_table`` of the same w, k, ties and dialect."""
    keys = rare(table.filter("hash is not null").select("hash", "chrom_id", "loc", "str"), p.max_occ, 2 * p.k)
    return SeedIndex(keys, table.filter("hash is null").select("chrom_id", "name", "len"), p)


def build_index(targets: DataFrame, p: IndexParams) -> SeedIndex:
    """Index of targets (chrom_id, name, len, seq)."""
    return index_of(seed_table(targets, p), p)


def with_postings(index: SeedIndex) -> SeedIndex:
    """For collections that are mapped onto themselves, where anchors are dozens of times as many as seeds: the index with its keys saved to be looked up, so that no anchor is shuffled. In a shared folder that is not mounted the index stays as it is."""
    return replace(index, postings=saved(index.keys))


def save_index(index: SeedIndex, path: str, partitions: int = 200, layout: str = "buckets") -> None:
    """Keys, targets, parameters and the filter of the keys' hashes.

    Layout ``buckets``: keys are dealt by hash, a file for each bucket and sorted in it, so that a join
    by hash moves the seeds alone, however often the index is used. Layout ``order``: keys in the
    order of bucket id, seed id, target and place, in ranges, so that a reader's filters prune.
    """
    if layout not in ("buckets", "order"):
        raise ValueError("layouts are buckets and order")
    bits, spark = index.params.bucket_bits, index.keys.sparkSession
    if layout == "order":
        order = [fn.bucket_id(F.col("hash"), bits), fn.seed_id(F.col("hash"), bits), F.col("chrom_id"), F.col("loc")]
        index.keys.repartitionByRange(partitions, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/keys")
    else:
        name = f"seedloom_save_{uuid.uuid4().hex}"
        index.keys.repartition(partitions, "hash").write.bucketBy(partitions, "hash").sortBy("hash").format("parquet").option("path", f"{path}/keys").saveAsTable(name)
        # the table names the files to the writer; they stay
        spark.sql(f"DROP TABLE {name}")
    keys = spark.read.parquet(f"{path}/keys")
    size = size_for(keys.count(), 2 * index.params.k)
    presence(keys, size, 2 * index.params.k).write.mode("overwrite").parquet(f"{path}/filter")
    index.targets.write.mode("overwrite").parquet(f"{path}/targets")
    about = asdict(index.params) | {"buckets": partitions if layout == "buckets" else 0, "filter_bits": size}
    spark.createDataFrame([about]).coalesce(1).write.mode("overwrite").json(f"{path}/params")


def load_index(spark: SparkSession, path: str) -> SeedIndex:
    """A saved index; one in buckets as a table that says so."""
    row = spark.read.json(f"{path}/params").first().asDict()
    buckets, size = row.pop("buckets"), row.pop("filter_bits")
    params = IndexParams(**row)
    if buckets:
        name = f"seedloom_keys_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} (hash BIGINT, chrom_id {spark.read.parquet(f'{path}/keys').schema['chrom_id'].dataType.simpleString()}, loc INT, str INT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {buckets} BUCKETS LOCATION '{path}/keys'")
        keys = spark.table(name)
    else:
        keys = spark.read.parquet(f"{path}/keys")
    return SeedIndex(keys, spark.read.parquet(f"{path}/targets"), params, bit_words(spark.read.parquet(f"{path}/filter"), size))


def bucket_map(index: SeedIndex) -> DataFrame:
    """(bucket_id, end): keys in buckets up to and with this one; empty buckets are left out.

    Running sums of many buckets are taken within slices of the bucket ids, each from its slice's start.
    """
    bits = index.params.bucket_bits
    low = max(0, bits - 10)
    counts = index.keys.groupBy(fn.bucket_id(F.col("hash"), bits).alias("bucket_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("slice", F.shiftright("bucket_id", low))
    slices = counts.groupBy("slice").agg(F.sum("n").alias("s"))
    begin = slices.select(F.col("slice").alias("at"), F.coalesce(F.sum("s").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    upto = Window.partitionBy("slice").orderBy("bucket_id").rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(F.broadcast(begin), F.col("slice") == F.col("at")).select("bucket_id", (F.sum("n").over(upto) + F.col("begin")).alias("end"))


#: Bits of a memory section's bytes.
SECTION = 29


def sections(n: Column, bits: int) -> Column:
    """Sections of 2^bits entries that ``n`` entries take."""
    return F.ceil(n / F.lit(1 << bits)).cast("bigint")


def index_stats(targets: DataFrame, p: IndexParams) -> DataFrame:
    """One row: sequences, bases, minimizers, kept keys and distinct hashes, and memory sections that the keys (8 bytes each) and the map of buckets (4 bytes each) take. Targets are read once: their lengths are counted with the seeds, under no hash."""
    seeds = minimizers(targets.select("chrom_id", "len", "seq"), p, "chrom_id", ("len",), marks=True)
    by_hash = seeds.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"))
    own, n = F.col("hash").isNotNull(), F.col("n")
    total = lambda which, what: F.coalesce(F.sum(F.when(which, what)), F.lit(0)).cast("bigint")
    counted = by_hash.agg(
        total(~own, n).alias("n_targets"), total(~own, F.col("bases")).alias("n_bases"), total(own, n).alias("n_minimizers"), F.count(F.when(own, 1)).alias("n_hashes"),
        total(own & (n <= p.max_occ), n).alias("n_keys"), F.count(F.when(own & (n <= p.max_occ), 1)).alias("n_kept"),
    )
    return counted.withColumn("key_sections", sections(F.col("n_keys"), SECTION - 3)).withColumn("map_sections", sections(F.lit(1 << p.bucket_bits), SECTION - 2))
