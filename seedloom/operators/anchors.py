"""Anchors: seeds of reads met with keys of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as fn


def anchors(seeds: DataFrame, keys: DataFrame) -> DataFrame:
    """(read_id, len, chrom_id, diag, q_loc, str) of seeds (read_id, len, hash, loc, str) and keys: one for each pair of equal hashes.

    The join is left to the optimizer: an index of unknown size is not broadcast by hint, and the keys' frequency filter bounds how often a seed is met.
    """
    s = seeds.select("read_id", "len", "hash", F.col("loc").alias("q_loc"), F.col("str").alias("q_str"))
    met = s.join(keys, "hash").withColumn("strand", F.col("str").bitwiseXOR(F.col("q_str")))
    diag = fn.diagonal(F.col("loc").cast("bigint"), F.col("q_loc").cast("bigint"), F.col("strand"))
    return met.select("read_id", "len", "chrom_id", diag.alias("diag"), "q_loc", F.col("strand").alias("str"))
