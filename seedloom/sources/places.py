"""Numbers of rows in the order of their files, from facts of the files alone.

A block of a file is the work of one task, which reads it in order. So a row's number is its turn in
the block, and what the blocks and files before hold: one count for each block. Nothing is sorted,
and no row is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import if_small, written

#: Rows of a table of blocks that is broadcast, some hundred bytes each; a larger one is joined by a shuffle.
BLOCKS = 200_000


def records(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """(file, block, at, value): pieces of the files between separators. A block starts at a byte of its file; ``at`` grows within it."""
    rows = spark.read.option("lineSep", sep).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def begins(counts: DataFrame, n: str, name: str) -> DataFrame:
    """``counts`` (file, block, ...) with ``name``: the sum of ``n`` over all earlier blocks and files. Files are summed first, so that no window holds more than a file's blocks, or all files."""
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy(F.col("file").alias("file_")).agg(F.sum(n).alias("n_"))
    files = files.select("file_", F.coalesce(F.sum("n_").over(Window.orderBy("file_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin_"))
    return counts.join(files, F.col("file") == F.col("file_")).withColumn(name, F.col("begin_") + F.coalesce(F.sum(n).over(blocks), F.lit(0))).drop("file_", "begin_")


def numbered(rows: DataFrame, name: str, first_counts: Column | None = None) -> DataFrame:
    """``rows`` (file, block, at, ...) with ``name``, places from 0 in the order of files and blocks, and lead, a sign of each file's first row; within a block ``at`` goes up by one from row to row.

    ``first_counts`` says of a file's first row whether it is one at all (else it is left out).
    """
    counts = F.lit(True) if first_counts is None else first_counts
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", counts.alias("counts"))).alias("first"))
    leads = F.row_number().over(Window.partitionBy("file").orderBy("block")) == 1
    skip = (leads & ~F.col("first.counts")).cast("int")
    blocks = blocks.withColumns({"lead": F.when(leads, F.col("first.at")), "skip": skip}).withColumn("n", F.col("n") - F.col("skip"))
    least = F.col("first.at") + F.col("skip")
    blocks = begins(blocks, "n", "begin").select(F.col("file").alias("file_"), F.col("block").alias("block_"), (F.col("begin") - least).alias("begin_"), least.alias("least_"), F.col("lead").alias("lead_"))
    met = rows.join(if_small(written(blocks, "blocks"), BLOCKS), (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_"))).filter(F.col("at") >= F.col("least_"))
    return met.withColumns({name: F.col("at") + F.col("begin_"), "lead": F.col("at").eqNullSafe(F.col("lead_"))}).drop("file_", "block_", "begin_", "least_", "lead_")
