"""Evaluation: accuracy curves, averages of profile records, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def simulated(targets: DataFrame, length: int, every: int, id_name: str = "read_id") -> DataFrame:
    """(id, name, len, seq, origin, start): reads cut from targets (chrom_id, seq) at fixed steps, every other one reverse complemented, with one base in 40 changed by a rule."""
    cut = targets.filter(F.length("seq") >= length).select("chrom_id", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - length) / every).cast("int"))).alias("i"))
    piece = F.substr("seq", F.col("i") * every + 1, F.lit(length))
    noise = F.array_join(F.transform(F.split(piece, ""), lambda c, j: F.when(F.pmod(j * 7 + F.col("i"), F.lit(40)) == 0, F.translate(c, "ACGT", "CGTA")).otherwise(c)), "")
    seq = F.when(F.col("i") % 2 == 1, F.reverse(F.translate(noise, "ACGT", "TGCA"))).otherwise(noise)
    rid = F.col("chrom_id").cast("bigint") * 1_000_000 + F.col("i")
    return cut.select(rid.alias(id_name), F.concat(F.lit("sim"), rid.cast("string")).alias("name"), F.lit(length).alias("len"), seq.alias("seq"), F.col("chrom_id").alias("origin"), (F.col("i") * every).alias("start"))


def pieces(targets: DataFrame, length: int, id_name: str = "read_id") -> DataFrame:
    """(id, name, len, seq, origin, start): targets (chrom_id, seq) cut into reads whose origin is known; every base is in one of them, and the last of a target may be short."""
    cut = targets.filter(F.length("seq") > 0).select("chrom_id", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / length).cast("int"))).alias("i"))
    rid = F.col("chrom_id").cast("bigint") * 1_000_000 + F.col("i")
    rows = cut.select(rid.alias(id_name), F.concat(F.lit("piece"), rid.cast("string")).alias("name"), F.substr("seq", F.col("i") * length + 1, F.lit(length)).alias("seq"), F.col("chrom_id").alias("origin"), (F.col("i") * length).alias("start"))
    return rows.select(id_name, "name", F.length("seq").alias("len"), "seq", "origin", "start")


def accuracy_curve(primary: DataFrame, total: int) -> DataFrame:
    """(mapq, n_mapped, n_wrong, cum_mapped, cum_err, mapped_share) of primary records (mapq, wrong), from the highest quality down."""
    by = primary.groupBy("mapq").agg(F.count(F.lit(1)).alias("n_mapped"), F.sum(F.col("wrong").cast("bigint")).alias("n_wrong"))
    # at most 61 rows are left here
    down = Window.orderBy(F.desc("mapq")).rowsBetween(Window.unboundedPreceding, 0)
    rows = by.withColumn("cum_mapped", F.sum("n_mapped").over(down)).withColumn("cum_wrong", F.sum("n_wrong").over(down))
    return rows.select(F.col("mapq").cast("bigint").alias("mapq"), "n_mapped", "n_wrong", "cum_mapped", (F.col("cum_wrong") / F.col("cum_mapped")).alias("cum_err"), (F.col("cum_mapped") / F.lit(total)).alias("mapped_share"))


def mapq_zero(rows: DataFrame) -> DataFrame:
    """Primary rows of quality 0: the first row of each read in output order."""
    return rows.filter((F.col("rank") == 0) & (F.col("mapq") == 0))


def phase_averages(log: DataFrame, label: str, ns: Column) -> DataFrame:
    """(label, n, avg_ms) of records of nanoseconds."""
    return log.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), (F.avg(ns) / 1e6).alias("avg_ms"))


def time_per_base(log: DataFrame, ms: Column, bases: Column) -> DataFrame:
    """``log`` with ms_per_base: the time of a batch over its bases, null for an empty one."""
    return log.withColumn("ms_per_base", ms / F.nullif(bases, F.lit(0)))


def histogram(values: DataFrame, col: str, width: int) -> DataFrame:
    """(bin, n): bins of a width, named by their middle."""
    return values.groupBy((F.floor(F.col(col) / width) * width + width // 2).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mean_sd(values: DataFrame, col: str) -> DataFrame:
    """Mean and population standard deviation."""
    return values.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("sd"))


def successive_differences(values: DataFrame, col: str, slices: int, bits: int) -> DataFrame:
    """(d): differences of successive distinct values below 2^bits. Values are dealt into slices of their range; each slice's first value takes the greatest value of the slices before it."""
    low = bits - (slices - 1).bit_length()
    rows = values.select(F.col(col).alias("v")).distinct().withColumn("slice", F.shiftright("v", low))
    tops = rows.groupBy("slice").agg(F.max("v").alias("top"))
    tops = tops.select(F.col("slice").alias("s"), F.max("top").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("below"))
    rows = rows.join(F.broadcast(tops), F.col("slice") == F.col("s"))
    last = F.coalesce(F.lag("v").over(Window.partitionBy("slice").orderBy("v")), F.col("below"))
    return rows.select((F.col("v") - last).alias("d")).filter("d is not null")
