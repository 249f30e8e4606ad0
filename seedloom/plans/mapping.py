"""From reads and an index to mapping records and PAF rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as fn
from ..operators.anchors import anchors
from ..operators.index import SeedIndex
from ..operators.minimizers import minimizers
from ..operators.vote import covered, decided, top_records, vote_groups, vote_seeds
from ..params import MapParams


def groups_of(reads: DataFrame, index: SeedIndex, p: MapParams, only_covered: bool = False) -> DataFrame:
    """Vote groups of reads (read_id, len, seq). With an index that has postings, seeds are looked up where they are made, and only where ids repeat are seeds dealt by read. only_covered: those that ``covered`` leaves, at least."""
    seeds = minimizers(reads.select("read_id", "len", "seq"), index.params, "read_id", ("len",), index.within)
    if index.postings is None:
        return vote_groups(anchors(seeds, index.keys), p)
    if not reads.groupBy("read_id").count().filter("count > 1").isEmpty():
        seeds = seeds.repartition("read_id").sortWithinPartitions("read_id")
    return vote_seeds(seeds, index.postings, p, only_covered)


def map_reads(reads: DataFrame, index: SeedIndex, p: MapParams) -> DataFrame:
    """(read_id, rank, vt_score, q_start, q_end, chrom_id, t_start, t_end, str, best, second) of reads (read_id, len, seq). Where the index has a filter of its hashes, seeds that meet no key are left out before any is shuffled."""
    records = decided(top_records(covered(groups_of(reads, index, p, True), p), p), p)
    return records.select("read_id", "rank", "vt_score", "q_start", "q_end", "chrom_id", fn.position_of(F.col("t_start")).alias("t_start"), fn.position_of(F.col("t_end")).alias("t_end"), "str", "best", "second")


def paf(records: DataFrame, reads: DataFrame, index: SeedIndex) -> DataFrame:
    """PAF columns with read_id and rank; starts are moved to a seed's first base and wrap as 32-bit numbers."""
    k = index.params.k
    back = lambda c: fn.unsigned32(F.col(c) - (k - 1))
    names = reads.select("read_id", F.col("name").alias("qname"), F.col("len").alias("qlen"))
    targets = index.targets.select("chrom_id", F.col("name").alias("tname"), F.col("len").alias("tlen"))
    rows = records.join(names, "read_id").join(targets, "chrom_id")
    start = back("t_start")
    return rows.select(
        "read_id", "rank", "qname", "qlen", back("q_start").alias("qstart"), F.col("q_end").alias("qend"), fn.strand_sign(F.col("str")).alias("strand"), "tname", "tlen", start.alias("tstart"), F.col("t_end").alias("tend"),
        (F.col("vt_score") * k).alias("nmatch"), fn.unsigned32(F.col("t_end") - start).alias("blen"), F.when(F.col("rank") == 0, fn.mapq(F.col("best"), F.col("second"))).otherwise(0).alias("mapq"), F.concat(F.lit("vt:i:"), F.col("vt_score")).alias("vt"),
    )


PAF = ("qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "nmatch", "blen", "mapq", "vt")


def paf_lines(rows: DataFrame) -> DataFrame:
    """(read_id, rank, value): PAF text."""
    return rows.select("read_id", "rank", F.concat_ws("\t", *PAF).alias("value"))
