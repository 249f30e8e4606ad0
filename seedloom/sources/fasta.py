"""FASTA and FASTQ, read with Spark's text reader, and texts taken as bases.

A record's ordinal is its place in path and file order; it does not depend on how files are split into tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as fn
from .places import numbered, records
from .reads import read_reads

#: What stands between two FASTA records.
RECORD = "\n>"


def read_fasta(spark: SparkSession, path: str, id_name: str = "chrom_id", dialect: str = "targets") -> DataFrame:
    """(id, name, len, seq): multi-line records; the name ends at a space or the line's end, blank lines are ignored, what stands before the first record is skipped, a carriage return counts as a base that is ambiguous.

    Among targets a record begins where a line begins with ``>``; among reads (``read_reads``) at any
    ``>`` behind a header. Ids follow the order of paths and places. A record is one row of the text
    reader, so nothing is sorted or moved.
    """
    if dialect not in ("targets", "reads"):
        raise ValueError("dialects are targets and reads")
    if dialect == "reads":
        return read_reads(spark, path, id_name)
    rows = numbered(records(spark, path, RECORD), id_name, F.startswith("value", F.lit(">")))
    body = F.when(F.col("lead"), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    rows = rows.select(id_name, body.alias("body"))
    rest = F.substr("body", F.length(F.substring_index("body", "\n", 1)) + 2)
    rows = rows.select(id_name, fn.name_of(F.col("body")).alias("name"), F.replace(rest, F.lit("\n"), F.lit("")).alias("seq"))
    return rows.select(id_name, "name", F.length("seq").alias("len"), "seq")


def read_fastq(spark: SparkSession, path: str, id_name: str = "read_id") -> DataFrame:
    """(id, name, len, seq): ``read_reads``, which takes each record for what it begins with."""
    return read_reads(spark, path, id_name)


def from_text(df: DataFrame, id_col: str, text_col: str, id_name: str, name: str, breaks: str = "") -> DataFrame:
    """(id, name, len, seq) of a table of texts, their letters taken as bases as ``functions.sequence.bases`` does, but byte by byte."""
    table = bytearray(range(256))
    for i, c in enumerate(fn.ALPHABET.encode()):
        table[c] = table[c - 32] = b"ACGT"[i % 4]
    for c in breaks.encode():
        table[c] = ord("N")
    rest = bytes(b for b in range(256) if not (chr(b).isascii() and chr(b).isalpha()) and chr(b) not in breaks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [x.as_buffer().to_pybytes().translate(table, rest) if x.is_valid else b"" for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in seqs], pa.int32()), pa.array(seqs, pa.binary()).cast(pa.string())], names=[id_name, "name", "len", "seq"])

    own = df.select(F.col(id_col).alias(id_name), F.concat(F.lit(name), F.col(id_col).cast("string")).alias("name"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, f"`{id_name}` {own.schema[id_name].dataType.simpleString()}, name string, len int, seq string")


def to_fasta(reads: DataFrame, name: str = "name") -> DataFrame:
    """FASTA text of (name, seq)."""
    return reads.select("read_id", F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col("seq")).alias("value"))


def to_fastq(reads: DataFrame, name: str = "name") -> DataFrame:
    """FASTQ text of (name, seq), every base of the best quality."""
    return reads.select("read_id", F.concat(F.lit("@"), F.col(name), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("~"), F.length("seq"))).alias("value"))


def hex_names(reads: DataFrame, id_col: str = "read_id") -> DataFrame:
    """Reads named by their ordinal in lower-case hexadecimal."""
    return reads.withColumn("name", F.lower(F.hex(F.col(id_col))))
