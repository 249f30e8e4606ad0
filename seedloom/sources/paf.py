"""PAF output in read order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.mapping import paf_lines
from .places import numbered, records


def write_paf(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """Text files whose names order them as the reads; ranges are sorted apart, so no task sees all rows."""
    lines = paf_lines(rows)
    ranged = lines.repartitionByRange(partitions, "read_id", "rank") if partitions else lines.repartitionByRange("read_id", "rank")
    ranged.sortWithinPartitions("read_id", "rank").select("value").write.mode("overwrite").text(path)


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): lines of text files in the order of their names."""
    return numbered(records(spark, path, "\n"), "n").select("n", "value")
