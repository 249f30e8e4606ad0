"""Reads arrive in files or batches; every micro-batch is mapped against the same index and leaves PAF rows or text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import SeedIndex
from ..params import MapParams
from ..plans.mapping import map_reads, paf
from ..sources.paf import write_paf
from ..sources.places import numbered, records


def map_stream(reads: DataFrame, index: SeedIndex, p: MapParams, out: str, checkpoint: str) -> StreamingQuery:
    """Maps a stream of reads (read_id, name, len, seq) into Parquet under ``out``, a folder for each batch, so that a batch that runs again replaces what it left.

    Nothing is kept between reads, so there is no state and no watermark. With an index that was saved
    in buckets no batch moves the index.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = paf(map_reads(batch, index, p), batch, index)
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:09}")

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batch(rows: DataFrame, out: str, number: int) -> None:
    """PAF text of one batch, in files whose names order them by read and rank within ``out/batch-<number>``, and then its line in the manifest. Run again, it replaces both."""
    folder = f"batch-{number:09}"
    write_paf(rows, f"{out}/{folder}")
    spark = rows.sparkSession
    spark.createDataFrame([(number, folder)], "number bigint, folder string").coalesce(1).write.mode("overwrite").json(f"{out}/manifest/{folder}")


def stream_text(reads: DataFrame, index: SeedIndex, p: MapParams, out: str, checkpoint: str) -> StreamingQuery:
    """Maps a stream of reads into PAF text in the order of (batch, read, rank), whatever order tasks and runs end in."""

    def one(batch: DataFrame, number: int) -> None:
        own = batch.select("read_id", "name", "len", "seq")
        write_batch(paf(map_reads(own, index, p), own, index), out, number)

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def read_stream_text(spark: SparkSession, out: str) -> DataFrame:
    """(n, value): lines of all batches that the manifest names; what a batch left that did not end is not read."""
    done = sorted(r.folder for r in spark.read.schema("number bigint, folder string").json(f"{out}/manifest/*").collect())
    lines = records(spark, [f"{out}/{x}" for x in done], "\n") if done else spark.createDataFrame([], "file string, block bigint, at bigint, value string")
    return numbered(lines, "n").select("n", "value")
