"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings of writes: shuffle files of a finished query go (without it they stay until the driver happens to collect its garbage), and rows with whole texts go to Python in batches of bounded size.
WRITES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, as in tests, in a folder of this application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and not lost with an executor. Its shuffle files go with its query."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    before = {k: spark.conf.get(k, None) for k in WRITES}
    try:
        for k, v in WRITES.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it has at most so many rows, else itself."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files have fewer splits than that; one row group is one task's work, however many cores there are. Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def save_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays as one file of a mounted folder; it appears whole, so that a task may run twice."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64).tobytes())
        for x in arrays:
            out.write(np.ascontiguousarray(x))
            out.write(bytes(-x.nbytes % 8))
    fs.move(part, f"{path}/{name}")


def load_arrays(folder: str, name: str) -> list[np.ndarray]:
    """The arrays of a file, as bytes, mapped into memory."""
    data = np.memmap(f"{pafs.FileSystem.from_uri(folder)[1]}/{name}", np.uint8, "r").view(np.ndarray)
    at = 8 * (int(data[:8].view(np.int64)[0]) + 1)
    out = []
    for size in data[8:at].view(np.int64).tolist():
        out.append(data[at : at + size])
        at += size + -size % 8
    return out
