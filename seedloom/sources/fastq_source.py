"""FASTQ as a data source: ``spark.read.format("fastq")`` and ``spark.readStream.format("fastq")``.

Files are cut into byte ranges; a range has the records that begin in it, and finds the first one by
itself: a line of ``@`` is a header if the line after the next begins with ``+`` and the one behind
is as long as the bases (a quality that begins with ``@`` is followed by a header, then bases, so it
is not taken for one). A record's id is its file's place and its byte, so it does not depend on ranges.

A stream takes one batch of reads a time: batches are packed under a capacity of bases, by
``plan_batches`` in Spark, which leaves the byte where each begins. Offsets are numbers of batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .batches import batches

SCHEMA = "read_id bigint, file string, at bigint, name string, len int, seq string"
#: Bytes of a range; bytes read at a time; bits of an id that hold the byte; rows handed on at a time.
RANGE, CHUNK, BYTE_BITS, ROWS = 64 << 20, 1 << 20, 40, 4096


def listed(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, or of a folder's files in the order of their names."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [x for x in fs.get_file_info(pafs.FileSelector(at)) if x.is_file and not x.base_name.startswith(("_", "."))]
    return [(scheme + x.path, x.size) for x in sorted(found, key=lambda x: x.path)]


class Lines:
    """Lines of a file from a byte on, with their places; a few may be looked at ahead."""

    def __init__(self, file: str, at: int) -> None:
        fs, path = pafs.FileSystem.from_uri(file) if "://" in file else (pafs.LocalFileSystem(), file)
        self.file, self.at, self.rest, self.ahead, self.done = fs.open_input_file(path), at, b"", [], False
        self.file.seek(at)

    def more(self) -> None:
        data = self.file.read(CHUNK)
        self.done = not data
        lines = (self.rest + data).split(b"\n")
        self.rest = b"" if self.done else lines.pop()
        if self.done and lines[-1] == b"":
            lines.pop()
        self.ahead += lines

    def peek(self, n: int) -> list[bytes]:
        while len(self.ahead) < n and not self.done:
            self.more()
        return self.ahead[:n]

    def skip(self, n: int) -> None:
        self.at += sum(len(x) + 1 for x in self.ahead[:n])
        del self.ahead[:n]


def is_record(lines: list[bytes]) -> bool:
    """Whether these lines, the first four from here on, are a record; a file's end may cut off its last line."""
    return bool(lines) and lines[0][:1] == b"@" and (len(lines) < 3 or lines[2][:1] == b"+") and (len(lines) < 4 or len(lines[3]) == len(lines[1])) and len(lines) > 1


def records_in(file: str, begin: int, end: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(byte, name, bases) of the records that begin in a range."""
    lines = Lines(file, max(0, begin - 1))
    if begin:
        # the byte before belongs to the line before, whose end is the first place to look at
        lines.peek(1)
        lines.skip(1)
    in_step = False
    while lines.at < end:
        four = lines.peek(4)
        if not four:
            return
        if is_record(four):
            in_step = True
            yield lines.at, four[0][1:].split(b" ", 1)[0], four[1]
            lines.skip(4)
        elif in_step and four[0]:
            raise ValueError(f"{file}: no record at byte {lines.at}")
        else:
            lines.skip(1)


@dataclass
class Range(InputPartition):
    place: int
    file: str
    begin: int
    end: int


def rows_of(part: Range) -> Iterator[pa.RecordBatch]:
    def out(rows: list) -> pa.RecordBatch:
        at, names, seqs = zip(*rows, strict=True)
        text = lambda x: pa.array([y.decode("utf-8", "replace") for y in x], pa.string())
        own = pa.array([part.place << BYTE_BITS | x for x in at], pa.int64())
        seqs = text(seqs)
        return pa.RecordBatch.from_arrays([own, pa.array([part.file] * len(rows)), pa.array(at, pa.int64()), text(names), pc.utf8_length(seqs), seqs], names=["read_id", "file", "at", "name", "len", "seq"])

    rows, size = [], 0
    for row in records_in(part.file, part.begin, part.end):
        rows.append(row)
        size += len(row[2])
        if len(rows) >= ROWS or size >= 8 * CHUNK:
            yield out(rows)
            rows, size = [], 0
    if rows:
        yield out(rows)


def cut(place: int, file: str, begin: int, end: int, size: int) -> list[Range]:
    return [Range(place, file, a, min(a + size, end)) for a in range(begin, end, size)]


class FastqReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Range]:
        size = int(self.options.get("rangebytes", RANGE))
        return [r for n, (file, end) in enumerate(listed(self.options["path"])) for r in cut(n, file, 0, end, size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows_of(partition)


class FastqStreamReader(DataSourceStreamReader):
    """A batch at a time. After a restart the engine plans or commits its last batch again, which tells where it was."""

    def __init__(self, options: dict) -> None:
        self.options, self.at = options, None
        self.known = []
        for file, _ in listed(options["batches"]):
            fs, path = pafs.FileSystem.from_uri(file) if "://" in file else (pafs.LocalFileSystem(), file)
            with fs.open_input_stream(path) as f:
                self.known += map(json.loads, f.read().splitlines())
        self.known.sort(key=lambda x: x["number"])

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        self.at = min((self.at or 0) + 1, len(self.known))
        return {"batch": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = end["batch"] if self.at is None else self.at
        size = int(self.options.get("rangebytes", RANGE))
        return [r for x in self.known[start["batch"] : end["batch"]] for r in cut(x["place"], x["file"], x["begin"], x["end"], size)]

    def commit(self, end: dict) -> None:
        self.at = end["batch"] if self.at is None else self.at

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows_of(partition)


class FastqSource(DataSource):
    """Options: path, a file or a folder, in any storage that Arrow reads; rangeBytes; batches, the folder of ``plan_batches``, for streams."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)

    def streamReader(self, schema) -> FastqStreamReader:
        return FastqStreamReader(self.options)


def load_fastq(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("rangeBytes", range_bytes).load(path)


def plan_batches(spark: SparkSession, path: str, capacity: int, out: str, range_bytes: int = RANGE) -> DataFrame:
    """(number, place, file, begin, end): the batches of reads in ``path``, by the greedy packing of ``batches``, each file by itself; written under ``out`` for a stream. A row for each batch comes to the stream's driver, no read does."""
    reads = load_fastq(spark, path, range_bytes).select("file", F.col("at").alias("read_id"), "len", F.shiftright("read_id", BYTE_BITS).alias("place"))
    places = {file: (n, size) for n, (file, size) in enumerate(listed(path))}
    packs = batches(reads, capacity, F.col("place")).groupBy("stream", "batch").agg(F.min("read_id").alias("begin")).collect()
    packs = sorted((r.stream, r.begin) for r in packs)
    by_place = {n: (file, size) for file, (n, size) in places.items()}
    rows = [(i, n, by_place[n][0], begin, packs[i + 1][1] if i + 1 < len(packs) and packs[i + 1][0] == n else by_place[n][1]) for i, (n, begin) in enumerate(packs)]
    table = spark.createDataFrame(rows, "number bigint, place int, file string, begin bigint, end bigint")
    table.coalesce(1).write.mode("overwrite").json(out)
    return table


def stream_fastq(spark: SparkSession, path: str, batch_folder: str, range_bytes: int = RANGE) -> DataFrame:
    """A stream of reads whose micro-batches are the batches of ``plan_batches``."""
    spark.dataSource.register(FastqSource)
    return spark.readStream.format("fastq").option("batches", batch_folder).option("rangeBytes", range_bytes).load(path)
