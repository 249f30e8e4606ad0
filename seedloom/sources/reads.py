"""Reads of FASTA and FASTQ records in one file, by an automaton over lines that starts in any block.

A file begins with bytes up to its first ``>`` or ``@``, which are skipped. A record that begins with
``@`` has a line of bases, a line that is skipped, and a quality as long as the bases; behind it stands
the next record, of either kind. Any other begins a record of bases over many lines, up to the next
``>``, wherever that stands; so ``@`` is a base there, and such records go on to the file's end.

What a line means depends on all before it. A block's lines are therefore followed from every state
in which the block may be entered: the block as a whole is a map from states to states, with the
number of records on the way. The maps, one small row for each block, are composed in file order;
then each block knows its state and the number of its first record, and its records are cut out in
one more pass. Only bodies that go over a block's end are put together after a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import if_small, written
from .places import BLOCKS, begins, records

#: States before a line: bytes to skip; a record's begin; bases, skipped line, and quality of an ``@`` record; bases of another.
JUNK, BEGIN, BASES, PLUS, QUALITY, BODY = range(6)


@dataclass
class Walk:
    """A path through a block: its state, the number of bases whose quality is to come, the name of the last record that begins in it, records begun, length of the first quality if its bases stood before the block, a sign that a quality did not fit, and records as pieces (turn, name or None, bases, whole)."""

    state: int
    need: int = -1
    name: bytes | None = None
    n: int = 0
    asked: int = -1
    bad: bool = False
    pieces: list | None = None
    body: list = field(default_factory=list)
    opened: bool = False

    def head(self, line: bytes, fastq: bool) -> None:
        self.name = line.split(b" ", 1)[0]
        self.n += 1
        if fastq:
            self.state = BASES
        else:
            self.state, self.body, self.opened = BODY, [], True

    def close(self, whole: bool) -> None:
        """Hands on the bases gathered of a body; at a block's end also a record whose bases are still to come."""
        if self.pieces is None:
            return
        if self.state == BASES and self.name is not None:
            self.pieces.append((self.n - 1, self.name, b"", False))
        if self.opened or self.body:
            self.pieces.append((self.n - 1, self.name if self.opened else None, b"".join(self.body), whole and self.opened))
        self.body, self.opened = [], False

    def line(self, line: bytes) -> None:
        if self.state == BODY:
            at = line.find(b">")
            if at < 0:
                if self.pieces is not None:
                    self.body.append(line)
                return
            if self.pieces is not None:
                self.body.append(line[:at])
            self.close(True)
            self.head(line[at + 1 :], False)
        elif self.state == BASES:
            self.state, self.need = PLUS, len(line)
            if self.pieces is not None:
                self.pieces.append((self.n - 1, self.name, line, self.name is not None))
        elif self.state == PLUS:
            self.state = QUALITY
        elif self.state == QUALITY:
            if self.need < 0:
                self.asked = len(line)
            elif self.need != len(line):
                self.bad = True
            self.state = BEGIN
        elif self.state == BEGIN:
            if line:
                self.head(line[1:], line[:1] == b"@")
        else:
            at = min((x for x in (line.find(b">"), line.find(b"@")) if x >= 0), default=-1)
            if at >= 0:
                self.head(line[at + 1 :], line[at : at + 1] == b"@")


def by_block(batches: Iterator[pa.RecordBatch], more: int) -> Iterator[tuple]:
    """(file, block, more columns, lines) of each run of rows of one block; a block over many batches comes in as many parts, the last of them marked."""
    last = None
    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rest = [batch.column(2 + i).to_pylist() for i in range(more)]
        lines = [x.as_buffer().to_pybytes() for x in batch.column(2 + more)]
        a = 0
        for b in range(1, len(files) + 1):
            if b == len(files) or files[b] != files[a] or blocks[b] != blocks[a]:
                key = (files[a], blocks[a])
                yield key, key != last, [c[a] for c in rest], lines[a:b]
                last, a = key, b


MAP = "file string, block bigint, state array<int>, need array<int>, n array<bigint>, asked array<int>, bad array<boolean>"


def block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: where each state leads."""
    key, walks = None, []

    def row() -> pa.RecordBatch:
        one = lambda get, kind: pa.array([[get(w) for w in walks]], pa.list_(kind))
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), one(lambda w: w.state, pa.int32()), one(lambda w: w.need, pa.int32()), one(lambda w: w.n, pa.int64()), one(lambda w: w.asked, pa.int32()), one(lambda w: w.bad, pa.bool_())],
                                          names=["file", "block", "state", "need", "n", "asked", "bad"])

    for own, new, _, lines in by_block(batches, 0):
        if new:
            if key:
                yield row()
            key, walks = own, [Walk(s) for s in range(6)]
        for walk in walks:
            for line in lines:
                walk.line(line)
    if key:
        yield row()


ENTRY = "file string, block bigint, state int, n bigint"


def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, state, n): the state each block is entered in, and records that begin in it. Rows come in file order; nothing is kept of a file but its state."""
    file, state, need = None, JUNK, -1
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["file"] != file:
                file, state, need = r["file"], JUNK, -1
            out.append((r["file"], r["block"], state, r["n"][state]))
            asked = r["asked"][state]
            if r["bad"][state] or (asked >= 0 and need >= 0 and asked != need):
                raise ValueError(f"{file}: a quality of another length than its bases, in the block from byte {r['block']}")
            need = r["need"][state] if r["need"][state] >= 0 else need
            state = r["state"][state]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64()))], names=["file", "block", "state", "n"])


PIECE = "id bigint, block bigint, name binary, seq binary, whole boolean"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines (file, block, state, begin, line): whole ones, and parts of those that go over a block's end."""
    key, walk, begin = None, None, 0

    def out(rows: list) -> pa.RecordBatch:
        ids, names, seqs, whole = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array([begin + i for i in ids], pa.int64()), pa.array([key[1]] * len(rows), pa.int64()), pa.array(names, pa.binary()), pa.array(seqs, pa.binary()), pa.array(whole, pa.bool_())], names=["id", "block", "name", "seq", "whole"])

    for own, new, (state, at), lines in by_block(batches, 2):
        if new:
            if walk:
                walk.close(False)
                yield out(walk.pieces)
            key, walk, begin = own, Walk(state, pieces=[]), at
        for line in lines:
            walk.line(line)
        if len(walk.pieces):
            yield out(walk.pieces)
            walk = replace(walk, pieces=[])
    if walk:
        walk.close(False)
        yield out(walk.pieces)


def read_reads(spark: SparkSession, path: str, id_name: str = "read_id") -> DataFrame:
    """(id, name, len, seq) of files of ``@`` and ``>`` records; ids follow files, in the order of their paths, and places in them.

    A name ends at a space or its line's end. A carriage return counts as a base. Blank lines between
    records are skipped, and bases or a quality that the file's end cuts off are not missed; a quality
    of another length than its bases is an error. Empty files, and such without a record, have no rows.
    """
    lines = records(spark, path, "\n").select("file", "block", "at", F.col("value").cast("binary").alias("line"))
    maps = lines.select("file", "block", "line").mapInArrow(block_maps, MAP)
    entries = maps.repartition("file").sortWithinPartitions("file", "block").mapInArrow(composed, ENTRY)
    entries = begins(written(entries, "entries"), "n", "begin")
    known = written(entries.select(F.col("file").alias("file_"), F.col("block").alias("block_"), "state", "begin"), "blocks")
    small = if_small(known, BLOCKS)
    met = lines.join(small, (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_")))
    if small is known:
        # the join moved the lines
        met = met.sortWithinPartitions("file", "block", "at")
    found = written(met.select("file", "block", "state", "begin", "line").mapInArrow(pieces, PIECE), "records")
    whole = found.filter("whole").select("id", "name", "seq")
    parts = found.filter("not whole").groupBy("id").agg(F.max("name").alias("name"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "seq"))), lambda x: x["seq"].cast("string")), "").cast("binary").alias("seq"))
    rows = whole.unionByName(parts)
    return rows.select(F.col("id").alias(id_name), F.decode("name", "UTF-8").alias("name"), F.length(F.col("seq").cast("string")).alias("len"), F.col("seq").cast("string").alias("seq"))
