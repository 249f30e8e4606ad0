"""The FASTQ data source: ranges, batches of a stream, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from seedloom.sources.batches import batches
from seedloom.sources.fastq_source import load_fastq, plan_batches, stream_fastq
from seedloom.sources.reads import read_reads


@pytest.fixture(scope="module")
def reads(tmp_path_factory):
    """Two files with qualities that look like headers, junk in front, and blank lines between records."""
    rnd, folder = random.Random(9), tmp_path_factory.mktemp("fastq")
    for n, count in enumerate((120, 45)):
        text = "junk\n" if n else ""
        for i in range(count):
            s = "".join(rnd.choice("ACGTN") for _ in range(rnd.choice([0, 1, 5, 80, 150])))
            quality = "".join(rnd.choice("@+~") for _ in s)
            text += f"@r{n}.{i} d\n{s}\n+\n{quality}\n" + rnd.choice(["", "", "\n"])
        (folder / f"{n}.fq").write_text(text)
    (folder / "2.fq").write_text("")
    return folder


@pytest.mark.parametrize("size", [37, 500, 1 << 20])
def test_ranges(spark, reads, size):
    """Whatever the ranges, the records of one pass, in the same order, with the same ids."""
    want = [tuple(r) for r in read_reads(spark, f"file://{reads}/*.fq").orderBy("read_id").select("name", "len", "seq").collect()]
    got = load_fastq(spark, str(reads), size)
    assert [tuple(r) for r in got.orderBy("read_id").select("name", "len", "seq").collect()] == want and len(want) == 165
    whole = load_fastq(spark, f"file://{reads}")
    assert sorted(r.read_id for r in got.collect()) == sorted(r.read_id for r in whole.collect())


def test_broken(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@a\nAC\n+\n~~\n@b\nACGT\n+\n~\n@c\nA\n+\n~\n")
    with pytest.raises(Exception, match="no record at byte 11"):
        load_fastq(spark, str(tmp_path)).collect()


def test_stream_by_capacity(spark, reads, tmp_path):
    """Micro-batches are the greedy batches of the reads; a stopped stream goes on where it was, and no read comes twice."""
    capacity = 700
    plan_batches(spark, str(reads), capacity, f"file://{tmp_path}/batches", 500)
    rows = load_fastq(spark, str(reads))
    want = {}
    for r in batches(rows, capacity, F.col("file")).collect():
        want.setdefault((r.stream, r.batch), []).append(r.read_id)
    want = [sorted(want[k]) for k in sorted(want)]
    seen, most = [], [4]

    def keep(batch, number):
        if len(seen) == most[0]:
            raise RuntimeError("stopped")
        seen.append(sorted(r.read_id for r in batch.collect()))

    def run():
        query = stream_fastq(spark, str(reads), f"file://{tmp_path}/batches", 200).writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="stopped"):
        run()
    assert seen == want[:4]
    most[0] = 10**6
    run()
    assert seen == want and len(want) > 8
    run()
    assert seen == want
