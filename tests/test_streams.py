"""Extraction that goes on where it stopped, seeds of tables in SQL, ordered text of a stream."""

import random

import numpy as np
import pytest

from seedloom.functions.registry import register
from seedloom.operators.index import build_index, load_index, save_index
from seedloom.operators.minimizers import Codes, codes_table, extract, first_picks, minimizers
from seedloom.params import IndexParams, MapParams
from seedloom.plans.mapping import map_reads, paf, paf_lines
from seedloom.sources.fastq_source import load_fastq, plan_batches, stream_fastq
from seedloom.streaming.mapping import read_stream_text, stream_text, write_batch


def dna(rnd, n, letters="ACGT"):
    return "".join(rnd.choice(letters) for _ in range(n))


@pytest.mark.parametrize("case", range(12))
def test_chained_calls(case):
    """Calls that go on give the picks of one pass, over ambiguous stretches, palindromes and ties, whatever they take at a time."""
    from seedloom.operators.minimizers import picks

    rnd = random.Random(case)
    seq = dna(rnd, rnd.choice([0, 5, 40, 900, 4000]), rnd.choice(["ACGT", "AC", "ACGTN", "AT"])) + "N" * rnd.choice([0, 600]) + dna(rnd, rnd.choice([0, 700]))
    p = IndexParams(*rnd.choice([(10, 15), (3, 4), (19, 19), (1, 5)]), ties=rnd.choice(["left", "right"]))
    codes = codes_table("host")[np.frombuffer(seq.encode(), np.uint8)]
    _, place, h, strand = picks(codes, p)
    want = list(zip(place.tolist(), h.tolist(), strand.tolist(), strict=True))
    got, begin, more = [], 0, True
    while more:
        a, b, c, more = first_picks(codes, begin, rnd.choice([1, 2, 7, 100]), p)
        got += zip(a.tolist(), b.tolist(), c.tolist(), strict=True)
        begin = got[-1][0] + 1 if got else 0
    assert got == want


def test_no_more_is_read():
    """The first seeds of a long sequence take as much of it as they need."""
    looked = []

    class Counted(Codes):
        def __getitem__(self, part):
            out = super().__getitem__(part)
            looked.append(len(out))
            return out

    data = np.frombuffer(dna(random.Random(1), 2_000_000).encode(), np.uint8)
    place, _, _, more = first_picks(Counted(codes_table("host"), data), 0, 100, IndexParams())
    assert len(place) == 100 and more and sum(looked) < 5000


def test_extract(spark):
    rnd = random.Random(2)
    rows = [(i, dna(rnd, n)) for i, n in enumerate([0, 10, 24, 25, 300, 5000])] + [(9, None)]
    df, p = spark.createDataFrame(rows, "id bigint, seq string"), IndexParams()
    want = sorted(map(tuple, minimizers(df, p, "id").collect()))
    first = extract(df, p, "id", 30).collect()
    left = {r.id: r.resume for r in first if r.resume is not None}
    again = spark.createDataFrame([(*r, left[r[0]]) for r in rows if r[0] in left], "id bigint, seq string, begin int")
    assert sorted(left) == [4, 5] and sorted(tuple(r)[:4] for r in first + extract(again, p, "id", 10**6).collect()) == want
    register(spark)
    df.repartition(2).createOrReplaceTempView("some_sequences")
    assert sorted(map(tuple, spark.sql("SELECT * FROM seeds(TABLE(some_sequences), 10, 15)").collect())) == want


def test_ordered_text_of_a_stream(spark, tmp_path):
    """The text of a stream is that of one run; a batch that runs again, or that left files without ending, changes nothing."""
    rnd = random.Random(3)
    t = [(i, f"t{i}", 4000, dna(rnd, 4000)) for i in range(4)]
    texts = [t[rnd.randrange(4)][3][a : a + 250] for a in (rnd.randrange(3700) for _ in range(60))]
    (tmp_path / "in").mkdir()
    for n, part in enumerate((texts[:35], texts[35:])):
        (tmp_path / f"in/{n}.fq").write_text("".join(f"@r{n}.{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(part)))
    save_index(build_index(spark.createDataFrame(t, "chrom_id int, name string, len int, seq string"), IndexParams()), f"file://{tmp_path}/index", 4)
    index, m, out = load_index(spark, f"file://{tmp_path}/index"), MapParams(reject_ties=False), f"file://{tmp_path}/out"
    reads = load_fastq(spark, f"file://{tmp_path}/in").select("read_id", "name", "len", "seq")
    want = [r.value for r in paf_lines(paf(map_reads(reads, index, m), reads, index)).orderBy("read_id", "rank").collect()]
    plan_batches(spark, f"file://{tmp_path}/in", 3000, f"file://{tmp_path}/batches")
    query = stream_text(stream_fastq(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/batches"), index, m, out, f"file://{tmp_path}/state")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    text = lambda: [r.value for r in read_stream_text(spark, out).orderBy("n").collect()]
    folders = sorted(p.name for p in (tmp_path / "out").glob("batch-*"))
    assert text() == want and len(want) >= 60 and len(folders) == 7
    second = reads.orderBy("read_id").limit(22).subtract(reads.orderBy("read_id").limit(11))
    write_batch(paf(map_reads(second, index, m), second, index), out, 1)
    (tmp_path / "out/batch-000000099").mkdir()
    (tmp_path / "out/batch-000000099/part-00000.txt").write_text("half\n")
    assert text() == want
