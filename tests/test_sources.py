import contextlib
import random

import pytest
from models import minimizers, records
from pyspark.sql import functions as F

from seedloom.operators.index import build_index
from seedloom.params import IndexParams, MapParams
from seedloom.plans.mapping import map_reads, paf
from seedloom.sources.batches import batches
from seedloom.sources.fasta import from_text, read_fasta, read_fastq, to_fasta
from seedloom.sources.paf import read_paf, write_paf
from seedloom.sources.places import numbered
from seedloom.sources.reads import read_reads
from seedloom.streaming.mapping import map_stream


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b"junk\n>one desc\nACGT\nAC\n\nGT\n>two\tx\nAC\r\nGT\r\n>three\n>four\nAAAA")
    (tmp_path / "b.fa").write_bytes(b">five\nCC\n")
    rows = read_fasta(spark, f"file://{tmp_path}/*.fa").orderBy("chrom_id").collect()
    assert [tuple(r) for r in rows] == [(0, "one", 8, "ACGTACGT"), (1, "two\tx", 6, "AC\rGT\r"), (2, "three", 0, ""), (3, "four", 4, "AAAA"), (4, "five", 2, "CC")]


def test_fastq(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@r0 d\nACGT\n+\n~~~~\n@r0\nCC\n+\n@@\n@r2\n\n+\n\n")
    rows = read_fastq(spark, f"file://{tmp_path}/r.fq").orderBy("read_id").collect()
    assert [tuple(r) for r in rows] == [(0, "r0", 4, "ACGT"), (1, "r0", 2, "CC"), (2, "r2", 0, "")]


def test_order_over_splits(spark, tmp_path):
    rnd = random.Random(2)
    want = [(i, f"s{i}", "".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 400)))) for i in range(500)]
    (tmp_path / "x.fa").write_text("".join(f">{n}\n{s}\n" for _, n, s in want))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        rows = read_fasta(spark, f"file://{tmp_path}/x.fa").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.chrom_id, r.name, r.seq) for r in rows) == want


@contextlib.contextmanager
def settings(spark, **conf):
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


SPLITS = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}


def mixed(rnd, n):
    """A file's text: junk, records with a line of bases and a quality, some of which look like headers, then bodies over many lines."""
    bases = lambda most: "".join(rnd.choice("ACGTNacgt\r") for _ in range(rnd.randint(0, most)))
    out = [rnd.choice(["", "; junk\n\n# more\n", "x"])]
    for i in range(n):
        s = bases(300)
        quality = "".join(rnd.choice("@>+~I") for _ in s)
        out.append(f"@f{i} d@>\n{s}\n+{rnd.choice(['', '@x', '>'])}\n{quality}\n{rnd.choice(['', '', chr(10)])}")
    for i in range(n // 2):
        body = "\n".join(bases(90) + rnd.choice(["", "", "@", "\n"]) for _ in range(rnd.randint(0, 30)))
        out.append(f">b{i}{rnd.choice(['', ' >d', chr(9) + 'x'])}\n{body}{rnd.choice([chr(10), chr(10), ''])}")
    return "".join(out)


def test_reads_in_any_block(spark, tmp_path):
    """Files of both kinds of records give, in blocks of a few lines, what one pass over their bytes gives; with the table of blocks broadcast and joined."""
    from seedloom.sources import reads

    rnd = random.Random(4)
    texts = [mixed(rnd, n) for n in (20, 0, 1, 7)] + ["", "only junk\n", "@cut\nACGT\n+\n", "@cut", ">", ">a", "\n\n>a\nAC"]
    for i, t in enumerate(texts):
        (tmp_path / f"{i:02}.fx").write_text(t, newline="")
    want = [(n, *r) for n, r in enumerate(r for t in texts for r in records(t))]
    for least in (reads.BLOCKS, 1):
        with settings(spark, **SPLITS), pytest.MonkeyPatch.context() as patch:
            patch.setattr(reads, "BLOCKS", least)
            got = read_reads(spark, f"file://{tmp_path}/*.fx")
            assert sorted(map(tuple, got.select("read_id", "name", "seq").collect())) == want and len(want) > 40
            assert got.filter(F.length("seq") != F.col("len")).isEmpty()


def test_reads_refused(spark, tmp_path):
    """A quality of another length than its bases is an error, within a block and over a block's end."""
    for n, text in enumerate(("@a\nACGT\n+\n~~~\n@b\nAC\n+\n~~\n", "@a\n" + "A" * 1000 + "\n+\n" + "~" * 999 + "\n@b\nAC\n+\n~~\n")):
        (tmp_path / f"{n}.fq").write_text(text)
        with settings(spark, **SPLITS), pytest.raises(Exception, match="quality of another length"):
            read_fastq(spark, f"file://{tmp_path}/{n}.fq").collect()


def test_targets_among_junk(spark, tmp_path):
    for n, text in enumerate(("a > b\nACGT\n>x\nAC>GT\n>>y z\n\n", "", "junk\n", "\n>z")):
        (tmp_path / f"{n}.fa").write_text(text)
    assert sorted(map(tuple, read_fasta(spark, f"file://{tmp_path}/*.fa").collect())) == [(0, "x", 5, "AC>GT"), (1, ">y", 0, ""), (2, "z", 0, "")]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_of_many_blocks(spark, tmp_path, adaptive):
    """Rows of a thousand bytes over more than sixteen tasks: every row, every number once, and no row is moved or sorted for it."""
    n = 6000
    spark.range(n).repartition(3, "id").sortWithinPartitions("id").select(F.concat(F.col("id"), F.lit(","), F.repeat(F.lit("x"), 1000)).alias("value")).write.text(f"file://{tmp_path}/t")
    want = [int(x.split(",")[0]) for p in sorted((tmp_path / "t").glob("part-*")) for x in p.read_text().splitlines()]
    with settings(spark, **SPLITS | {"spark.sql.files.maxPartitionBytes": "200000", "spark.sql.adaptive.enabled": adaptive}):
        rows = read_paf(spark, f"file://{tmp_path}/t")
        assert rows.rdd.getNumPartitions() >= 16
        assert [r.id for r in rows.select("n", F.substring_index("value", ",", 1).cast("int").alias("id")).orderBy("n").collect()] == want
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hash" not in plan and "Exchange range" not in plan and "Sort " not in plan
        rows.repartition(20).sortWithinPartitions("n").write.parquet(f"file://{tmp_path}/p")
        own = spark.read.parquet(f"file://{tmp_path}/p").select("n", F.col("_metadata.file_path").alias("file"), F.lit(0).alias("block"), F.col("_metadata.row_index").alias("at"))
        placed = numbered(own, "place").select("file", "n", "place").collect()
        assert [r.n for r in sorted(placed, key=lambda r: r.place)] == [r.n for r in sorted(placed, key=lambda r: (r.file, r.n))] and {r.place for r in placed} == set(range(n))


def test_batches(spark):
    lens = [3, 4, 1, 20, 2, 2, 5]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lens)], "read_id int, len int")
    got = [r.batch for r in batches(df, 10, F.lit(0)).orderBy("read_id").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 4]


def test_text(spark):
    df = spark.createDataFrame([(1, "Ab. é z"), (2, None)], "id int, text string")
    rows = from_text(df, "id", "text", "read_id", "d", ".").orderBy("read_id").collect()
    assert [tuple(r) for r in rows] == [(1, "d1", 4, "ACNC"), (2, "d2", 0, "")]
    assert to_fasta(spark.createDataFrame([(1, "a", "AC")], "read_id int, name string, seq string")).first().value == ">a\nAC"


def test_stream_and_paf(spark, tmp_path):
    rnd = random.Random(3)
    t = [(i, f"t{i}", 600, "".join(rnd.choice("ACGT") for _ in range(600))) for i in range(3)]
    r = [(i, f"r{i}", 200, t[i % 3][3][i * 10 : i * 10 + 200]) for i in range(12)]
    targets = spark.createDataFrame(t, "chrom_id int, name string, len int, seq string")
    reads = spark.createDataFrame(r, "read_id int, name string, len int, seq string")
    index, m = build_index(targets, IndexParams()), MapParams()
    want = paf(map_reads(reads, index, m), reads, index)
    reads.repartition(4).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    map_stream(stream, index, m, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out/*").drop("batch")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() == 12
    write_paf(want, f"file://{tmp_path}/paf", 3)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "paf").glob("part-*"))).splitlines()
    assert [x.split("\t")[0] for x in lines] == [f"r{i}" for i in range(12)]


def test_sfi(spark, tmp_path):
    """A file written by the layout, by hand, gives the index it was written from."""
    import struct

    rnd = random.Random(5)
    targets = [(i, f"t{i}", 500, "".join(rnd.choice("ACGT") for _ in range(500))) for i in range(3)]
    p = IndexParams(5, 9, 16, 20)
    index = build_index(spark.createDataFrame(targets, "chrom_id int, name string, len int, seq string"), p)
    keys = sorted((r.hash & 0xFFFF, r.hash >> 16, r.chrom_id, r.loc, r.str) for r in index.keys.collect())
    ends, n = [], 0
    for b in range(1 << 16):
        while n < len(keys) and keys[n][0] <= b:
            n += 1
        ends.append(n)
    data = b"ALOHA" + struct.pack("<5I", 5, 9, 16, 20, len(keys)) + struct.pack(f"<{1 << 16}I", *ends)
    data += struct.pack(f"<{len(keys)}Q", *[loc | c << 32 | z << 42 | s << 43 for _, s, c, loc, z in keys])
    data += struct.pack("<I", 3) + b"".join(bytes([len(name)]) + name.encode() + struct.pack("<I", size) for _, name, size, _ in targets)
    (tmp_path / "x.sfi").write_bytes(data)
    from seedloom.sources import sfi

    for buckets in (1 << 22, 1000):
        sfi.BUCKETS = buckets
        got = sfi.read_sfi(spark, f"file://{tmp_path}/x.sfi")
        assert got.params == p and sorted(map(tuple, got.keys.collect())) == sorted(map(tuple, index.keys.collect()))
        assert sorted(map(tuple, got.targets.collect())) == [t[:3] for t in targets]


def test_sql_functions(spark):
    from seedloom.functions.registry import register
    from seedloom.functions.sequence import hash64

    register(spark)
    rows = spark.range(50).withColumn("x", F.col("id") * 12345677)
    assert rows.filter(F.expr("hash64_15(x)") != hash64(F.col("x"), 15)).count() == 0
    seq = "".join(random.Random(6).choice("ACGTN") if i % 30 == 0 else random.Random(i).choice("ACGT") for i in range(300))
    got = [tuple(r) for r in spark.sql(f"SELECT * FROM minimizers('{seq}', 4, 7)").collect()]
    assert got == minimizers(seq, 4, 7)
