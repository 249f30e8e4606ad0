import random
import re
from pathlib import Path

import pytest
from models import mapped, minimizers, mix, paf, vote
from pyspark.sql import functions as F

from seedloom.functions import sequence as fn
from seedloom.operators.anchors import anchors
from seedloom.operators.index import build_index, load_index, save_index
from seedloom.operators.minimizers import minimizers as spark_minimizers
from seedloom.operators.minimizers import minimizers_sql
from seedloom.operators.vote import covered, decided, top_records, vote_groups
from seedloom.params import IndexParams, MapParams, preset
from seedloom.plans.mapping import PAF, map_reads
from seedloom.plans.mapping import paf as paf_rows

NOTES = (Path(__file__).parents[1] / "FIXTURES.md").read_text()
TARGETS = [(int(a), b, c) for a, b, c in re.findall(r"^\| (\d) \| (dummy_ref_\d) \| \d+ \| `([ACGT]+)` \|", NOTES, re.M)]
READS = [(int(a), b, c) for a, b, c in re.findall(r"^\| (\d) \| (dummy_read_\d) \| \d+ \| `([ACGT]+)` \|", NOTES, re.M)]
GOLDEN = [[x.split("\t") for x in block.strip().splitlines()] for block in re.findall(r"```\n(dummy_read.*?)```", NOTES, re.S)]


def seqs(spark, rows, id_name):
    return spark.createDataFrame([(i, n, len(s), s) for i, n, s in rows], f"{id_name} int, name string, len int, seq string")


def test_hash(spark):
    xs = [0, 1, 2, 12345, 2**30 - 1]
    got = spark.createDataFrame([(x,) for x in xs], "x bigint").select("x", fn.hash64(F.col("x"), 15).alias("h")).collect()
    assert {r.x: r.h for r in got} == dict(zip(xs, [1072721685, 932509926, 792659488, 512708164, 140824814], strict=True))
    rnd = random.Random(1)
    for k in (15, 19, 21, 25):
        xs = [rnd.randrange(1 << 2 * k) for _ in range(300)] + [(1 << 2 * k) - 1, 0xFFFFFFFF % (1 << 2 * k)]
        got = spark.createDataFrame([(x,) for x in xs], "x bigint").select("x", fn.hash64(F.col("x"), k).alias("h")).collect()
        assert all(mix(r.x, k) == r.h for r in got)


@pytest.mark.parametrize("w,k,right", [(10, 15, False), (3, 4, False), (3, 4, True), (11, 21, False), (1, 1, False), (5, 2, True)])
def test_minimizers(spark, w, k, right):
    rnd = random.Random(w * 100 + k)
    rows = [(i, "".join(rnd.choice("ACGT" if i % 3 else "AC") if rnd.random() < 0.98 else "N" for _ in range(rnd.choice([0, 5, w + k - 2, w + k - 1, w + k, 90, 700])))) for i in range(40)]
    df = spark.createDataFrame(rows + [(99, None)], "id int, seq string")
    p = IndexParams(w=w, k=k, ties="right" if right else "left")
    want = {(i, h, loc, z) for i, s in rows for h, loc, z in minimizers(s, w, k, right)}
    got = spark_minimizers(df, p, "id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    sql = minimizers_sql(df, p, "id").collect()
    assert len(sql) == len(want) and {tuple(r) for r in sql} == want


def test_blocks(spark, monkeypatch):
    from seedloom.operators import minimizers as m

    rnd = random.Random(9)
    s = "".join(rnd.choice("ACGTacgtNRY") if rnd.random() < 0.1 else rnd.choice("ACGT") for _ in range(5000))
    monkeypatch.setattr(m, "BLOCK", 64)
    got = sorted((r.loc, r.hash, r.str) for r in m.minimizers(spark.createDataFrame([(1, s)], "id int, seq string"), IndexParams(), "id").collect())
    assert got == [(loc, h, z) for h, loc, z in minimizers(s, 10, 15)]


def test_windows_in_sql_shuffle_nothing(spark, tmp_path):
    """Blocks of long and unclear sequences as the kernel has them, and no exchange, sort or window in the plan."""
    rnd = random.Random(11)
    rows = [(i, "".join("N" if i % 2 and rnd.random() < 0.02 else rnd.choice("ACGT") for _ in range(n))) for i, n in enumerate([256, 270, 279, 280, 281, 282, 1100, 1500])]
    spark.createDataFrame(rows, "id int, seq string").write.parquet(f"{tmp_path}/seqs")
    df = spark.read.parquet(f"{tmp_path}/seqs")
    for p in (IndexParams(), IndexParams(ties="right"), IndexParams(256, 25), IndexParams(4, 3)):
        got = minimizers_sql(df, p, "id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spark_minimizers(df, p, "id").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Sort|Window", plan)


def test_kmer_sums(spark, monkeypatch):
    """Sums of blocks against a loop over all k-mers; no row for each k-mer is in the plan."""
    from seedloom.operators import minimizers as m

    rnd = random.Random(12)
    rows = [(i, "".join("N" if i % 2 and rnd.random() < 0.02 else rnd.choice("ACGT") for _ in range(n))) for i, n in enumerate([0, 5, 6, 63, 64, 65, 69, 70, 71, 300, 1000])] + [(20, "N" * 90), (21, "ACGT" * 9), (22, None)]
    monkeypatch.setattr(m, "BLOCK", 64)
    monkeypatch.setattr(m, "CHUNK", 500)
    got = m.kmer_sums(spark.createDataFrame(rows, "id int, seq string"), IndexParams(k=6), "id")
    want = {}
    for i, s in rows:
        found = [(h, z) for h, _, z in minimizers(s or "", 1, 6)]
        if found:
            hs = [h for h, _ in found]
            want[i] = (len(hs), sum(z for _, z in found), min(hs), max(hs), sum(hs))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert "Generate explode(sequence(0, (length(digits" not in got._jdf.queryExecution().optimizedPlan().toString()


def rows_of(spark, index_params, map_params):
    index = build_index(seqs(spark, TARGETS, "chrom_id"), index_params)
    reads = seqs(spark, READS, "read_id")
    rows = paf_rows(map_reads(reads, index, map_params), reads, index).orderBy("read_id", "rank").select(*PAF).collect()
    return [[str(x) for x in r] for r in rows]


def test_golden(spark):
    assert len(TARGETS) == 3 and len(READS) == 9
    p, m = preset("default")
    assert rows_of(spark, p, m) == []
    assert rows_of(spark, p, MapParams(reject_ties=False)) == GOLDEN[0]
    plain = rows_of(spark, p, MapParams(reject_ties=False, compat_origin=False))
    assert len(plain) == 24 and all(r in plain for r in GOLDEN[1])
    assert rows_of(spark, *preset("illumina")) == GOLDEN[2]


@pytest.mark.parametrize("case", range(4))
def test_reads_against_model(spark, case):
    rnd = random.Random(case)
    p, m = [(IndexParams(3, 7), MapParams(distance=20, reject_ties=False)), (IndexParams(3, 7, max_occ=4), MapParams(distance=60, coverage=0.0, fraction=0.5, top=3)),
            (IndexParams(2, 6), MapParams(distance=8, reject_ties=False, compat_origin=False)), (IndexParams(2, 6), MapParams(distance=300, coverage=0.0, reject_ties=False))][case]
    make = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    unit = make(60)
    targets = [(i, f"t{i}", make(200) + unit * rnd.randint(0, 3) + make(150)) for i in range(5)]
    reads = []
    for i in range(40):
        t = rnd.choice(targets)[2]
        a = rnd.randrange(len(t) - 50)
        s = "".join(c if rnd.random() < 0.97 else rnd.choice("ACGTN") for c in t[a : a + rnd.randint(5, 200)])
        reads.append((i, f"r{i % 7}", s[::-1].translate(str.maketrans("ACGT", "TGCA")) if i % 2 else s))
    keys = {}
    for i, _, s in targets:
        for h, loc, z in minimizers(s, p.w, p.k):
            keys.setdefault(h, []).append((i, loc, z))
    keys = {h: v for h, v in keys.items() if len(v) <= p.max_occ}
    index, df = build_index(seqs(spark, targets, "chrom_id"), p), seqs(spark, reads, "read_id")
    got = [[x if isinstance(x, (int, str)) else x for x in r] for r in paf_rows(map_reads(df, index, m), df, index).orderBy("read_id", "rank").select(*PAF).collect()]
    want = [row for _, n, s in reads for row in paf(n, s, mapped(s, keys, p, m), [(n_, s_) for _, n_, s_ in targets], p.k)]
    assert got == want


def test_vote_fold(spark):
    """Anchors that slide the reference, at the edge of a group and beyond it."""
    rnd = random.Random(4)
    rows, want = [], {}
    for read in range(120):
        own = set()
        for _ in range(rnd.randint(1, 60)):
            q, z, at = rnd.randrange(100, 500), rnd.randrange(2), rnd.randrange(3000)
            own.add(((rnd.randrange(2) << 30) + (q + at if z else (1 << 21) - q + at), q, z))
        own = sorted(own)
        rows += [(read, 800, t >> 30, t & (1 << 30) - 1, q, z) for t, q, z in own]
        want[read] = vote(own, 800, MapParams(reject_ties=False))
    df = spark.createDataFrame(rows, "read_id int, len int, chrom_id int, diag bigint, q_loc int, str int")
    m = MapParams(reject_ties=False)
    got = {}
    for r in decided(top_records(covered(vote_groups(df, m), m), m), m).orderBy("read_id", "rank").collect():
        got.setdefault(r.read_id, []).append((r.vt_score, r.q_start, r.q_end, r.t_start, r.t_end, r.str))
    assert got == {k: v for k, v in want.items() if v}


def test_pack(spark):
    row = spark.range(1).select(fn.pack_key(F.lit(7), F.lit(1023), F.lit(1), F.lit(2097151)).alias("k"), fn.pack_anchor(F.lit(0), F.lit(2097172), F.lit(22), F.lit(0)).alias("a"))
    back = row.select(*[c.alias(n) for n, c in fn.unpack_key(F.col("k")).items()], "a").first()
    assert tuple(back) == (7, 1023, 1, 2097151, 0x10000A00002C)


def test_index_round_trip(spark, tmp_path):
    index = build_index(seqs(spark, TARGETS, "chrom_id"), IndexParams())
    save_index(index, f"file://{tmp_path}/index", 3)
    again = load_index(spark, f"file://{tmp_path}/index")
    assert again.params == index.params and again.keys.count() == 90
    assert sorted(map(tuple, again.keys.collect())) == sorted(map(tuple, index.keys.collect()))
    assert build_index(seqs(spark, TARGETS, "chrom_id"), IndexParams(19, 19, 30, 1)).keys.count() == 3


def test_empty(spark):
    index = build_index(seqs(spark, [], "chrom_id"), IndexParams())
    reads = seqs(spark, READS, "read_id")
    assert paf_rows(map_reads(reads, index, MapParams()), reads, index).count() == 0
    none = seqs(spark, [], "read_id")
    full = build_index(seqs(spark, TARGETS, "chrom_id"), IndexParams())
    assert map_reads(none, full, MapParams()).count() == 0
    assert anchors(spark_minimizers(none.select("read_id", "len", "seq"), IndexParams(), "read_id", ("len",)), full.keys).count() == 0
