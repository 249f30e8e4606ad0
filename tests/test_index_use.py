"""Saved indexes in use, the filter of hashes, and the vote's kernel."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from seedloom.operators import fold
from seedloom.operators.anchors import anchors
from seedloom.operators.index import build_index, load_index, rare, save_index
from seedloom.operators.minimizers import minimizers
from seedloom.operators.presence import bit_words, may_hold, presence, size_for
from seedloom.operators.sketch import row_bits, suspected
from seedloom.operators.vote import covered, top_records, vote_groups, vote_groups_sql
from seedloom.params import IndexParams, MapParams
from seedloom.plans.mapping import map_reads, paf


@pytest.fixture(scope="module")
def small(spark):
    rnd = random.Random(8)
    dna = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    t = [(i, f"t{i}", 3000, dna(3000)) for i in range(6)] + [(6, "short", 3, "ACG"), (7, "none", 0, None), (8, "n", 40, "N" * 40)]
    r = [(i, f"r{i}", 300, t[i % 6][3][50 * i : 50 * i + 300] if i % 3 else dna(300)) for i in range(40)]
    return spark.createDataFrame(t, "chrom_id int, name string, len int, seq string"), spark.createDataFrame(r, "read_id bigint, name string, len int, seq string")


@pytest.fixture(scope="module")
def saved(spark, small, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/saved"
    save_index(build_index(small[0], IndexParams()), path, 5)
    return load_index(spark, path)


def test_targets_beside_seeds(spark, small):
    """Targets without seeds are targets as well, and no target is read again for its name."""
    index = build_index(small[0], IndexParams())
    assert sorted(map(tuple, index.targets.collect())) == sorted(map(tuple, small[0].select("chrom_id", "name", "len").collect()))
    assert "MapInArrow" not in index.targets._jdf.queryExecution().executedPlan().toString()
    plain = minimizers(small[0].select("chrom_id", "seq"), IndexParams(), "chrom_id")
    assert sorted(map(tuple, index.keys.collect())) == sorted(map(tuple, plain.select("hash", "chrom_id", "loc", "str").collect()))


def test_no_exchange_of_a_saved_index(spark, small, saved):
    fresh = build_index(small[0], saved.params)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        seeds = minimizers(small[1].select("read_id", "len", "seq"), saved.params, "read_id", ("len",))
        plan = anchors(seeds, saved.keys)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(hash") == 1 and "Bucketed: true" in plan
        # the one exchange is that of the seeds
        assert "MapInArrow" in plan[plan.index("Exchange hashpartitioning(hash") :] and plan.index("Bucketed: true") < plan.index("Exchange hashpartitioning(hash") or "FileScan" not in plan[plan.index("Exchange hashpartitioning(hash") : plan.index("MapInArrow")]
        m = MapParams(reject_ties=False)
        got, want = (sorted(map(tuple, paf(map_reads(small[1], i, m), small[1], i).collect())) for i in (saved, fresh))
        assert got == want and len(want) > 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_filter_before_the_shuffle(spark, small, saved):
    """Every seed that meets a key passes; of the others few do. Anchors are the same."""
    reads = small[1].select("read_id", "len", "seq")
    every, some = (minimizers(reads, saved.params, "read_id", ("len",), w) for w in (None, saved.within))
    met = every.join(saved.keys.select("hash").distinct(), "hash", "left_semi").count()
    assert met <= some.count() < met + 0.1 * every.count() and some.count() < 0.8 * every.count()
    a, b = (sorted(map(tuple, anchors(s, saved.keys).collect())) for s in (every, some))
    assert a == b and a


def test_filters_merge(spark):
    rnd = random.Random(1)
    for hash_bits in (30, 42):
        sets = [[rnd.randrange(1 << hash_bits) for _ in range(500)] for _ in range(2)]
        bits = size_for(1000, hash_bits)
        one, two, both = (bit_words(presence(spark.createDataFrame([(h,) for h in x], "hash bigint"), bits, hash_bits), bits) for x in (*sets, sets[0] + sets[1]))
        assert (one | two == both).all()
        assert may_hold(both, np.array(sets[0] + sets[1], np.uint64), hash_bits).all()
        assert may_hold(both, np.array([rnd.randrange(1 << hash_bits) for _ in range(2000)], np.uint64), hash_bits).mean() < 0.15
    assert size_for(10**12, 50) == 27 and size_for(0, 8) == 8


def test_only_suspected_hashes_are_counted(spark):
    """Keys are those of counting every hash; what is counted falls with the share of frequent hashes."""
    rnd = random.Random(6)
    rows = [rnd.randrange(1 << 30) for _ in range(20_000)] + [h for h in (rnd.randrange(1 << 30) for _ in range(12)) for _ in range(rnd.choice([49, 50, 51, 400]))]
    keys = spark.createDataFrame([(h, i) for i, h in enumerate(rows)], "hash bigint, loc int").repartition(5)
    for limit in (1, 10, 50, 10**6):
        want = sorted(map(tuple, rare(keys, limit).collect()))
        assert sorted(map(tuple, rare(keys, limit, 30).collect())) == want
    bits = row_bits(len(rows), 50, 30)
    over = {h for h, n in Counter(rows).items() if n > 50}
    got = [r.hash for r in suspected(keys, 50, bits, 30).collect()]
    assert over <= set(got) and len(got) < 0.15 * len(rows)
    assert row_bits(10**12, 10, 42) is None and row_bits(10**8, 500, 42) == 21


def one_by_one(T, q, line, reach):
    out, state = [], None
    for i, (t, x, z) in enumerate(zip(T.tolist(), q.tolist(), line.tolist(), strict=True)):
        if state is None or state[0] != z or t > state[1] + reach:
            out.append(i)
            state = [z, t, x]
        elif x < state[2]:
            state = [z, t, x]
    return out


@pytest.mark.parametrize("case", range(40))
def test_group_starts(case):
    rng = np.random.default_rng(case)
    n, reach = int(rng.integers(0, 400)), int(rng.integers(1, 60))
    line, T, q = np.sort(rng.integers(0, 4, n)), rng.integers(0, int(rng.integers(50, 6000)), n), rng.integers(0, int(rng.integers(1, 500)), n)
    order = np.lexsort((q, T, line))
    line, T, q = line[order], T[order], q[order]
    assert fold.starts(T, q, line, reach).tolist() == one_by_one(T, q, line, reach)


@pytest.mark.parametrize("shape", ["random", "falling", "rising", "level", "saw"])
def test_a_million_anchors_in_one_stretch(shape):
    """One read, one stretch: time grows with the anchors."""
    n, took = 1_000_000, []
    for size in (n // 4, n):
        rng = np.random.default_rng(1)
        T = np.cumsum(rng.integers(0, 3, size))
        q = {"random": rng.integers(0, 10**6, size), "falling": np.arange(size)[::-1].copy(), "rising": np.arange(size), "level": np.zeros(size, np.int64), "saw": np.arange(size) % 1000}[shape]
        began = time.perf_counter()
        got = fold.starts(T, q, np.zeros(size, np.int64), 700)
        took.append(time.perf_counter() - began)
    assert got.tolist() == one_by_one(T, q, np.zeros(n, np.int64), 700)
    assert took[1] < 4 * 4 * took[0] + 1


@pytest.mark.parametrize("origin", [True, False])
@pytest.mark.parametrize("batch", ["3", "10000"])
def test_kernel_against_sql(spark, origin, batch):
    """Reads over many batches, reads of one strand, anchors at the origin."""
    rnd, rows = random.Random(5), set()
    for read in range(60):
        for _ in range(rnd.choice([1, 2, 40, 200])):
            rows.add((read, 100, rnd.randrange(2), rnd.choice([rnd.randrange(900), rnd.randrange(3000)]) + (1 << 21) * rnd.randrange(2), rnd.randrange(90), rnd.randrange(2)))
    df = spark.createDataFrame(sorted(rows), "read_id bigint, len int, chrom_id int, diag bigint, q_loc int, str int").dropDuplicates(["read_id", "chrom_id", "diag", "q_loc", "str"]).repartition(3)
    m, old = MapParams(distance=300, compat_origin=origin), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = vote_groups(df, m)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, vote_groups_sql(df, m).select(*got.columns).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert vote_groups(df.limit(0), m).count() == 0
    plan = top_records(covered(got, m), m)._jdf.queryExecution().executedPlan().toString()
    # once before the groups are dealt, once behind
    assert plan.count("WindowGroupLimit") == 2
