"""Seeds met with an index's postings give what the join gives, and no anchor goes through a plan."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from seedloom.operators import postings, vote
from seedloom.operators.index import build_index, with_postings
from seedloom.params import IndexParams, MapParams
from seedloom.plans.mapping import groups_of, map_reads, paf

DATA = "/root/testdata/sf0.001"


def collection(spark, first: int = 0):
    rnd = random.Random(3)
    make = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    units = [make(60) for _ in range(4)]
    texts = [make(rnd.randrange(40)) + "".join(rnd.choice(units) + make(rnd.randrange(9)) for _ in range(rnd.choice([0, 1, 5, 40]))) for _ in range(50)]
    rows = [(first + 7 * i, f"t{i}", len(s), s) for i, s in enumerate(texts)]
    return spark.createDataFrame(rows, "id bigint, name string, len int, seq string").repartition(3)


@pytest.mark.parametrize("origin", [True, False])
@pytest.mark.parametrize("sizes", [(1, 1, 100), (50, 300, 100), (1 << 16, 1 << 20, 1 << 22)])
def test_same_groups_as_the_join(spark, monkeypatch, origin, sizes):
    monkeypatch.setattr(vote, "SEEDS", sizes[0])
    monkeypatch.setattr(vote, "ANCHORS", sizes[1])
    own, p, m = collection(spark), IndexParams(3, 7), MapParams(distance=30, compat_origin=origin)
    index = build_index(own.withColumnRenamed("id", "chrom_id"), p)
    looked = index.__class__(index.keys, index.targets, p, None, postings.saved(index.keys, sizes[2]))
    reads = own.withColumnRenamed("id", "read_id")
    for of in (reads, reads.union(reads.limit(5))):
        want, got = groups_of(of, index, m), groups_of(of, looked, m)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        few = groups_of(of, looked, m, True)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, vote.covered(want, m).collect()))
    none = build_index(own.withColumnRenamed("id", "chrom_id").limit(0), p)
    assert groups_of(reads, with_postings(none), m).count() == 0


def test_order_where_64_bits_do_not_hold_it():
    rng = np.random.default_rng(2)
    cols = [rng.integers(0, 9, 500), rng.integers(0, 3, 500) << 61, rng.integers(0, 1 << 22, 500), rng.integers(0, 1 << 40, 500)]
    for q in (cols[3], cols[3] & 255):
        order = np.lexsort((q, *cols[2::-1]))
        got = postings.in_order(*cols[:3], q)
        assert all((a == b[order]).all() for a, b in zip(got, (*cols[:3], q), strict=True))


@pytest.mark.parametrize("looked", [True, False])
@pytest.mark.parametrize("first", [1, (1 << 31) - 100, (1 << 33) - 150, 10**15])
def test_ids_of_any_size(spark, looked, first):
    """Ids that neither an int nor a word of target and place can hold change nothing but themselves (the target 0 has a part of its own, so it starts from 1)."""

    def rows(at):
        own = collection(spark, at)
        index = build_index(own.withColumnRenamed("id", "chrom_id"), IndexParams(3, 7))
        reads, m = own.withColumnRenamed("id", "read_id"), MapParams(distance=30, reject_ties=False)
        index = with_postings(index) if looked else index
        return sorted(tuple(r)[1:] for r in paf(map_reads(reads, index, m), reads, index).collect())

    assert rows(first) == rows(1) != []


@pytest.mark.parametrize("name", ["q_vote_groups", "q_coverage", "q_mapq", "q_near_dup_docs", "q_accuracy_curve"])
def test_no_anchor_is_shuffled(spark, name):
    """Mapped onto itself, a collection makes anchors in the tasks that cut its reads into seeds: no join by hash is left in the plan."""
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (hash" not in plan and "anti" not in plan.lower().replace("semi", "")
