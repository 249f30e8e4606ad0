"""The registered queries over the smallest tables, against brute force."""

import hashlib
import re
import zlib
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

from seedloom.llm import kneser_ney, mixing, quality
from seedloom.llm.queries import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def result(spark, name, cols):
    return sorted((tuple(r) for r in queries()[name](spark, DATA).select(*cols).collect()), key=str)


def test_op1(spark, docs):
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(((d, n, h, len(items), brute.sha(",".join(items)), h > 0) for d, n, h, items in brute.decontaminate(docs, bench)), key=str)
    assert result(spark, "op1_decontaminate", ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]) == want and any(w[-1] for w in want)


def test_op4(spark, docs):
    want, _ = brute.kneser_ney(docs, kneser_ney.discounts)
    got = {r[0]: r for r in result(spark, "op4_lm_score", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])}
    for w in want:
        assert got[w[0]][:5] == w[:5] and got[w[0]][5:] == pytest.approx(w[5:], rel=1e-9)
    held = [r for r in got.values() if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_op5(spark, docs):
    want = sorted(((d, f"{fp:016x}", c) for d, fp, c in brute.components(docs)), key=str)
    assert result(spark, "op5_simhash", ["doc_id", "fingerprint", "component_id"]) == want


def test_op6(spark, docs):
    want = brute.statistics(docs)
    got = result(spark, "op6_quality_rules", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
    assert [r[:7] for r in got] == want and not any(r[6] and r[7] for r in got)


def test_op6_verdicts(spark, docs):
    """The learned rules, applied to this test's own statistics, give the registered verdicts, and are as precise on the labels as they have to be."""
    table = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    stats = quality.features(quality.statistics(table("documents")))
    labels = {r.doc_id: r.quality for r in table("labels").collect() if r.quality is not None}
    bad = F.col("quality") == 0
    rules = quality.learn(stats.join(table("labels").select(F.col("doc_id").alias("id"), bad.cast("int").alias("bad")), "id").filter("bad is not null").filter(~quality.base_failed()))
    assert rules
    own = {d: brute.features(t) for d, t in docs}
    holds = lambda f, tests: all(f[k] > c if op == ">" else f[k] <= c for k, op, c in tests)
    got = {r[0]: r for r in result(spark, "op6_quality_rules", ["doc_id", "base_failed", "rule", "kept"])}
    hits = {n: [0, 0] for n in range(1, len(rules) + 1)}
    for d, f in own.items():
        rule = next((n for n, tests in enumerate(rules, 1) if holds(f, tests)), 0)
        assert got[d][2] == rule and got[d][3] == (not got[d][1] and not rule)
        if rule and d in labels and not got[d][1]:
            hits[rule][labels[d] == 0] += 1
    assert all(y >= quality.MIN_COVER and y >= quality.MIN_PRECISION * (x + y) for x, y in hits.values())


def test_pipeline_stages(spark, tmp_path):
    """Every stage, on what the one before kept, against plain Python."""
    import corpus_pipeline

    rows = lambda df: [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else "null")
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    before = rows(df)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, DATA).write.parquet(f"file://{tmp_path}/{name}")
        df = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name == "shards":
            sizes = [df.filter(df.shard == s).count() for s in range(16)]
            assert sum(sizes) == len(before) and max(sizes) - min(sizes) <= 1
            return
        got = rows(df)
        if name == "quality_rules":
            kept = {r[0] for r in result(spark, "op6_quality_rules", ["doc_id", "kept"]) if r[1]}
            want = [r for r in before if r[0] in kept]
        elif name == "near_dedup":
            component = {(d, fp): c for d, fp, c in brute.components([r[:2] for r in before])}
            of, groups = {d: c for (d, _), c in component.items()}, {}
            for r in before:
                groups.setdefault(of[r[0]], []).append(r)
            want = [min(g, key=key) for g in groups.values()]
        elif name == "decontamination":
            hit = {d for d, _, h, _ in brute.decontaminate([r[:2] for r in before], bench) if h}
            want = [r for r in before if r[0] not in hit]
        else:
            number = lambda s: int(m[1]) if (m := re.search(r"([0-9]+)$", s or "")) else 10**6
            domain = lambda s: "web" if number(s) < 3 else "books" if number(s) < 10 else "code"
            weights = [{"web": 3, "books": 4, "code": 3}.get, lambda x: {"en": 5, "de": 2, "fr": 2, "es": 1}.get(x, 1), lambda x: 1]
            taken = brute.mixture([(d, t, domain(s), x, s) for d, t, x, s in before], weights, (3, 4), mixing.SEED)
            want = [r for i, r in enumerate(before) if i in taken]
        assert sorted(got, key=str) == sorted(want, key=str) and len(got) < len(before), name
        before = got


def test_op7(spark, docs):
    got = {r[0]: r for r in result(spark, "op7_sharding", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])}
    assert all(got[d][1:4] == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows") and got[d][6] is None for d, t in docs)
    slots = [sorted(r[5] for r in got.values() if r[4] == s) for s in range(16)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    homes = {}
    for d, t in docs:
        homes.setdefault(hashlib.md5((t or "").encode()).hexdigest(), set()).add(got[d][4])
    assert sum(len(v) > 1 for v in homes.values()) <= 1


def test_op8(spark, docs):
    assert result(spark, "op8_suffix_dedup", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == brute.repeats(docs)


def test_op9(spark, docs):
    want = sorted(((d, n, len(x), brute.sha(t)) for d, n, x, t in brute.lines(docs)), key=str)
    assert result(spark, "op9_line_dedup", ["doc_id", "n_lines", "n_removed", "kept_sha256"]) == want


def test_op10(spark, docs):
    """Mentions of three types, found by patterns of this test's own: one replacement for a value and one value for a replacement, in the value's format, and none of the values left."""
    got = {r[0]: r for r in result(spark, "op10_pii_surrogates", ["doc_id", "n_entities", "text"])}
    assert len(got) == len(docs) and any(r[1] for r in got.values())
    assert all(got[d][2] == t for d, t in docs if not got[d][1]) and all(got[d][2] != t for d, t in docs if got[d][1])
    kinds = {"mail": r"[\w.]+@[\w.]+\.\w+", "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "card": r"\b\d{16}\b"}
    for kind, pattern in kinds.items():
        there, back, of = {}, {}, lambda t, p=pattern: re.findall(p, t or "")
        for d, t in docs:
            old, new = of(t), of(got[d][2])
            assert len(old) == len(new), (kind, d)
            for a, b in zip(map(str.lower, old), new, strict=True):
                assert there.setdefault(a, b) == b and back.setdefault(b, a) == a
                assert kind == "ip" or [c.isdigit() for c in a] == [c.isdigit() for c in b]
        assert not set(there) & set(back) and (there or kind == "card")
