"""Manifest, token counts and hard negatives against plain forms, with the cases that they have to define."""

import hashlib
import math
import random
import zlib
from pathlib import Path

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seedloom.llm import hard_negatives, manifest, token_counts
from seedloom.llm.queries import queries

DATA = "/root/testdata/sf0.001"
TOKENS = public_tokenizers.path("byte_bpe_50k.json")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tree(leaves):
    """Root, and the siblings before and behind every leaf by level."""
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([sha("".join(rows[-1][i : i + 8])) for i in range(0, len(rows[-1]), 8)])
    ways = []
    for i in range(len(leaves)):
        way = []
        for row in rows[:-1]:
            a = i // 8 * 8
            way.append((row[a:i], row[i + 1 : a + 8]))
            i //= 8
        ways.append(way)
    return rows[-1][0], ways


def proven(docs):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(part, r)))
    by = {}
    for doc_id, source, lang, n, text in docs:
        own = leaf((doc_id, source, lang, n, text))
        hit = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        by.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, leaf((doc_id, source, lang, n, text.translate(LOW))) if hit else own))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(by[x])]) for x in langs}
    root, tops = tree([trees[x][0] for x in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        subroot, ways = trees[lang]
        for (known, doc_id, own, now), way in zip(sorted(by[lang]), ways, strict=True):
            for before, behind in way + top:
                now = sha("".join([*before, now, *behind]))
            proof = sha("".join("".join(a + b) for a, b in way + top))
            out.append((doc_id if known else None, own, subroot, root, proof, now, now == root))
    return sorted(out, key=str)


DOC = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest(spark, height):
    """Groups of one leaf, of a run to the leaf, of one more; null groups, ids and texts; equal rows; other columns of clashing names."""
    rnd = random.Random(3)
    rows = []
    for lang, n in (("a", 1), ("b", 8), (None, 9), ("é", 64), ("", 65), ("B", 129), *((f"l{i}", 2) for i in range(70))):
        for i in range(n):
            text = rnd.choice([None, "", "Some TEXT é", f"x{i}", "Y" * 3000])
            rows.append((rnd.choice([i, i * 7 - 3, None]), rnd.choice([None, "web", "w:1"]), lang, rnd.choice([None, 5]), text))
    rows += [rows[40]] * 3
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("grp", "id", "leaf", "at", "n", "part", "root", "up")}).repartition(5)
    assert sorted(map(tuple, manifest.documents_manifest(df, height=height).collect()), key=str) == proven(rows)


def test_manifest_alone_and_empty(spark):
    one = [(3, None, None, None, "A")]
    assert [tuple(r) for r in manifest.documents_manifest(spark.createDataFrame(one, DOC)).collect()] == proven(one)
    assert proven(one)[0][4] == sha("") and manifest.documents_manifest(spark.createDataFrame([], DOC)).count() == 0


def test_manifest_hot_group(spark):
    """A third of all rows without an id, and one group with most: more partitions than ranges, and three rounds of the exchange."""
    rows = [(None if i % 3 == 0 else i, "s", "en" if i % 10 else "de", i, f"T{i % 50}") for i in range(3000)]
    assert sorted(map(tuple, manifest.documents_manifest(spark.createDataFrame(rows, DOC).repartition(7), height=1).collect()), key=str) == proven(rows)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENS)


def test_proof(library):
    """Strings that count one are one token to the library; the classes are the library's at every code point that ``regex`` sees otherwise."""
    known = token_counts.proof(TOKENS)
    some = random.Random(1).sample(sorted(known.alone), 5000)
    single = [w for w in some if len(library.pre_tokenizer.pre_tokenize_str(w)) == 1]
    assert len(single) > 4500 and all(len(x.ids) == 1 for x in library.encode_batch(single, add_special_tokens=False))
    assert len(known.alone) < library.get_vocab_size() and known.special == ("<|endoftext|>",)
    with pytest.raises(ValueError):
        token_counts.proof(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts(spark, frame, odd_docs, library, monkeypatch):
    known, rnd = token_counts.proof(TOKENS), random.Random(5)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    pools = [every, regex.findall(known.odd, "".join(every)), " \n\t\x1c\x85　  '", "abcdeéöüß", "0123٣", ["'ll", "'s", "'S", "<|endoftext|>", "hello", " the"], "!?.,;"]
    texts = ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    rows = odd_docs + [(1000 + i, t) for i, t in enumerate(texts)] + [(5, "  a" * 200_000), (None, "z" * 50_000)]
    want = sorted(((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows), key=str)
    for long in (token_counts.LONG, 20):
        monkeypatch.setattr(token_counts, "LONG", long)
        assert sorted(map(tuple, token_counts.token_counts(frame(rows), TOKENS).collect()), key=str) == want
    assert token_counts.token_counts(frame([]), TOKENS).count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
def test_op12(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in docs}
    got = queries()["op12_token_counts"](spark, DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and all(r.over_limit == (r.n_tokens > 1024) for r in got)


def mined(rows, positives=5, negatives=3):
    """Every anchor against every row."""
    sound = []
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            sound.append((i, label, tuple(max(-(1 << 26), min(1 << 26, math.floor(256 * x))) for x in v)))
    sound = sorted(set(sound))
    out = []
    for i, label, v in sound:
        if i % 50:
            continue
        scores = {(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in sound if len(w) == len(v)}
        near = sorted(x for x in scores if x[2] == label and x[1] != i)[:positives]
        for p, j, _ in near:
            fits = sorted(x for x in scores if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p)[:negatives]
            out += [(i, j, n + 1, x[1], -p, -x[0]) for n, x in enumerate(fits)]
    return sorted(out)


def test_hard_negatives(spark):
    """Ties, copies of a third of all rows, negative scores, odd lengths, vectors that take no part, shared ids; in one group and in many."""
    rnd = random.Random(11)
    centres = [[rnd.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    row = lambda i: (i, [c + rnd.gauss(0, 0.4) for c in rnd.choice(centres)], rnd.randrange(3))
    rows = [row(i) for i in range(600)]
    rows += [(i, rows[17][1], rows[17][2]) for i in range(700, 1000)] + [rows[50]] * 40 + [(100, rows[3][1], 2), (150, [-1.0] * 12, 0), (200, [0.0] * 12, 1)]
    rows += [(None, [1.0] * 12, 0), (1050, None, 1), (1100, [], 1), (1150, [1.0, None] * 6, 1), (1200, [float("nan")] * 12, 1), (1250, [float("inf")] * 12, 1), (1300, [1.0] * 12, None)]
    rows += [(i, [float(i % 5), 1.0, -2.0], i % 2) for i in range(2000, 2060)] + [(3000, [1e300] * 12, 0), (3001, [1e9] * 12, 0), (3002, [2.0] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "x", "code", "grp", "stripe", "key", "anchor")}).repartition(5)
    want = mined(rows)
    assert len(want) > 100 and len({r[0] for r in want}) > 8
    for size in ({}, {"stripe": 60, "group": 3}):
        assert sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **size).collect())) == want
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_intervals():
    """Every score lies in its interval, and most intervals of far rows end below the near ones."""
    import numpy as np

    rng = np.random.default_rng(2)
    for dim in (3, 64, 100):
        x = np.floor(256 * rng.normal(size=(300, dim))).astype(np.int64)
        a = hard_negatives.Anchors(x[:40])
        code, align, rest = hard_negatives.coded(x)
        middle, reach = a.intervals(code, align, rest)
        scores = x[:40] @ x.T
        assert (np.abs(scores - middle) <= reach).all()
        assert (np.abs(np.corrcoef(middle.ravel(), scores.ravel())[0, 1])) > 0.7
