"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each a word of the perfect binary
Golay code [23, 12, 7] with zeros in front. A word's keys are the indices of all codewords within
distance 4: one where its nearest codeword is within 2, else six. Two words within distance 2 share
a key, and of two words within distance 1 one's nearest codeword is among the other's keys.

At most four differing bits over three segments leave, by pigeonhole, either a segment without an
error beside one with at most two, or two segments with one error each. The first case is met by
joining on (segment, keys of another), the second on (nearest codewords of two) against (all keys
of two). Joined pairs are verified, so links are exactly the pairs within four bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, components, joined_evenly, own_name, text_key, written

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the code.
GENERATOR = 0b101011100011
#: Distinct fingerprints from which on keys are wide: there short keys would meet as often as wide ones have rows.
WIDE_FROM = 64_000_000
#: Shingles hashed at a time, so that memory does not follow a text's length.
CHUNK = 1 << 16


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text; zero without words."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
    ends = ends[shingle - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number; ``more`` columns follow as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["id", "fp", *batch.schema.names[2:]])

    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), *more)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in cols.schema.fields]
    return cols.mapInArrow(run, ", ".join([kinds[0], "fp bigint", *kinds[2:]]))


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: how many error patterns of weight 4 or less lead to a codeword, and the patterns, lightest first."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(23), n)], np.int64)
    of = syndromes(patterns)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=2048)
    table = np.zeros((2048, counts.max()), np.int64)
    place = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    table[of[order], place] = patterns[order]
    return counts, table


def keys(fps: np.ndarray, counts: np.ndarray, table: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of unsigned fingerprints; a link needs equal keys with side 0 or 2 on the left and 1 or 2 on the right.

    Where two segments have one error each, the third has at most two and shares a key too; with
    ``wide`` that key is part of theirs, 36 bits instead of 24, for some four times the rows.
    """
    segments = [((fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    syn = [syndromes(s) for s in segments]
    index = [(s[:, None] ^ table[y]) >> 11 for s, y in zip(segments, syn, strict=True)]
    valid = [np.arange(table.shape[1]) < counts[y][:, None] for y in syn]
    rows, out, sides = [], [], []

    def add(kind: int, key: np.ndarray, ok: np.ndarray, side: int) -> None:
        row, *at = np.nonzero(ok)
        rows.append(row)
        out.append(key[(row, *at)] | (kind << 48))
        sides.append(np.full(len(row), side, np.int8))

    for kind, (a, b) in enumerate((a, b) for a in range(3) for b in range(3) if a != b):
        add(kind, segments[a][:, None] << 12 | index[b], valid[b], 2)
    for kind, (a, b) in enumerate(combinations(range(3), 2), 6):
        both, ok = index[a][:, :, None] << 12 | index[b][:, None, :], valid[a][:, :, None] & valid[b][:, None, :]
        first = np.ones((len(fps), 1, 1), bool)
        if not wide:
            add(kind, both[:, :1, :1], first, 0)
            add(kind, both, ok, 1)
            continue
        third, held = index[3 - a - b], valid[3 - a - b]
        all_three = both[:, :, :, None] << 12 | third[:, None, None, :]
        add(kind, all_three[:, :1, :1], first[:, :, :, None] & held[:, None, None, :], 0)
        add(kind, all_three, ok[:, :, :, None] & held[:, None, None, :], 1)
    return np.concatenate(rows), np.concatenate(out), np.concatenate(sides)


def links(distinct: DataFrame) -> DataFrame:
    """(src, dst): pairs of distinct fingerprints (column fp) within ``MAX_BITS`` bits, each once or more. Many fingerprints get wide keys, so that few meet that are no link."""
    wide = distinct.count() > WIDE_FROM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = error_patterns()
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(whole), 500 if wide else 2000):
                fps = whole[at : at + (500 if wide else 2000)]
                row, key, side = keys(fps.view(np.uint64), *tables, wide)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row]), pa.array(side)], names=["key", "fp", "side"])

    keyed = distinct.select("fp").mapInArrow(run, "key bigint, fp bigint, side tinyint")
    left = keyed.filter("side <> 1").select("key", F.col("fp").alias("src"))
    right = keyed.filter("side <> 0").select("key", F.col("fp").alias("dst"))
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MAX_BITS
    # Spark takes the keys for as many rows as the fingerprints, of which each has dozens: by that size it would broadcast them
    return left.hint("merge").join(right.hint("merge"), (left["key"] == right["key"]) & near & (F.col("src") < F.col("dst"))).select("src", "dst")


def members(fps: DataFrame, rep: Column) -> DataFrame:
    """(fp, n, rep, root): distinct fingerprints with the number of their rows, ``rep`` over these, and their component's smallest fingerprint."""
    classes = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), rep.alias("rep"))
    found = components(links(fps.select("fp").distinct()).distinct())
    return classes.join(found, classes["fp"] == found["node"], "left").select("fp", "n", "rep", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, fp (signed), component: the smallest id reachable over fingerprints at most four bits apart.

    Words are split at ASCII white space after lower-casing A-Z; a shingle is four words, repeats
    included; a text of fewer words is one shingle, one without words (or null) has fingerprint 0
    and links like any other. Equal fingerprints link. A null id gets its component's smallest
    id, null if there is none. Repeated rows give a row each; other columns are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    member = written(members(fps, F.min("id")), "members")
    # a component may hold most fingerprints, and a fingerprint most rows: neither is one task's work
    least = written(member.groupBy("root").agg(F.struct(F.min("rep").alias("id")).alias("least"), F.count(F.lit(1)).alias("size")), "least")
    of = written(joined_evenly(member.select("fp", "n", "root"), least, ["root"], "least", "size").select("fp", "n", "least"), "of")
    return joined_evenly(fps.select("id", "fp"), of, ["fp"], "least", "n").select(F.col("id").alias(id_col), "fp", F.col("least.id").alias("component"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with its columns: the row with the smallest id, null last, then the smallest text key; of rows alike in both, the one whose columns hash to the least."""
    fps = written(fingerprints(docs, id_col, text_col, text_key(F.col(text_col)).alias("key")), "fingerprints")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    i, k, row = own_name("id"), own_name("key"), own_name("row")
    keep = members(fps, F.min(first)).groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.id").alias(i), F.col("rep.key").alias(k))
    kept = docs.join(keep, docs[id_col].eqNullSafe(keep[i]) & (text_key(docs[text_col]) == keep[k]), "left_semi")
    order = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind])
    one = kept.groupBy(F.col(id_col).alias(i), text_key(F.col(text_col)).alias(k)).agg(F.min_by(F.struct(*docs.columns), order).alias(row))
    return one.select(f"{row}.*")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``one_of_each``, for tables whose ids name documents: of an id that stays with several texts, the row with the smallest text key."""
    rows = one_of_each(docs, id_col, text_col)
    some, none = rows.filter(F.col(id_col).isNotNull()), rows.filter(F.col(id_col).isNull())
    row = own_name("row")
    one = some.groupBy(F.col(id_col).alias(own_name("id"))).agg(F.min_by(F.struct(*docs.columns), text_key(F.col(text_col))).alias(row))
    return one.select(f"{row}.*").union(none)
