"""Exact substring dedup with suffix arrays.

Bytes inside a 100-byte string that also starts earlier are removed. Suffixes are dealt into shards
by content: of the 24-byte grams inside a 100-byte string the one with the smallest hash is its
anchor, so equal strings have equal anchors and meet in one shard. Anchors met once end the search
early. Stretches (all strings of one anchor occurrence) that seem equal as a whole are held against
the first of them, byte for byte, and only that one goes on. What is left is sorted: each shard builds the suffix array of its stretches (Larsson-Sadakane refinement),
and Kasai's common prefixes part it into classes of equal strings. An anchor too frequent for one
shard is spread over several. These hand on their classes as sorted lists of strings, dealt by the
anchor's place in the string, and lists of one place are merged by binary search over the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, joined_evenly, written

LENGTH, GRAM = 100, 24
#: Grams inside a string of LENGTH bytes.
GRAMS = LENGTH - GRAM + 1
#: Strings anchored at a time, so that memory does not follow a text's length; positions inside take 19 bits of a key.
BLOCK = 1 << 18
PLACE = np.uint64((1 << 19) - 1)
#: Stretches of one shard, and of one anchor in a shard: beyond it an anchor is spread.
SHARD_ROWS, ANCHOR_ROWS = 8_000, 2_000
#: Stretches that are dealt to one task to be compared.
COMPARE_ROWS = 60_000
#: Strings aimed at in one merge, and in one task that merges.
MERGE_ROWS, MERGE_TASK = 50_000, 150_000
#: Bits of the map of documents whose text is needed again; a full map only saves less.
MAP_BITS = 1 << 24


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place."""
    n = len(data) - 7
    eight = np.empty(n, np.uint64)
    for o in range(8):
        part = data[o : o + (len(data) - o) // 8 * 8].view(np.uint64)
        eight[o::8] = part[: len(eight[o::8])]
    eight = mixed(eight)
    m = len(data) - GRAM + 1
    return mixed(eight[:m] * np.uint64(3) + eight[8 : 8 + m] * np.uint64(0x9E3779B97F4A7C15) + eight[16 : 16 + m])


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, first, last, place): for each anchor in blocks of the text, its hash, the first and last string start that it anchors, and its own. Ties: the leftmost gram."""
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(whole) - LENGTH + 1, BLOCK):
        block = whole[at : at + BLOCK + LENGTH - 1]
        h = gram_hashes(block)
        low = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= GRAMS:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < GRAMS:
            low = np.minimum(low[: len(low) - (GRAMS - span)], low[GRAMS - span :])
        place = (low & PLACE).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut, [len(place)])) - 1
        yield h[place[first]].view(np.int64), first + at, last + at, place[first] + at


def stretches(docs: DataFrame) -> DataFrame:
    """(h, c, doc, at): anchor hash, hash of the bytes of all strings it anchors, document, and first start << 14 | bytes from there to the anchor << 7 | starts - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            parts: list[list] = [[], [], [], []]
            size = 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=["h", "c", "doc", "at"])

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer() if text.is_valid else b""
                if len(data) < LENGTH:
                    continue
                data = data.to_pybytes()
                for h, first, last, place in anchors(data):
                    parts[0].append(h)
                    parts[1].append(np.array([digest(data[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)], np.uint64).view(np.int64))
                    parts[2].append(np.full(len(h), doc, np.int64))
                    parts[3].append(first << 14 | place - first << 7 | last - first)
                    size += len(h)
                    if size > 200_000:
                        yield out()
                        parts, size = [[], [], [], []], 0
            if size:
                yield out()

    return docs.select("doc", F.col("text").cast("binary")).mapInArrow(run, "h bigint, c bigint, doc bigint, at bigint")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order: groups of equal prefixes are refined by the rank of the suffix one prefix length on, and sorted groups are left alone (Larsson-Sadakane). Kasai's scan needs the order to be complete."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = start
    h = 8
    while True:
        alone = fresh & np.concatenate((fresh[1:], [True]))
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            break
        sub = order[open_at]
        after = rank[np.minimum(sub + h, n)] + 1
        by = (rank[sub].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        turn = np.argsort(by, kind="stable")
        order[open_at] = sub[turn]
        by = by[turn]
        fresh[open_at] = np.concatenate(([True], by[1:] != by[:-1]))
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order[open_at]] = start[open_at]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """For each place in the suffix array, the prefix shared with the suffix before it, up to ``most``.

    Kasai's scan (the next suffix of a text shares at least one byte less) runs along all
    stretches (starts, lengths) at once, one place of each at a time.
    """
    n = len(text)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    before = np.where(at > 0, order[np.maximum(at - 1, 0)], n)
    # unequal bytes behind the end keep scans inside
    tail = np.concatenate((text, np.zeros(most + 1, np.uint8)))
    lcp = np.zeros(n, np.int64)
    shared = np.zeros(len(starts), np.int64)
    for j in range(int(lengths.max(initial=0))):
        live = np.flatnonzero(lengths > j)
        i = starts[live] + j
        k = before[i]
        l = np.where(k < n, np.maximum(shared[live] - 1, 0), most)  # noqa: E741
        open_at = np.flatnonzero((l < most) & (k < n))
        while len(open_at):
            a, b = i[open_at] + l[open_at], k[open_at] + l[open_at]
            same = (tail[a] == tail[b]) & (a < n) & (b < n)
            open_at = open_at[same]
            l[open_at] += 1
            open_at = open_at[l[open_at] < most]
        l[k >= n] = 0
        shared[live] = l
        lcp[at[i]] = l
    return lcp


def classes(parts: list[bytes], starts_in: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, offset, class) of every string start of a shard: part ``p`` has its first ``starts_in[p]`` places as starts; equal strings have equal classes."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    text = np.frombuffer(b"".join(parts), np.uint8)
    begins = np.cumsum(lengths) - lengths
    order = suffix_array(text)
    lcp = common_prefixes(text, order, begins, lengths, LENGTH)
    cls = np.empty(len(text), np.int64)
    cls[order] = np.cumsum(lcp < LENGTH)
    part = np.repeat(np.arange(len(parts)), starts_in)
    offset = np.arange(len(part)) - np.repeat(np.cumsum(starts_in) - starts_in, starts_in)
    return part, offset, cls[begins[part] + offset]


def later(cls: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which strings have an equal one with an earlier start."""
    order = np.lexsort((at, doc, cls))
    c, d, a = cls[order], doc[order], at[order]
    head = np.concatenate(([True], c[1:] != c[:-1]))
    first = np.maximum.accumulate(np.where(head, np.arange(len(c)), 0))
    out = np.empty(len(c), bool)
    out[order] = (d != d[first]) | (a != a[first])
    return out


def runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, a, b): bytes covered by the strings at these places, as maximal runs."""
    order = np.lexsort((at, doc))
    d, p = doc[order], at[order]
    head = np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + LENGTH))) if len(d) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    last = np.concatenate((first[1:], [len(d)])).astype(np.int64) - 1 if len(d) else first
    return d[first], p[first], p[last] + LENGTH


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, text): doc numbers documents in the order of their ids; ids themselves, where they are whole numbers and none is null or repeats.

    Else, and for ids of any other type that Spark can order, rows of one id are told apart by their text (equal rows share a number), and null ids come last.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole = own.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    n, known, distinct = own.agg(F.count(F.lit(1)), F.count("id"), F.count_distinct("id")).first() if whole else (1, 0, 0)
    if n == known == distinct:
        return own.select("id", F.col("id").cast("bigint").alias("doc"), "text")
    own = own.withColumn("m", F.coalesce(F.md5("text"), F.lit("")))
    order = [F.col("id").asc_nulls_last(), F.col("m")]
    rows = written(own.select("id", "m").distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ids")
    offsets = {}
    total = 0
    for part, k in sorted(map(tuple, rows.groupBy("part").count().collect())):
        offsets[part] = total
        total += k
    begin = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[F.col("part")] if offsets else F.lit(0)
    numbers = rows.select(F.col("id").alias("nid"), F.col("m").alias("nm"), (begin + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).cast("bigint").alias("doc"))
    return own.join(numbers, F.col("id").eqNullSafe(F.col("nid")) & (F.col("m") == F.col("nm"))).select("id", "doc", "text")


def bit_map(rows: DataFrame, bit: Column) -> np.ndarray:
    """Words of a map of ``MAP_BITS`` bits, with those set that the rows name."""
    words = rows.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(MAP_BITS // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table


def among(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: the rows whose doc is in ``ids`` with some others, and rows that are not in it for certain. A bit map of fixed size, broadcast as a table of its words, parts them, so that fewer texts are shuffled by the join that follows."""
    bit = F.pmod(F.xxhash64("doc"), F.lit(MAP_BITS))
    word = lambda b: F.shiftright(b, 6).cast("int")
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    words = written(ids.select(bit.alias("bit")).groupBy(word(F.col("bit")).alias("__word")).agg(F.bit_or(one).alias("__bits")), "bits")
    placed = docs.join(F.broadcast(words), word(bit) == F.col("__word"), "left")
    inside = F.getbit(F.coalesce("__bits", F.lit(0).cast("bigint")), F.pmod(bit, F.lit(64)).cast("int")) == 1
    return placed.filter(inside).select(*docs.columns), placed.filter(~inside).select(*docs.columns)


def needed(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the runs [first, end) are enough to cover what all of them cover; ends go up with starts."""
    order = np.argsort(first, kind="stable")
    keep, reach, best, far = [], -1, -1, -1
    for i, a, b in zip(order.tolist(), first[order].tolist(), end[order].tolist(), strict=True):
        if a > reach:
            if far > reach:
                keep.append(best)
                reach = far
            if a > reach:
                reach = a
        if b > far:
            best, far = i, b
    if far > reach:
        keep.append(best)
    return np.array(sorted(keep), np.int64)


def cut(docs: DataFrame, wanted: DataFrame, sparse: bool = False) -> DataFrame:
    """(h, part, parts, doc, first, left, n, bytes): the stretches (h, part, parts, doc, at) with their bytes; left: bytes before the anchor. sparse: of those with positive parts, no more than cover what they all cover."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("h", "part", "parts", "at")).alias("list"))
    have = among(docs.select("doc", F.col("text").cast("binary").alias("text")), wanted.select("doc"))[0].dropDuplicates(["doc"]).withColumnRenamed("doc", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text = batch.column(2)[r].as_buffer().to_pybytes()
                of = batch.column(1)[r].values
                h, part, parts, at = (of.field(i) for i in range(4))
                at = at.to_numpy()
                first, left, n = at >> 14, (at >> 7 & 127).astype(np.int32), ((at & 127) + 1).astype(np.int32)
                if sparse:
                    follow = np.flatnonzero(parts.to_numpy() > 0)
                    some = np.sort(np.concatenate((np.flatnonzero(parts.to_numpy() < 0), follow[needed(first[follow], first[follow] + n[follow] + LENGTH - 1)])))
                    h, part, parts = (c.take(pa.array(some)) for c in (h, part, parts))
                    at, first, left, n = at[some], first[some], left[some], n[some]
                for x in range(0, len(at), 20_000):
                    s = slice(x, x + 20_000)
                    bits = [text[a : a + k + LENGTH - 1] for a, k in zip(first[s].tolist(), n[s].tolist(), strict=True)]
                    doc = np.full(len(bits), batch.column(0)[r].as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays([h[s], part[s], parts[s], *map(pa.array, (doc, first[s], left[s], n[s])), pa.array(bits, pa.binary())], names=["h", "part", "parts", "doc", "first", "left", "n", "bytes"])

    return lists.join(have, lists["doc"] == have["own"]).select("doc", "list", "text").mapInArrow(run, "h bigint, part int, parts int, doc bigint, first bigint, left int, n int, bytes binary")


def class_lists(strings: np.ndarray, cls: np.ndarray, h: np.ndarray, left: np.ndarray, parts: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (h, slot, n, doc, at, strings): classes of spread anchors by anchor and slot, sorted. Equal strings have one slot: the anchor's place in them, and a hash where one place has too many."""
    buckets = -(-parts * ANCHOR_ROWS // MERGE_ROWS)
    bucket = np.array([xxhash.xxh64_intdigest(x) % b if b > 1 else 0 for x, b in zip(strings.tolist(), buckets.tolist(), strict=True)], np.int64)
    slot = bucket << 7 | left
    order = np.lexsort((cls, slot, h))
    h, slot, doc, at, strings = h[order], slot[order], doc[order], at[order], strings[order]
    cuts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (slot[1:] != slot[:-1]), [True])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        blobs = [pa.array([x[a:b].tobytes()], pa.binary()) for x in (doc, at, strings)]
        yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 1]), pa.array(slot[a : a + 1]), pa.array([b - a], pa.int64()), *blobs], names=["h", "slot", "n", "doc", "at", "strings"])


def repeats_in_shards(pieces: DataFrame, n_shards: int) -> DataFrame:
    """(h, slot, n, doc, at, strings): with h null, runs covered inside a shard as blobs of documents, starts and ends; else a class list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        h, parts, doc, first, left, n = (table.column(c).to_numpy() for c in ("h", "parts", "doc", "first", "left", "n"))
        bits = [x.as_py() for x in table.column("bytes").combine_chunks()]
        part, offset, cls = classes(bits, n)
        d, at = doc[part], first[part] + offset
        again = later(cls, d, at)
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in runs(d[again], at[again])]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([len(d)], pa.int64()), *blobs], names=["h", "slot", "n", "doc", "at", "strings"])
        keep = np.flatnonzero(~again & (parts[part] > 1))
        if len(keep):
            strings = np.array([bits[p][o : o + LENGTH] for p, o in zip(part[keep].tolist(), offset[keep].tolist(), strict=True)], f"S{LENGTH}")
            yield from class_lists(strings, cls[keep], h[part[keep]], left[part[keep]] - offset[keep], parts[part[keep]], d[keep], at[keep])

    return pieces.repartition(n_shards, "h", "part").mapInArrow(run, "h bigint, slot bigint, n bigint, doc binary, at binary, strings binary")


def found_again(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, at) of strings that have an equal one with an earlier start in another of the sorted lists (strings, doc, at). Each list is looked up in the merge of those before it, by binary search."""
    strings, doc, at = (x.copy() for x in lists[0])
    docs, starts = [], []
    for s, d, a in lists[1:]:
        place = np.searchsorted(strings, s)
        met = strings[np.minimum(place, len(strings) - 1)] == s
        p, d1, a1 = place[met], d[met], a[met]
        earlier = (d1 < doc[p]) | ((d1 == doc[p]) & (a1 < at[p]))
        docs.append(np.where(earlier, doc[p], d1))
        starts.append(np.where(earlier, at[p], a1))
        doc[p], at[p] = np.where(earlier, d1, doc[p]), np.where(earlier, a1, at[p])
        strings, doc, at = (np.insert(x, place[~met], y[~met]) for x, y in ((strings, s), (doc, d), (at, a)))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *docs]), np.concatenate([none, *starts])


def merged(lists: DataFrame) -> DataFrame:
    """(doc, a, b): of the class lists of spread anchors, what another shard has earlier."""
    n = lists.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                doc, at, strings = (np.frombuffer(batch.column(c)[r].as_buffer(), kind).copy() for c, kind in ((3, np.int64), (4, np.int64), (5, f"S{LENGTH}")))
                held.setdefault((batch.column(0)[r].as_py(), batch.column(1)[r].as_py()), []).append((strings, doc, at))
        for key in list(held):
            d, a, b = runs(*found_again(held.pop(key)))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], names=["doc", "a", "b"])

    return lists.repartition(max(1, -(-n // MERGE_TASK)), "h", "slot").mapInArrow(run, "doc bigint, a bigint, b bigint")


def unpacked(rows: DataFrame) -> DataFrame:
    """(doc, a, b) of runs kept as blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(c)[r].as_buffer(), np.int64)) for c in range(3)], names=["doc", "a", "b"])

    return rows.select("doc", "at", "strings").mapInArrow(run, "doc bigint, a bigint, b bigint")


def copies_compared(pieces: DataFrame, n_shards: int) -> DataFrame:
    """(doc, at, a, b, proven) of stretches (h, part, parts, doc, first, left, n, bytes): those that are, byte for byte, a stretch of the same group and part that starts earlier, and without proof those that are none. The stretch that stands for its group, marked by negative parts, is in each of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, {}
        for batch in batches:
            h, part, parts, doc, first, left, n = (batch.column(i).to_numpy() for i in range(7))
            proven, keep = np.zeros(len(h), bool), np.zeros(len(h), bool)
            for r, (a, b, start, bits) in enumerate(zip(h.tolist(), part.tolist(), zip(doc.tolist(), first.tolist(), strict=True), batch.column(7), strict=True)):
                if (a, b) != key:
                    key, seen = (a, b), {}
                # stretches come in the order of their starts; a document may come more than once
                proven[r] = seen.setdefault(bits.as_buffer().to_pybytes(), start) != start
                keep[r] = proven[r] or parts[r] > 0
            at = first << 14 | left.astype(np.int64) << 7 | (n - 1)
            out = [x[keep] for x in (doc, at, first, first + n + LENGTH - 1, proven)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), names=["doc", "at", "a", "b", "proven"])

    return pieces.repartition(n_shards, "h", "part").sortWithinPartitions("h", "part", "doc", "first").mapInArrow(run, "doc bigint, at bigint, a bigint, b bigint, proven boolean")


def cover(docs: DataFrame) -> DataFrame:
    """(doc, a, b): bytes a to b of a document lie in strings that also start earlier; runs may overlap.

    Hashes only say what to compare: every run comes from equal bytes, of whole stretches, in a
    suffix array, or in a merge.
    """
    found = written(stretches(docs), "found")
    often = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "often")
    again = written(joined_evenly(found, often, ["h"], "n", "n").drop("n"), "stretches")
    dropped(found, often)
    kinds = written(again.groupBy("h", "c").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n")), "kinds")
    # stretches whose bytes hash alike: the first stands for them, and the others are held against its bytes
    alike = joined_evenly(again, written(kinds.filter("n > 1").select("h", "c", F.struct("first", "n").alias("of"), "n"), "alike"), ["h", "c"], "of", "n")
    parts = F.ceil(F.col("of.n") / ANCHOR_ROWS).cast("int")
    leads = F.struct("doc", "at") == F.col("of.first")
    dealt = alike.select(F.xxhash64("h", "c").alias("h"), "doc", "at", F.when(leads, -parts).otherwise(parts).alias("parts"), F.explode(F.when(leads, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc", "at"), parts).cast("int")))).alias("part"))
    dealt = written(dealt.select("h", "part", "parts", "doc", "at"), "copies")
    tasks = max(1, -(-dealt.count() // COMPARE_ROWS))
    # stretches overlap; as many are compared as cover them all, and all of them if one is not what its hash says
    compared = written(copies_compared(cut(docs, dealt, True), tasks), "compared")
    exact = compared.filter("not proven").isEmpty()
    if not exact:
        compared = written(copies_compared(cut(docs, dealt), tasks), "compared")
    whole = compared.filter("proven").select("doc", "a", "b")
    if not exact:
        odd = compared.filter("not proven").select(F.col("doc").alias("doc_"), F.col("at").alias("at_"))
        # alike by hash alone: kinds of their own
        own = again.join(odd, (F.col("doc") == F.col("doc_")) & (F.col("at") == F.col("at_"))).select("h", F.xxhash64("c", "doc", "at").alias("c"), F.struct("doc", "at").alias("first"), F.lit(1).cast("bigint").alias("n"))
        kinds = written(kinds.union(own), "kinds")
    sizes = written(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "sizes")
    parts = F.ceil(F.col("k") / ANCHOR_ROWS).cast("int")
    wanted = written(joined_evenly(kinds, sizes, ["h"], "k", "k").select("h", F.pmod(F.xxhash64("c"), parts).cast("int").alias("part"), parts.alias("parts"), "first.doc", "first.at"), "wanted")
    shards = max(1, -(-wanted.count() // SHARD_ROWS))
    inside = written(repeats_in_shards(cut(docs, wanted), shards), "repeats")
    return whole.union(unpacked(inside.filter("h is null"))).union(merged(inside.filter("h is not null")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, spans (maximal removed runs [a, b) of bytes), kept (the other bytes, in order).

    A byte goes if it lies in a string of LENGTH bytes that also starts earlier: in a document of
    smaller id, or earlier in its own. Strings are judged on the input and do not cross documents.
    Null texts are empty; shorter texts stay whole. Ids may be of any type with an order. Documents with a null id count as last. Rows
    with one id and different texts are ordered by the text's MD5; rows equal in both are one
    document and give equal rows. Other columns are not read.
    """
    docs = numbered(docs, id_col, text_col)
    covered = written(cover(docs), "cover").groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("cover"))
    covered = written(covered, "covered").withColumnRenamed("doc", "own")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    have, same = among(docs.select("id", "doc", text.alias("text")), covered.select(F.col("own").alias("doc")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                data = batch.column(1)[r].as_buffer().to_pybytes()
                of = batch.column(2)[r].values
                a, b = (of.field(i).to_numpy() for i in range(2)) if of is not None else (np.zeros(0, np.int64),) * 2
                if len(a):
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    head = np.concatenate(([True], a[1:] > b[:-1]))
                    a, b = a[head], b[np.concatenate((head[1:], [True]))]
                kept = b"".join(data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True))
                spans = pa.array([[{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0)[r : r + 1], pa.array([len(data)], pa.int64()), spans, pa.array([kept], pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    kind = f"id {docs.schema['id'].dataType.simpleString()}, n_bytes bigint, spans array<struct<a: bigint, b: bigint>>, kept binary"
    changed = have.join(covered, have["doc"] == covered["own"], "left").select("id", "text", "cover").mapInArrow(run, kind)
    same = same.select("id", F.length("text").cast("bigint").alias("n_bytes"), F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)").alias("spans"), F.col("text").alias("kept"))
    return changed.union(same).withColumnRenamed("id", id_col)
