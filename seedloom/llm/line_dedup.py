"""Line dedup by an exact set-similarity join (prefix, positional and length filters).

Lines are sets of words. Each set's words are ordered by rarity; two sets of Jaccard similarity 0.8
or more share a word among the rarest few of each. Rarity comes from a fixed number of counters
that all lines are counted into, so the order is the same everywhere and its table bounded. Joined
pairs pass the length and positional filters and a filter by parity bits, and then are verified.
Only sets' sizes, bits and prefixes are shuffled; whole sets are read again from the texts, for
those in a candidate pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, if_small, written
from .kneser_ney import END, mixed, pieces, tokens
from .suffix_dedup import MAP_BITS, among, bit_map, numbered

#: Jaccard similarity 4/5: overlap o of sizes a, b satisfies 9 o >= 4 (a + b).
COUNTER_BITS, RANGE_BITS = 24, 16
#: A word that more sets have in their prefixes makes a crowd, which is held against its earliest set before the join.
CROWD = 1000
#: More sets than these with the same least and greatest hashes of words make a crowd, too.
NEAR = 8
#: Words of crowds, sets that go in advance and documents that lose lines, up to which they are broadcast.
BROADCAST_WORDS, BROADCAST_SETS, BROADCAST_DOCS = 200_000, 200_000, 200_000
#: Sets that a task remembers having handed on; tokens it counts before it hands on their counters.
REMEMBER, TALLY = 100_000, 4_000_000
#: An odd number: hashes times this are in another order.
SECOND = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Smallest overlap with any similar set: ceil(4 n / 5)."""
    return (4 * n + 4) // 5


class Lines:
    """Word sets of the lines of a piece of texts; lines without words are left out.

    doc, line: place of each line; n, s: size and hash of its set; of, h: the words of all sets, by
    line and there by hash, or with a rarity table by code and hash.
    """

    def __init__(self, docs: np.ndarray, data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None) -> None:
        breaks = np.flatnonzero(data == 10) + 1
        full = offsets[:-1] < offsets[1:]
        starts = np.union1d(offsets[:-1][full], np.setdiff1d(breaks, offsets, assume_unique=False))
        hashes, counts = tokens(data, np.concatenate((starts, [len(data)])).astype(np.int64))
        of = np.repeat(np.arange(len(starts)), counts) if len(starts) else np.zeros(0, np.int64)
        word = hashes != END
        hashes, of = hashes[word], of[word]
        code = np.zeros(len(of), np.uint8) if table is None else table[hashes >> np.uint64(64 - COUNTER_BITS)]
        order = self.sorted(of, code, hashes)
        hashes, of, code = hashes[order], of[order], code[order]
        fresh = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1]))) if len(of) else np.zeros(0, bool)
        self.h, of, self.code = hashes[fresh], of[fresh], code[fresh]
        begins = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
        kept, self.first = of[begins], begins
        self.n = np.diff(np.concatenate((begins, [len(of)])))
        self.of = np.repeat(np.arange(len(kept)), self.n)
        self.s = mixed(np.add.reduceat(mixed(self.h), self.first) + self.n.astype(np.uint64)).view(np.int64) if len(kept) else np.zeros(0, np.int64)
        text = np.searchsorted(offsets, starts, side="right") - 1
        begin = np.searchsorted(starts, offsets[:-1])
        self.doc = docs[text[kept]]
        self.line = kept - begin[text[kept]]

    @staticmethod
    def sorted(of: np.ndarray, code: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Order by (of, code, h): by one 64-bit key, and by all three where that leaves a tie of different words or has no room."""
        if len(of) and of[-1] < 1 << 24:
            key = of.astype(np.uint64) << np.uint64(40) | code.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32)
            order = np.argsort(key)
            key, own = key[order], h[order]
            if not ((key[1:] == key[:-1]) & (own[1:] != own[:-1])).any():
                return order
        return np.lexsort((h, code, of))


def line_sets(batches: Iterator[pa.RecordBatch], table: np.ndarray | None = None) -> Iterator[Lines]:
    """Of batches of (doc, text)."""
    for rows, data, offsets in pieces(batches, 1, raw=True):
        yield Lines(rows.column(0).to_numpy(), data, offsets, table)


def rank_of(n: np.ndarray) -> np.ndarray:
    return (np.clip(np.floor(np.log2(np.maximum(n, 1)) * 8), 1, 255) * (n > 1)).astype(np.uint8)


def rarity(docs: DataFrame) -> np.ndarray:
    """By counter: 0 if at most one line's word counted into it, else 1 to 255 growing with the count's logarithm. 2^24 bytes, whatever the input.

    Every line counts each of its words. Tasks hand on the counters of a range as one row; ranges are summed apart.
    """
    span = 1 << RANGE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            ranges, first = np.unique(at >> RANGE_BITS, return_index=True)
            cut = [*first.tolist(), len(at)]
            blobs = [pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in ((at & span - 1).astype(np.uint16), n.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *blobs], names=["range", "at", "n"])

        for x in line_sets(batches):
            held.append((x.h >> np.uint64(64 - COUNTER_BITS)).astype(np.int32))
            size += len(x.h)
            if size > TALLY:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, at, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                into = sums.setdefault(r, np.zeros(span, np.int64))
                into[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.uint32)
        for r, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([rank_of(n).tobytes()], pa.binary())], names=["range", "code"])

    ranges = 1 << COUNTER_BITS - RANGE_BITS
    sums = docs.mapInArrow(count, "range int, at binary, n binary").repartition(ranges // 4, "range").mapInArrow(add, "range int, code binary")
    table = np.zeros((ranges, span), np.uint8)
    for r, code in sums.collect():  # at most 256 rows of 64 KB
        table[r] = np.frombuffer(bytes(code), np.uint8)
    return table.ravel()


def described(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(s, doc, line, n, bits0, bits1, prefix, often, near): a row for every line with a word. s, n: hash and size of its set; prefix: its rarest words, as far as a similar set must share one, null where only one line has the word; often: those that enough lines have for a crowd; near: two keys of the set's least and greatest hashes, null for sets too small for another similar one. A task gives a set's bits and words with one of its lines or some."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    crowd = rank_of(np.array([CROWD + 1]))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for x in line_sets(batches, shared.value):
            if not len(x.s):
                continue
            _, once = np.unique(x.s, return_index=True)
            fresh = np.zeros(len(x.s), bool)
            fresh[[i for i in once.tolist() if x.s[i] not in seen]] = True
            if len(seen) > REMEMBER:
                seen.clear()
            seen.update(x.s[fresh].tolist())
            n = x.n[x.of]
            keep = fresh[x.of] & (np.arange(len(x.of)) - x.first[x.of] <= n - least_overlap(n))
            bit = np.uint64(1) << (x.h & np.uint64(63))
            side = (x.h >> np.uint64(6) & np.uint64(1)).astype(bool)
            bits = [pa.array(np.bitwise_xor.reduceat(np.where(side == b, bit, np.uint64(0)), x.first).view(np.int64), mask=~fresh) for b in (False, True)]
            ends = np.cumsum(np.bincount(x.of[keep], minlength=len(x.s)))
            words = pa.array(x.h[keep].view(np.int64), mask=x.code[keep] == 0)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), words, mask=pa.array(~fresh))]
            keep &= x.code >= crowd
            ends = np.cumsum(np.bincount(x.of[keep], minlength=len(x.s)))
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(x.h[keep].view(np.int64)), mask=pa.array(~fresh)))
            keys = np.stack([mixed(np.minimum.reduceat(h, x.first) ^ mixed(np.maximum.reduceat(h, x.first) + np.uint64(i))) for i, h in enumerate((x.h, x.h * SECOND))], 1)
            large = fresh & (x.n >= 4)
            ends = np.concatenate(([0], np.cumsum(2 * large))).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[large].ravel().view(np.int64)), mask=pa.array(~large)))
            yield pa.RecordBatch.from_arrays([pa.array(x.s), pa.array(x.doc), pa.array(x.line), pa.array(x.n.astype(np.int32)), *bits, *lists], names=["s", "doc", "line", "n", "bits0", "bits1", "prefix", "often", "near"])

    return docs.mapInArrow(run, "s bigint, doc bigint, line bigint, n int, bits0 bigint, bits1 bigint, prefix array<bigint>, often array<bigint>, near array<bigint>")


def prefix_rows(kinds: DataFrame, *more: str) -> DataFrame:
    """(word, s, meta, bits0, bits1): a row for each word of each set's prefix; meta: size << 32 | place of the word << 1 | drained."""
    rows = kinds.select("s", "n", "drained", "bits0", "bits1", *more, F.posexplode("prefix").alias("pos", "word")).filter("word is not null")
    meta = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.shiftleft("pos", 1)).bitwiseOR(F.col("drained").cast("int"))
    return rows.select("word", "s", meta.alias("meta"), "bits0", "bits1", *more)


def side(rows: DataFrame, k: int) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{c}{k}") for c in rows.columns])


def size_of(k: int) -> Column:
    return F.shiftright(f"meta{k}", 32)


def pos_of(k: int) -> Column:
    return F.shiftright(F.col(f"meta{k}").bitwiseAND(0xFFFFFFFF), 1)


def is_drained(k: int) -> Column:
    return F.col(f"meta{k}").bitwiseAND(1) == 1


def may_be_similar() -> Column:
    """Length, positional and parity filters on two sides that share a word: their sizes' ratio, the words at and behind the shared one, and the bits that differ leave room for the overlap."""
    n1, n2 = size_of(1), size_of(2)
    overlap = F.floor((4 * (n1 + n2) + 8) / 9)
    near = 5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)
    near &= F.least(n1 - pos_of(1), n2 - pos_of(2)) >= overlap
    return near & (F.bit_count(F.col("bits01").bitwiseXOR(F.col("bits02"))) + F.bit_count(F.col("bits11").bitwiseXOR(F.col("bits12"))) <= n1 + n2 - 2 * overlap)


def candidates(rows: DataFrame) -> DataFrame:
    """(s1, s2) of sets that may be similar: the smaller shares a word of its shortest prefix with the prefix of the larger. Pairs of drained sets are left out."""
    n1, n2 = size_of(1), size_of(2)
    # the filters are all part of the join's condition, so that both sides are one exchange
    smaller = (n1 < n2) | ((n1 == n2) & (F.col("s1") < F.col("s2")))
    short = pos_of(1) + F.least(n2, F.lit(0)) <= n1 - F.floor((8 * n1 + 8) / 9)
    met = side(rows, 1).join(side(rows, 2), (F.col("word1") == F.col("word2")) & smaller & short & ~(is_drained(1) & is_drained(2)) & may_be_similar())
    return met.select("s1", "s2").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, words) of the sets in ``wanted`` (s), and maybe of some others; a set may come more than once. A bit map of fixed size picks them."""
    table = docs.sparkSession.sparkContext.broadcast(bit_map(wanted, F.pmod("s", F.lit(MAP_BITS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for x in line_sets(batches):
            bit = x.s & (MAP_BITS - 1)
            pick = [i for i in np.flatnonzero(table.value[bit >> 6] >> (bit & 63) & 1).tolist() if int(x.s[i]) not in seen]
            if len(seen) > REMEMBER:
                seen.clear()
            seen.update(x.s[pick].tolist())
            words = [x.h[x.first[i] : x.first[i] + x.n[i]].view(np.int64) for i in pick]
            yield pa.RecordBatch.from_arrays([pa.array(x.s[pick]), pa.array(words, pa.list_(pa.int64()))], names=["s", "words"])

    return docs.mapInArrow(run, "s bigint, words array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (s1, s2) whose sets are similar."""
    pairs = pairs.join(sets.select(F.col("s").alias("a"), F.col("words").alias("words1")), F.col("s1") == F.col("a"))
    pairs = pairs.join(sets.select(F.col("s").alias("b"), F.col("words").alias("words2")), F.col("s2") == F.col("b"))
    return pairs.withColumn("o", F.size(F.array_intersect("words1", "words2"))).filter(9 * F.col("o") >= 4 * (F.size("words1") + F.size("words2"))).select("s1", "s2")


def near_rows(kinds: DataFrame, *more: str) -> DataFrame:
    """Like ``prefix_rows``, for keys of near copies: they say nothing of places in a prefix."""
    meta = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("drained").cast("int"))
    return kinds.select(F.explode("near").alias("word"), "s", meta.alias("meta"), "bits0", "bits1", *more)


def drained(docs: DataFrame, kinds: DataFrame, keys: str, crowd: int) -> DataFrame | None:
    """(s): sets of crowds that are similar to the earliest set of their crowd, and so go, whatever else they are similar to. None if there is no crowd.

    keys: the column whose values make crowds. Near copies of one line share ``near`` and the rare
    words in ``often``, so that the earliest set with such a key is most often the line's first
    copy. A crowd of g sets gives g pairs here. The join need not pair what only a drained set
    could lose by; all other pairs it meets as before.
    """
    heavy = written(kinds.select(F.explode(keys).alias("heavy")).groupBy("heavy").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > crowd).select("heavy"), "heavy")
    if heavy.isEmpty():
        return None
    rows = (near_rows if keys == "near" else prefix_rows)(kinds, "doc", "line")
    members = written(rows.join(if_small(heavy, BROADCAST_WORDS), F.col("word") == F.col("heavy")).drop("heavy"), "members")
    heads = written(members.groupBy("word").agg(F.min(F.struct("doc", "line", "s", "meta", "bits0", "bits1")).alias("head")).select("word", "head.*"), "heads")
    met = side(members, 2).join(side(heads, 1), F.col("word1") == F.col("word2"))
    pairs = written(met.filter((F.col("s1") != F.col("s2")) & ~is_drained(2) & may_be_similar()).select("s1", "s2").distinct(), "stars")
    places = written(places_of(kinds, pairs), "places")
    sets = written(whole_sets(docs, places), "crowded")
    gone = written(verified(pairs, sets).select(F.col("s2").alias("s")).distinct(), "drained")
    dropped(heavy, members, heads, pairs, places, sets)
    return gone


def places_of(kinds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s, doc, line, drained) of the sets in pairs (s1, s2)."""
    wanted = pairs.select(F.col("s1").alias("w")).union(pairs.select("s2")).distinct()
    return kinds.join(wanted, F.col("s") == F.col("w"), "left_semi").select("s", "doc", "line", "drained")


def whole_sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(s, words) of sets, from the texts of their first lines."""
    return sets_of(among(docs.select("text", "doc"), places.select("doc"))[0].select("doc", "text"), places.select("s")).dropDuplicates(["s"])


def late_sets(pairs: DataFrame, places: DataFrame, sets: DataFrame) -> DataFrame:
    """(late): sets of the pairs (s1, s2) that are similar to one with an earlier first line. Each is held against the earliest it is paired with; only those not similar to that, against all."""
    place = lambda k: places.select(F.col("s").alias(f"k{k}"), F.struct("doc", "line").alias(f"at{k}"), F.col("drained").alias(f"gone{k}"))
    first = F.col("at1") < F.col("at2")
    pick = lambda x: F.when(first, F.col(f"{x}1")).otherwise(F.col(f"{x}2"))
    other = lambda x: F.when(first, F.col(f"{x}2")).otherwise(F.col(f"{x}1"))
    both = pairs.join(place(1), F.col("s1") == F.col("k1")).join(place(2), F.col("s2") == F.col("k2")).filter(~other("gone"))
    ordered = written(both.select(pick("s").alias("early"), other("s").alias("late"), pick("at").alias("at")), "ordered")
    named = lambda df: df.select(F.col("early").alias("s1"), F.col("late").alias("s2"))
    tried = ordered.groupBy("late").agg(F.min(F.struct("at", "early")).alias("first")).select("first.early", "late")
    once = written(verified(named(tried), sets).select(F.col("s2").alias("late")), "once")
    rest = ordered.join(once.select(F.col("late").alias("done")), F.col("late") == F.col("done"), "left_anti")
    late = written(once.union(verified(named(rest), sets).select("s2")).distinct(), "late")
    dropped(ordered, once)
    return late


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc, line) of the lines to remove, of documents (doc, text)."""
    docs = docs.select("doc", F.col("text").cast("binary").alias("text"))
    found = written(described(docs, rarity(docs)), "found")
    lines = written(found.select("s", "doc", "line"), "lines")
    payload = [F.max(c).alias(c) for c in ("n", "bits0", "bits1")]
    lists = [F.first(c, ignorenulls=True).alias(c) for c in ("prefix", "often", "near")]
    kinds = found.groupBy("s").agg(F.min(F.struct("doc", "line")).alias("first"), *payload, *lists)
    kinds = written(kinds.select("s", "first.doc", "first.line", "n", "bits0", "bits1", "prefix", "often", "near", F.lit(False).alias("drained")), "kinds")
    dropped(found)
    unmarked, gone, few = kinds, None, False
    for keys, crowd in (("near", NEAR), ("often", CROWD)):
        more = drained(docs, kinds, keys, crowd)
        if more is not None:
            gone = more if gone is None else written(gone.union(more), "gone")
            known = if_small(gone, BROADCAST_SETS)
            few = known is not gone
            kinds = unmarked.drop("drained").join(known.select(F.col("s").alias("g")), F.col("s") == F.col("g"), "left").withColumn("drained", F.col("g").isNotNull()).drop("g")
    if gone is not None and not few:
        kinds = written(kinds, "marked")
        dropped(unmarked, gone)
    links = written(candidates(prefix_rows(kinds)), "links")
    places = written(places_of(kinds, links), "places")
    sets = written(whole_sets(docs, places), "sets")
    late = late_sets(links, places, sets)
    dropped(links, places, sets)
    late = late.union(kinds.filter("drained").select("s"))
    known = kinds.join(late, F.col("s") == F.col("late"), "left").select(F.col("s").alias("k"), F.col("doc").alias("d0"), F.col("line").alias("l0"), F.col("late").isNotNull().alias("gone"))
    return lines.select("s", "doc", "line").join(known, F.col("s") == F.col("k")).filter(F.col("gone") | (F.col("doc") != F.col("d0")) | (F.col("line") != F.col("l0"))).select("doc", "line").distinct()


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_lines, removed (numbers of removed lines, from 0, in order), kept (the other lines).

    Lines are split at newlines. A line's set holds its words (split at ASCII white space, A-Z
    lower-cased). A line goes if an earlier line (of a smaller id, or earlier in its document),
    itself removed or not, has a set of Jaccard similarity 0.8 or more. Lines without words stay.
    Null texts have no lines. Documents with a null id count as last; rows with one id are ordered
    by the text's MD5, and rows equal in both are one document and give equal rows. Sets are told
    apart by 64-bit hashes. Ids may be of any type with an order. Other columns are not read.
    """
    docs = numbered(docs, id_col, text_col)
    gone = repeated_lines(docs.dropDuplicates(["doc"]) if "m" in docs.columns else docs).groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    gone = written(gone, "gone")
    lost = if_small(gone, BROADCAST_DOCS).withColumnRenamed("doc", "own")
    have, same = among(docs.select("id", "text", "doc"), gone.select("doc"))
    lines = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    n = F.size(lines).cast("bigint").alias("n_lines")
    none = F.array().cast("array<bigint>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, removed in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                out = set(removed or ())
                kept.append(text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(kept, pa.string())], names=["id", "n_lines", "removed", "kept"])

    kind = f"id {docs.schema['id'].dataType.simpleString()}, n_lines bigint, removed array<bigint>, kept string"
    changed = have.join(lost, have["doc"] == F.col("own"), "left").select("id", "text", n, F.coalesce("removed", none).alias("removed")).mapInArrow(cut, kind)
    return changed.union(same.select("id", n, none, "text")).withColumnRenamed("id", id_col)
