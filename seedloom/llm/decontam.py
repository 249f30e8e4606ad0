"""Benchmark decontamination by winnowing.

A k-gram fingerprint is kept where it is the smallest of a sliding window of ``w`` k-grams. Two
texts that share ``k + w - 1`` words keep the same fingerprint inside that span, so joining the
kept fingerprints and extending each hit word by word finds every shared span of that length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, own_name

#: Item words in a row that count as a leak; a shorter item is one window.
SPAN = 10
#: Benchmark fingerprints up to which they are broadcast; each takes some 250 bytes.
BROADCAST_FINGERPRINTS = 100_000
#: What ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` matches, as a class of what is in it: the regex engine takes ten times as long over the complement.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words in order; null has none."""
    return F.transform(F.coalesce(F.regexp_extract_all(lower_az(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>")), lambda w: F.xxhash64(w))


def gram_size(span: int) -> tuple[int, int]:
    """(k, w) with k + w - 1 = span."""
    k = (span + 1) // 2
    return k, span - k + 1


def grams(words: Column, n: Column, span: int) -> Column:
    """Hashes of a text's k-grams in order."""
    k, _ = gram_size(span)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + F.lit(t)) for t in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def kept(g: Column, i: Column, n: Column, span: int) -> Column:
    """The smallest k-gram hash of the window at ``i``; null if the window before it kept the same k-gram. Ties: the leftmost."""
    _, w = gram_size(span)
    at = [F.get(g, i + F.lit(j)) for j in range(-1, w)]
    low = lambda hs: F.least(*hs) if len(hs) > 1 else hs[0]
    fresh = (i == 0) | (at[0] <= low(at[1:w])) | (at[w] < low(at[1:w])) if w > 1 else F.lit(True)
    return F.when((i >= 0) & (i + F.lit(span) <= n) & fresh, low(at[1:]))


def place(g: Column, i: Column, h: Column, span: int) -> Column:
    """First word of the k-gram that the window at ``i`` kept."""
    _, w = gram_size(span)
    return i + F.array_position(F.slice(g, F.greatest(i, F.lit(0)) + 1, F.lit(w)), h).cast("int") - 1


def benchmark_fingerprints(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, item, span, around): kept fingerprints of the items, with the word hashes around each, as far as a window reaches."""
    items = bench.select(F.col(id_col).alias("item"), word_hashes(F.col(text_col)).alias("words")).filter("item is not null and size(words) > 0").distinct()
    items = items.withColumn("n", F.size("words")).withColumn("span", F.least(F.col("n"), F.lit(SPAN)))
    by_span = lambda f: reduce(lambda rest, s: F.when(F.col("span") == s, f(s)).otherwise(rest), range(1, SPAN), f(SPAN))
    items = items.withColumn("g", by_span(lambda s: grams(F.col("words"), F.col("n"), s))).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("span"))).alias("i"))
    items = items.withColumn("h", by_span(lambda s: kept(F.col("g"), F.col("i"), F.col("n"), s))).filter("h is not null")
    items = items.withColumn("q", by_span(lambda s: place(F.col("g"), F.col("i"), F.col("h"), s)))
    around = F.transform(F.sequence(F.lit(-SPAN), F.lit(2 * SPAN)), lambda j: F.get(F.col("words"), F.col("q") + j))
    return items.select("h", "item", F.col("span").alias("item_span"), around.alias("around")).distinct()


def near(words: Column, p: Column) -> Column:
    """The words as far around a k-gram as a window reaches. No lambda: rows that carry a whole text must not leave generated code."""
    return F.array(*[F.get(words, p + F.lit(t)) for t in range(-SPAN, 2 * SPAN + 1)])


def extended(text: Column, item: Column, span: int, k: int, w: int) -> tuple[Column, Column]:
    """Words that a joined k-gram can be extended by to the left and to the right while text and item agree; null where the k-gram itself differs."""
    same = lambda t: F.coalesce(F.get(text, F.lit(SPAN + t)) == F.get(item, F.lit(SPAN + t)), F.lit(False))
    whole = reduce(lambda x, y: x & y, [same(t) for t in range(k)])
    run = lambda at: F.when(whole, reduce(lambda rest, t: F.when(~same(at(t)), F.lit(t - 1)).otherwise(rest), range(w - 1, 0, -1), F.lit(w - 1)))
    return run(lambda t: -t), run(lambda t: k - 1 + t)


def hits(base: DataFrame, fps: DataFrame, span: int, small: bool, with_docs: bool) -> DataFrame:
    """(id, key, n, i, item, run): runs of words shared with items of window length ``span``; with_docs: and a row at i = -1 for each document."""
    k, w = gram_size(span)
    fps = fps.filter(F.col("item_span") == span).select("h", "item", "around")
    base = base.withColumn("g", grams(F.col("words"), F.col("n"), span))
    found = base.select("*", F.explode(F.sequence(F.lit(-1), F.col("n") - 1)).alias("i")).withColumn("h", kept(F.col("g"), F.col("i"), F.col("n"), span))
    if small:
        # the row at -1 stands for the document itself and passes without a partner
        met = found.filter("i < 0 or h is not null").join(F.broadcast(fps), "h", "left").filter("i < 0 or item is not null")
    else:
        # no size that Spark has for rows behind an explode is near theirs, so neither side is left to be broadcast by it
        cand = found.filter("h is not null").select(F.col("id").alias("cid"), F.col("key").alias("ckey"), "i", "h").distinct().hint("merge").join(fps.hint("merge"), "h")
        met = cand.hint("merge").join(base.dropDuplicates(["id", "key"]), F.col("id").eqNullSafe(F.col("cid")) & (F.col("key") == F.col("ckey")))
    # inline() keeps the filters below it from being moved above and repeating what they test for every word
    once = lambda df, rest, **cols: df.select(*rest, F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))
    own = ["id", "key", "n", "i", "item"]
    met = once(met, [*own, "around", "words"], p=place(F.col("g"), F.col("i"), F.col("h"), span))
    met = once(met, [*own, "around", "p"], near=near(F.col("words"), F.col("p")))
    left, right = extended(F.col("near"), F.col("around"), span, k, w)
    run = once(met, [*own, "p"], left=left, right=right).filter((F.col("i") < 0) | (F.col("left") + F.col("right") + k >= span))
    run = run.select(*own, (F.col("p") - F.col("left")).alias("a"), (F.col("p") + F.lit(k - 1) + F.col("right")).alias("b"))
    if small:
        return run if with_docs else run.filter("i >= 0")
    return run.union(base.select("id", "key", "n", F.lit(-1), F.lit(None), F.lit(None), F.lit(None))) if with_docs else run


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted ids, as strings).

    A word inside any occurrence of a window of ``SPAN`` consecutive item words is hit; an item of
    fewer words is one window. Null and wordless texts have no words and hit nothing. Items with a
    null id or no words are left out; repeated items count once. Repeated documents (same id and
    text) give a row each. Empty tables give no hits or no rows. Other columns are not read.

    Documents are read once more for each window length below ``SPAN`` that an item has.
    Up to ``broadcast_rows`` benchmark fingerprints are broadcast and documents are read once;
    beyond it fingerprints meet in a shuffle join and documents are read again for the extension.
    """
    per = by_text(docs, bench, id_col, text_col, item_id, item_text, broadcast_rows)
    return per.select(F.col("id").alias(id_col), F.col("n_words").cast("bigint"), F.col("n_hit").cast("bigint"), "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def by_text(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """(id, key, n_words, copies, n_hit, items): a row for each id and text, with the text's hash."""
    fps = benchmark_fingerprints(bench, item_id, item_text)
    spans = sorted({SPAN, *[r[0] for r in fps.select("item_span").distinct().collect()]})
    small = fps.count() <= broadcast_rows
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), word_hashes(F.col(text_col)).alias("words")).withColumn("n", F.size("words"))
    runs = reduce(DataFrame.union, [hits(base, fps, s, small, s == SPAN) for s in spans])
    words = runs.select("id", "key", "n", "i", "item", F.explode(F.when(F.col("i") < 0, F.array(F.lit(-1))).otherwise(F.sequence("a", "b"))).alias("word"))
    return words.groupBy("id", "key").agg(F.first("n").alias("n_words"), F.count(F.when(F.col("i") < 0, 1)).alias("copies"), F.size(F.collect_set(F.when(F.col("word") >= 0, F.col("word")))).alias("n_hit"), F.sort_array(F.collect_set(F.when(F.col("i") >= 0, F.col("item").cast("string")))).alias("items"))


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_share: float = 0.0) -> DataFrame:
    """The documents with at most ``max_share`` of their words hit, with their columns. Each row is judged by its own text, whatever rows share its id."""
    bad = by_text(docs, bench, id_col, text_col).filter(F.col("n_hit") > F.col("n_words") * F.lit(max_share)).select(F.col("id").alias(i := own_name("id")), F.col("key").alias(k := own_name("key")))
    return docs.join(bad, docs[id_col].eqNullSafe(bad[i]) & (F.xxhash64(docs[text_col]) == bad[k]), "left_anti")
