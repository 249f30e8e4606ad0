"""Quality rules: a decision list learned by sequential covering, applied as Spark conditionals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, own_name, text_key, written

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words in a repeated window; share of a text's words, in percent, that may lie in one; fewest words.
WINDOW, MAX_REPEAT_PERCENT, MIN_WORDS = 8, 30, 20
#: Statistics that rules may test, each a share or a mean of the base counts.
FEATURES = ("word_length", "symbol_share", "stutter_share", "upper_share", "repeat_share", "dup_line_share")
#: Thresholds a statistic is tested at: these quantiles among rejected and among accepted labelled rows, on a grid.
REJECTED_AT, ACCEPTED_AT = (0.05, 0.25, 0.5), (0.002, 0.02, 0.5, 0.98, 0.998)
#: Steps of the grid to one, and its end; values beyond count at the end.
GRID, GRID_END = 500, 40
#: A rule must be so precise on the labelled rows, cover so many, and test so few statistics; so many rules are tried.
MIN_PRECISION, MIN_COVER, MAX_TESTS, MAX_RULES, MAX_TRIES = 0.97, 3, 4, 8, 16


def repeated_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that the text holds twice or more. Linear but for one sort, which only texts with a repeat need."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - F.lit(WINDOW)), lambda i: F.xxhash64(*[F.get(words, i + F.lit(j)) for j in range(WINDOW)]))

    def covered(starts: Column) -> Column:
        step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n"), x.alias("last"))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    def starts(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, j: (F.get(ordered, j - 1)["h"] == x["h"]) | (F.get(ordered, j + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def count(hs: Column) -> Column:
        placed = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(placed, lambda s: covered(starts(s))))

    return F.when(n <= WINDOW, F.lit(0)).otherwise(let(hashes, count))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (of the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and what ``FEATURES`` need. Null texts have no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), F.aggregate(w, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)).alias("word_chars"), F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).alias("n_stutter"), repeated_words(w).cast("bigint").alias("n_repeat_words"))

    dup = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"), F.size(x).alias("n")))
    out = docs.select(
        F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), let(words, counts).alias("w"), dup.alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"), F.regexp_count(text, F.lit("[A-Z]")).alias("n_upper"),
    )
    return out.select("id", "key", "w.n_words", "w.word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words", F.col("l.n").alias("n_lines"), "n_upper", "w.n_stutter")


def features(stats: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.withColumns({
        "word_length": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / chars, "stutter_share": F.col("n_stutter") / words,
        "upper_share": F.col("n_upper") / chars, "repeat_share": F.col("n_repeat_words") / words, "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    })


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def learn(labelled: DataFrame) -> list[list[tuple[str, str, float]]]:
    """Rules in order, each a list of (statistic, '<=' or '>', threshold), from rows of ``FEATURES`` and ``bad`` (0/1).

    Every labelled row counts: values are counted in Spark on a fixed grid, which gives the
    quantiles that rules may cut at (so they are the same in every run), and then rows by the bin of
    each statistic. What comes to the driver is bounded: a count for each step of the grid, and one
    for each combination of bins, for either label and either part of the rows (two thirds grow
    rules, one third prunes them).
    """
    step = lambda f: F.least(F.floor(F.col(f) * GRID), F.lit(GRID * GRID_END)).cast("int")
    values = labelled.select("bad", F.posexplode(F.array(*[step(f) for f in FEATURES])).alias("f", "step"))
    hist: dict[tuple[int, int], list] = {}
    for f, bad, at, n in sorted(values.groupBy("f", "bad", "step").count().collect()):
        hist.setdefault((f, bad), []).append((at, n))
    cuts = [sorted({c for bad, qs in ((1, REJECTED_AT), (0, ACCEPTED_AT)) for c in quantiles(hist.get((f, bad), []), qs)}) for f in range(len(FEATURES))]
    bins = [sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cs), F.lit(0)).alias(f) for f, cs in zip(FEATURES, cuts, strict=True)]
    part = (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("part")
    counts = np.zeros((2, 2, *[len(c) + 1 for c in cuts]), dtype=np.int64)
    for r in labelled.select(part, F.col("bad").cast("int").alias("bad"), *bins).groupBy("part", "bad", *FEATURES).count().collect():
        counts[tuple(r[:-1])] += r[-1]
    return cover(counts, cuts)


def quantiles(hist: list[tuple[int, int]], at: tuple[float, ...]) -> list[float]:
    """Upper ends of the steps of (step, count), in order, that hold these shares of all counts."""
    if not hist:
        return []
    upto = np.cumsum([n for _, n in hist])
    return [(hist[int(np.searchsorted(upto, q * upto[-1]))][0] + 1) / GRID for q in at]


def cover(counts: np.ndarray, cuts: list[list[float]]) -> list[list[tuple[str, str, float]]]:
    """Sequential covering over counts by [part, label, bin of each statistic]; part 0 grows, part 1 prunes. What a rule too imprecise to keep would have covered is set aside while others are looked for."""
    left, seeds, rules = counts.copy(), counts.copy(), []

    def box(tests: list) -> tuple:
        bounds = [[0, n] for n in counts.shape[2:]]
        for f, op, c in tests:
            if op == ">":
                bounds[f][0] = max(bounds[f][0], c + 1)
            else:
                bounds[f][1] = min(bounds[f][1], c + 1)
        return tuple(slice(a, b) for a, b in bounds)

    def covered(part: int, tests: list, of: np.ndarray | None = None) -> tuple[int, int]:
        good, bad = (int((left if of is None else of)[(part, label, *box(tests))].sum()) for label in (0, 1))
        return bad, good

    worth = lambda bad, good: (bad - good) / max(1, bad + good)
    for _ in range(MAX_TRIES):
        tests: list = []
        bad, good = covered(0, tests, seeds)
        if len(rules) == MAX_RULES or bad < MIN_COVER:
            break
        while good and len(tests) < MAX_TESTS:
            best, gain = None, 0.0
            for f, cs in enumerate(cuts):
                for c in range(len(cs)):
                    for op in (">", "<="):
                        b, g = covered(0, [*tests, (f, op, c)], seeds)
                        if b and (x := b * (np.log2(b / (b + g)) - np.log2(bad / (bad + good)))) > gain + 1e-9:
                            best, gain = (f, op, c), x
            if best is None:
                break
            tests.append(best)
            bad, good = covered(0, tests, seeds)
        # pruning drops last tests while that does not make the rule worse on rows it was not grown on
        tests = max((tests[:n] for n in range(len(tests), 0, -1)), key=lambda t: worth(*covered(1, t)), default=[])
        if not tests:
            break
        bad, good = (sum(x) for x in zip(covered(0, tests), covered(1, tests), strict=True))
        if bad >= MIN_COVER and bad >= MIN_PRECISION * (bad + good):
            rules.append([(FEATURES[f], op, cuts[f][c]) for f, op, c in tests])
            left[(slice(None), slice(None), *box(tests))] = 0
            seeds[(slice(None), slice(None), *box(tests))] = 0
        else:
            seeds[(slice(None), 1, *box(tests))] = 0
    return rules


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The ordered list as one conditional: the number (from 1) of the first rule that holds, 0 if none."""
    out = F.lit(0)
    for n, tests in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for f, op, c in tests:
            holds = holds & (F.col(f) > c if op == ">" else F.col(f) <= c)
        out = F.when(holds, F.lit(n)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """The statistics of each document with base_failed and rule (0: none), by rules learned from the labels."""
    stats = written(features(statistics(docs, id_col, text_col)), "statistics")
    known = labels.select(F.col(label_id).alias("id"), (F.col(label) == 0).cast("int").alias("bad")).filter("id is not null and bad is not null")
    rules = learn(stats.join(known, "id").filter(~base_failed()))
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """Per document: id, base counts, base_failed, rule (0: none), kept.

    Labels join by id; a label of 0 is a document to reject, rows with a null id or label teach
    nothing, and an id labelled twice counts twice. Without labels no rule is learned and only the
    base rules reject. Null and empty texts have no words and fail the base. Each row of ``docs``
    gives a row; other columns are not read.
    """
    rows = judged(docs, labels, id_col, text_col, label_id, label)
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``judge`` keeps, with their columns. Each row is judged by its own text, whatever rows share its id."""
    bad = judged(docs, labels, id_col, text_col).filter("not kept").select(F.col("id").alias(i := own_name("id")), F.col("key").alias(k := own_name("key"))).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad[i]) & (text_key(docs[text_col]) == bad[k]), "left_anti")
