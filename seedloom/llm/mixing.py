"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree of levels (domain, language, source). At each node children get
shares by weight; a child whose subtree cannot take its share gets all it has, and what it leaves
goes to its siblings first. Only what a whole family cannot take has been withheld a level up,
where it went to the family's own siblings. Each leaf then takes a prefix of its tokens over seeded
epochs: whole passes, then the start of one more shuffled pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_name, ranked, text_key, written

#: Passes that a leaf may make over its documents.
MAX_EPOCHS = 4
#: Share of all tokens that is asked for, as numerator and denominator.
BUDGET = (1, 2)
SEED = 17
WORD_GAP = r"[\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Words split at ASCII white space; null and empty texts have none."""
    return F.coalesce(F.size(F.filter(F.split(text, WORD_GAP), lambda w: w != "")), F.lit(0)).cast("bigint")


def shares(leaves: DataFrame, levels: list[str], weights: dict[str, Column], budget: int) -> DataFrame:
    """``leaves`` (levels, cap) with a column alloc: tokens for each leaf, never more than its cap.

    ``weights`` has a column expression of positive numbers for each level, over that level's and
    the levels' columns above it. Filled by water level: among siblings in order of cap / weight,
    a child is full if its share of what the fuller ones leave reaches its cap.
    """
    out = leaves.withColumn("given", F.lit(float(budget)))
    for depth, level in enumerate(levels):
        family = levels[:depth]
        node = out.groupBy(*family, level).agg(F.sum("cap").cast("double").alias("node_cap"), F.first("given").alias("given")).withColumn("weight", weights[level].cast("double"))
        siblings = Window.partitionBy(*family)
        order = siblings.orderBy(F.col("node_cap") / F.col("weight"), F.col(level).asc_nulls_first())
        node = node.withColumns({
            "left": F.col("given") - F.coalesce(F.sum("node_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "turn": F.row_number().over(order),
        })
        # in this order the full ones come first; the first that is not, and all behind it, share what is left
        node = node.withColumn("open", F.when(F.col("node_cap") * F.col("rest") > F.col("left") * F.col("weight"), F.struct("turn", "left", "rest")))
        node = node.withColumn("first", F.min("open").over(siblings))
        node = node.withColumn("share", F.when(F.col("first").isNull() | (F.col("turn") < F.col("first.turn")), F.col("node_cap")).otherwise(F.col("first.left") * F.col("weight") / F.col("first.rest")))
        keys = [*family, level]
        node = node.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("share").alias("given"))
        on = None
        for k in keys:
            same = F.col(k).eqNullSafe(F.col(f"__{k}"))
            on = same if on is None else on & same
        out = out.drop("given").join(node, on).drop(*[f"__{k}" for k in keys])
    return out.withColumn("alloc", F.floor("given").cast("bigint")).drop("given")


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, Column], budget: tuple[int, int] = BUDGET, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Per chosen document: id, the levels, n_tokens, epochs (how often it is taken; 1 or more).

    ``levels`` name the tree's columns from the root down, ``weights`` a positive weight for each.
    The budget is a share of all tokens. A leaf may give ``max_epochs`` times its tokens. It takes
    whole passes while they fit, then, in an order dealt by MD5 of seed, pass and id, documents
    while their running sum fits (so a leaf falls short by less than its next document). Null level
    values are a class of their own; null and empty texts have no tokens and are never taken in a
    started pass behind its end. Repeated rows are taken each for itself; an empty table gives no rows.
    """
    names = list(levels)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *[c.alias(n) for n, c in levels.items()])
    rows = written(own.select("id", *names, tokens(F.col("t")).alias("n_tokens")), "tokens")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("sum_tokens"))
    leaves = leaves.withColumn("cap", F.col("sum_tokens") * max_epochs)
    plan = shares(leaves, names, weights, total * budget[0] // budget[1])
    plan = plan.withColumn("passes", F.when(F.col("sum_tokens") > 0, F.floor(F.col("alloc") / F.col("sum_tokens"))).otherwise(0).cast("int"))
    plan = plan.withColumn("more", F.col("alloc") - F.col("passes") * F.col("sum_tokens"))
    plan = written(plan.select(*[F.col(k).alias(f"__{k}") for k in names], "passes", "more"), "plan")
    on = None
    for k in names:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    rows = rows.join(plan, on).drop(*[f"__{k}" for k in names])
    order = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "passes", F.coalesce(F.col("id").cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("bigint")
    dealt = ranked(rows, names, F.shiftleft(order, 4), ["id", "n_tokens"], n, weight=F.col("n_tokens"))
    taken = F.col("passes") + (F.col("rank_before") + F.col("n_tokens") <= F.col("more")).cast("int")
    return dealt.withColumn("epochs", taken).filter("epochs > 0").select(F.col("id").alias(id_col), *names, "n_tokens", "epochs")


#: Tree of the driver tables: sources are named by number; the first three and those from ten on form a domain each.
def document_levels() -> dict[str, Column]:
    number = F.try_to_number(F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]+)$", 1), F.lit("999999")).cast("int")
    return {"domain": F.when(number < 3, "web").when(number < 10, "books").otherwise("code"), "lang": F.col("lang"), "source": F.col("source")}


def document_weights() -> dict[str, Column]:
    by = lambda col, of: sum((F.when(F.col(col) == k, v).otherwise(0) for k, v in of.items()), F.lit(0))
    lang = by("lang", {"en": 5, "de": 2, "fr": 2, "es": 1})
    return {"domain": F.coalesce(by("domain", {"web": 3, "books": 4, "code": 3}), F.lit(1)), "lang": F.when(lang > 0, lang).otherwise(1), "source": F.lit(1)}


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: tuple[int, int] = BUDGET) -> DataFrame:
    """The documents that one pass of ``mix`` takes, with their columns. Rows are named by id and text, so that others of an id, or without one, are chosen for themselves; rows alike in both go together."""
    name = F.concat_ws("-", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_key(F.col(text_col)))
    named = docs.select(name.alias("name"), F.col(text_col).alias("text"), F.col("lang"), F.col("source"))
    chosen = mix(named, document_levels(), document_weights(), budget, 1, "name", "text").select(F.col("name").alias(k := own_name("name"))).distinct()
    return docs.join(chosen, name == chosen[k], "left_semi")


def oracle() -> str:
    """``mix`` over ``documents`` with its production parameters, for DuckDB."""
    levels = ["domain", "lang", "source"]
    weight = {
        "domain": "CASE domain WHEN 'web' THEN 3 WHEN 'books' THEN 4 WHEN 'code' THEN 3 ELSE 1 END",
        "lang": "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 1 ELSE 1 END", "source": "1",
    }
    parts = ["""own AS (SELECT doc_id, lang, source, try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '') AS INT) AS number,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents)""",
        "rows_ AS (SELECT doc_id, CASE WHEN number < 3 THEN 'web' WHEN number < 10 THEN 'books' ELSE 'code' END AS domain, lang, source, n_tokens FROM own)",
        f"""given0 AS (SELECT domain, lang, source, sum(n_tokens) AS sum_tokens, sum(n_tokens) * {MAX_EPOCHS} AS cap,
        (SELECT CAST(sum(n_tokens) * {BUDGET[0]} // {BUDGET[1]} AS DOUBLE) FROM rows_) AS given FROM rows_ GROUP BY domain, lang, source)"""]
    for d, level in enumerate(levels):
        keys = levels[: d + 1]
        part = f"PARTITION BY {', '.join(levels[:d])}" if d else ""
        parts.append(f"node{d} AS (SELECT {', '.join(keys)}, CAST(sum(cap) AS DOUBLE) AS node_cap, any_value(given) AS given, CAST({weight[level]} AS DOUBLE) AS weight FROM given{d} GROUP BY {', '.join(keys)})")
        order = f"({part} ORDER BY node_cap / weight, {level} NULLS FIRST"
        parts.append(f"""turn{d} AS (SELECT *, given - coalesce(sum(node_cap) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
        sum(weight) OVER {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER {order}) AS turn FROM node{d})""")
        parts.append(f"first{d} AS (SELECT *, min(CASE WHEN node_cap * rest > lft * weight THEN turn END) OVER ({part}) AS t FROM turn{d})")
        parts.append(f"level{d} AS (SELECT *, max(CASE WHEN turn = t THEN lft END) OVER ({part}) AS flft, max(CASE WHEN turn = t THEN rest END) OVER ({part}) AS frest FROM first{d})")
        on = " AND ".join(f"g.{k} IS NOT DISTINCT FROM l.{k}" for k in keys)
        parts.append(f"given{d + 1} AS (SELECT g.domain, g.lang, g.source, g.sum_tokens, g.cap, CASE WHEN t IS NULL OR turn < t THEN node_cap ELSE flft * weight / frest END AS given FROM given{d} g JOIN level{d} l ON {on})")
    parts.append("plan AS (SELECT *, CASE WHEN sum_tokens > 0 THEN CAST(floor(given) AS BIGINT) // sum_tokens ELSE 0 END AS passes FROM given3)")
    on = " AND ".join(f"r.{k} IS NOT DISTINCT FROM p.{k}" for k in levels)
    parts.append(f"""dealt AS (SELECT r.*, p.passes, CAST(floor(p.given) AS BIGINT) - p.passes * p.sum_tokens AS more,
        substring(md5(concat_ws('-', '{SEED}', p.passes, coalesce(CAST(r.doc_id AS VARCHAR), 'null'))), 1, 15) AS h FROM rows_ r JOIN plan p ON {on})""")
    parts.append("run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM dealt)")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(passes + CASE WHEN upto <= more THEN 1 ELSE 0 END AS INT) AS epochs FROM run WHERE passes > 0 OR upto <= more"
