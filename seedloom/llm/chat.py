"""Chat formatting: logged snapshots of growing conversations collapse to the longest, then render.

A logging client that stores the whole conversation at every turn leaves many that are prefixes of
longer ones. Rolling hashes of turn prefixes name each prefix; a conversation whose whole is a
proper prefix of another's turns, or equals one of a smaller id, is dropped by anti-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Turns of a conversation that are numbered in one task.
BLOCK = 4096
TEMPLATE = ("<|", "|>\n", "<|end|>\n")


def turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, block, place, role, text, part1, part2): turns in order; parts are two hashes of place, role and text.

    A conversation is numbered in blocks of turn values, counted first, so that a very long one is not one task's work.
    """
    rows = conversations.select(F.col(id_col).alias("id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.filter("id is not null").withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("bigint"))
    within = Window.partitionBy("id", "block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    sizes = rows.groupBy("id", "block").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("id").alias("sid"), F.col("block").alias("sblock"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"))
    out = rows.withColumn("at", F.row_number().over(within)).join(sizes, (F.col("id") == F.col("sid")) & (F.col("block") == F.col("sblock")))
    out = out.withColumn("place", F.col("at") + F.col("k0"))
    said = [F.col("place"), F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    return out.select("id", "block", "place", "role", "text", F.xxhash64(F.lit(1), *said).alias("part1"), F.xxhash64(F.lit(2), *said).alias("part2"))


def rolling(rows: DataFrame) -> DataFrame:
    """(id, place, h): h names the first ``place`` turns. Parts are folded by wrapping sums (of halves, so that none overflows), which blocks can share."""
    lows = {f"{p}{s}": (F.col(p).bitwiseAND(0xFFFFFFFF) if s == "l" else F.shiftrightunsigned(p, 32)) for p in ("part1", "part2") for s in "lh"}
    rows = rows.select("id", "block", "place", *[c.alias(k) for k, c in lows.items()])
    sums = rows.groupBy("id", "block").agg(*[F.sum(k).alias(k) for k in lows])
    before = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("id").alias("sid"), F.col("block").alias("sblock"), *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}0") for k in lows])
    upto = Window.partitionBy("id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, (F.col("id") == F.col("sid")) & (F.col("block") == F.col("sblock")))
    return out.select("id", "place", F.struct(*[(F.sum(k).over(upto) + F.col(f"{k}0")).alias(k) for k in lows]).alias("h"))


def maximal(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns of the conversations that stay, (top, n, copies) of them); copies: how many conversations had exactly these turns."""
    rows = written(turns(conversations, id_col, turn_col, role_col, text_col), "turns")
    rolled = written(rolling(rows), "rolling")
    whole = rolled.groupBy("id").agg(F.max(F.struct("place", "h")).alias("last")).select("id", F.col("last.place").alias("n"), F.col("last.h").alias("h"))
    # one of each group of equal conversations stays, and counts its copies
    kinds = whole.groupBy("h", "n").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    kinds = written(kinds, "kinds")
    lengths = kinds.select(F.col("id").alias("kid"), F.col("n").alias("kn"))
    # prefixes of kept kinds only, each named once however many conversations begin with it
    proper = rolled.join(lengths, F.col("id") == F.col("kid")).filter("place < kn").select(F.col("h").alias("ph")).distinct()
    top = written(kinds.join(proper, F.col("h") == F.col("ph"), "left_anti").select(F.col("id").alias("top"), "n", "copies"), "maximal")
    return rows.join(top.select("top"), F.col("id") == F.col("top"), "left_semi"), top


def rendered(role: Column, text: Column) -> Column:
    """A turn in the template; a null role is 'user', a null text empty. The template's own marks in a text are broken up."""
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(TEMPLATE[0]), F.coalesce(role, F.lit("user")), F.lit(TEMPLATE[1]), safe, F.lit(TEMPLATE[2]))


def chat_format(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation that stays: id, n_turns, copies, chat (its turns rendered in order).

    Turns are ordered by turn number (nulls first), then role, then text; numbers need not be
    gapless. A conversation goes if its turns (roles and texts, nulls equal) are the first turns
    of a longer one, or all the turns of one with a smaller id; copies counts the conversations
    with exactly its turns. Rows without an id are left out. Repeated rows are turns of their own.
    """
    rows, top = maximal(conversations, id_col, turn_col, role_col, text_col)
    said = rows.groupBy("id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", rendered(F.col("role"), F.col("text")).alias("said")))), lambda x: x["said"]), "").alias("said"))
    chat = said.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "said"))), lambda x: x["said"]), "").alias("chat"))
    return chat.join(top, F.col("id") == F.col("top")).select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_turns"), F.col("copies").cast("bigint").alias("copies"), "chat")


def oracle() -> str:
    """``chat_format`` over ``conversations`` for DuckDB, by comparing lists of turns."""
    return """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY place) AS said,
      string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY place) AS chat FROM t GROUP BY conv_id),
k AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, n, said, any_value(chat) AS chat FROM c GROUP BY n, said),
p AS (SELECT DISTINCT said[1:i] AS said FROM (SELECT said, unnest(range(1, n)) AS i FROM k))
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, CAST(copies AS BIGINT) AS copies, chat FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.said = k.said)"""
