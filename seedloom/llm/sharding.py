"""Sharding by balanced label propagation: equal texts move together, shard sizes stay level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, written

SHARDS, ROUNDS = 16, 20
SEED = 11
#: Rows of a group up to which its rows are ranked by one hash.
SMALL = 1000


def shard(docs: DataFrame, n_shards: int = SHARDS, max_rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, size, text_crc32, law 'rows', shard, slot, grown_shard (null), group.

    Documents with equal texts are linked. Shards start level, dealt round-robin in hash order.
    In each round a linked document asks to move to the shard where most of its group is. Of two
    shards that ask each other, equal numbers swap; what is left over moves into a shard only
    against unlinked documents that leave it. So row counts, at most one apart at the start, never
    change. A group that was refused asks again, at a shard with room for all of it; a group that
    no shard can take whole fills one and goes on in the next, and so is cut as seldom as room allows. Null texts are one group (of size 1 each, crc of no
    bytes); repeated rows are documents of their own. Empty tables give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("crc"),
        F.coalesce(F.md5(F.col(text_col)), F.lit("null")).alias("grp"), F.xxhash64(F.lit(SEED), F.col(id_col)).alias("h"),
    )
    rows = written(rows, "rows")
    n = rows.count()
    start = written(ranked(rows, [], F.col("h"), ["id", "grp"], n, rank="row").withColumn("shard", F.pmod("row", F.lit(n_shards)).cast("int")), "start")
    many = written(start.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("grp"), "groups")
    linked = written(start.join(many, "grp", "left_semi").select("row", "grp", F.col("shard").alias("at")), "linked")
    placed = propagate(linked, level(start, linked, n_shards), n_shards, max_rounds)
    out = start.join(placed.select("row", F.col("at").alias("settled")), "row", "left")
    out = make_room(out, n_shards, n)
    slots = ranked(out, ["shard"], F.xxhash64("row"), ["row"], n // n_shards + 1, rank="slot")
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("grp").alias("text_group"))


def level(start: DataFrame, linked: DataFrame, n_shards: int) -> list[int]:
    """Unlinked rows of each shard."""
    free = [0] * n_shards
    for s, k in start.groupBy("shard").count().collect():
        free[s] += k
    for s, k in linked.groupBy("at").count().collect():
        free[s] -= k
    return free


def aims(most: DataFrame, free: list[int], n_shards: int, room: int, round_: int) -> DataFrame:
    """(grp, to, cut) of groups that lie in several shards, from their rows by shard (array ``k``).

    The first round aims at the shard with most of the group. Later ones aim at shards that can
    take the group whole, in proportion to their room, and more at those that hold a part. A group
    that fits nowhere stays among its shards: it is ``cut`` where it is larger than a shard, and
    each fourth round where there is no room; otherwise it waits for swaps.
    """
    k, frees = F.col("k"), F.array(*[F.lit(x).cast("bigint") for x in free])
    m = F.aggregate(k, F.lit(0).cast("bigint"), lambda a, x: a + x)
    most = most.withColumn("m", m).filter(F.size(F.filter(k, lambda x: x > 0)) > 1)
    most = most.withColumn("fits", F.exists(F.zip_with(k, frees, lambda x, f: x + f >= F.col("m")), lambda x: x) & (F.col("m") <= room))
    most = most.withColumn("cut", ~F.col("fits") & ((F.col("m") > room) | F.lit(round_ % 4 == 3)))
    draw = lambda s: (F.shiftrightunsigned(F.xxhash64("grp", s, F.lit(round_)), 11) + 1) / F.lit(float(1 << 53))

    def scored(s):
        x, f, tie = F.get(k, s), F.get(frees, s), draw(s)
        drawn = F.when(x + f >= F.col("m"), F.log(tie) / ((f + 1) * (1 + 8 * x / F.col("m")))).otherwise(F.lit(-1e300))
        held = F.when(x > 0, F.when(F.col("cut"), x + f).otherwise(x).cast("double")).otherwise(F.lit(-1e300))
        first = F.lit(round_ == 0) & ~F.col("cut")
        return F.struct(F.when(F.col("fits") & ~first, drawn).otherwise(held).alias("score"), tie.alias("tie"), s.cast("int").alias("to"))

    return most.select("grp", F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), scored))["to"].alias("to"), "cut", (F.col("m") <= SMALL).alias("small"))


def propagate(linked: DataFrame, free: list[int], n_shards: int, max_rounds: int) -> DataFrame:
    """(row, grp, at) after the rounds. The driver holds a count for each pair of shards and no rows."""
    n_linked, homes, idle = linked.count(), None, 0
    room = max(1, (n_linked + sum(free)) // n_shards)
    for n in range(max_rounds):
        movable = linked if homes is None else linked.join(homes, ["grp", "at"], "left_anti")
        most = movable.groupBy("grp").agg(F.array(*[F.count(F.when(F.col("at") == s, 1)) for s in range(n_shards)]).alias("k"))
        best = written(aims(most, free, n_shards, room, n), "targets")
        # a table with its columns renamed, so that the joins below don't meet their own plan
        ask = written(movable.join(best, "grp").filter("at <> to").select(F.col("row").alias("mover"), "grp", "at", "to", "cut", "small"), "asks")
        want = {(r[0], r[1]): r[2] for r in ask.groupBy("at", "to").count().collect()}
        if not want:
            break
        allowed = quotas(want, free, n_shards)
        idle = 0 if any(allowed.values()) else idle + 1
        if idle > 4:  # a cut has been tried and the rest found no way
            break
        # a number for each pair of shards
        quota = F.element_at(F.create_map(*[F.lit(x) for (a, b), v in allowed.items() for x in (a * n_shards + b, v)]), F.col("at") * n_shards + F.col("to"))
        # whole groups go ahead of groups to be cut; small ones go by group, so that their rows are let in together
        by = F.shiftrightunsigned(F.when(F.col("small"), F.xxhash64(F.lit(n), "grp")).otherwise(F.xxhash64("mover")), 1)
        turn = F.when(F.col("cut"), by.bitwiseOR(F.lit(-(1 << 63)))).otherwise(by)
        tried = written(ranked(ask, ["at", "to"], turn, ["mover"], n_linked // n_shards + 1).select("mover", "grp", "to", "cut", (F.col("rank") < quota).alias("ok")), "tried")
        moves = tried.filter("ok").select("mover", "to")
        linked = written(linked.join(moves, F.col("row") == F.col("mover"), "left").select("row", "grp", F.coalesce("to", "at").alias("at")), "linked")
        # only a shard that had no room for the rest of a group to be cut is done with
        full = tried.filter("cut and not ok").select("grp", F.col("to").alias("at")).distinct()
        homes = written(full if homes is None else homes.union(full), "homes")
    return linked


def quotas(want: dict, free: list[int], n_shards: int) -> dict:
    """How many of the rows that ask may move from shard to shard; ``free`` follows what they displace. Short room is shared in proportion."""
    allowed = {k: min(v, want.get(k[::-1], 0)) for k, v in want.items()}
    over = {k: v - allowed[k] for k, v in sorted(want.items())}
    into, out = [0] * n_shards, [0] * n_shards
    asked = [sum(v for (_, b), v in over.items() if b == s) for s in range(n_shards)]
    part = {k: min(v, free[k[1]] * v // max(1, asked[k[1]])) for k, v in over.items()}
    for k, v in part.items():
        into[k[1]] += v
    for (a, b), v in over.items():
        more = min(v - part[a, b], free[b] - into[b])
        into[b] += more
        allowed[a, b] += part[a, b] + more
        out[a] += part[a, b] + more
    for s in range(n_shards):
        free[s] += out[s] - into[s]
    return allowed


def make_room(rows: DataFrame, n_shards: int, n: int) -> DataFrame:
    """Linked rows take their settled shard; as many unlinked rows leave each shard as it gained."""
    gained = [0] * n_shards
    for a, b, k in rows.filter("settled is not null and settled <> shard").groupBy("shard", "settled").count().collect():
        gained[a] -= k
        gained[b] += k
    # an unlinked row of place p in its shard moves if p < what the shard gained; movers fill the shards that lost, in order
    spans, at = [], 0
    for s in range(n_shards):
        if gained[s] > 0:
            spans.append((s, gained[s], at))
            at += gained[s]
    lost, at = [], 0
    for s in range(n_shards):
        if gained[s] < 0:
            lost.append((s, at, at - gained[s]))
            at -= gained[s]
    unlinked = ranked(rows.filter("settled is null"), ["shard"], F.xxhash64("row"), ["row"], n // n_shards + 1, rank="place")
    order = to = F.lit(None)
    for s, k, begin in spans:
        order = F.when((F.col("shard") == s) & (F.col("place") < k), F.col("place") + begin).otherwise(order)
    moved = unlinked.withColumn("order", order.cast("bigint"))
    for s, begin, end in lost:
        to = F.when((F.col("order") >= begin) & (F.col("order") < end), F.lit(s)).otherwise(to)
    keep = ["row", "id", "size", "crc", "grp"]
    return moved.select(*keep, F.coalesce(to.cast("int"), F.col("shard")).alias("shard")).union(rows.filter("settled is not null").select(*keep, F.col("settled").alias("shard")))
