"""Merkle manifest of a dataset, with a proof for every row, by butterfly exchange.

Rows are leaves of one tree per group, in the order of their ids; every ``FANOUT`` consecutive nodes
have one parent, and the groups' roots are the leaves of a tree over all. A partition is an aligned
run of ``LEAF_RUN`` leaves. It makes the root of its own run; then partitions swap roots: in round r
each partition meets those whose number differs in digit r (base ``FANOUT``) alone, and hashes what
it gets to the ancestor above them. So all partitions below an ancestor compute it, each by itself,
and after the last round each of them holds the root and every sibling on its way up: no pass leads
back down, and no task sees more than its own run and ``FANOUT`` roots a round.

The last subtrees of a group have fewer partitions than the others. Partitions without leaves fill
them up, fewer than there are others, so that everyone finds who to meet; they hold no root until
they are told one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, lower_az, written

FANOUT, DIGIT = 8, 3
#: Levels, and leaves, of a partition's own tree.
HEIGHT = 4
#: Rows of a table that is broadcast: numbers of ranges, and subroots, a few hundred bytes each.
BROADCAST = 50_000


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values: list[Column]) -> Column:
    """SHA-256 of a row: each value is ``-`` if null, else its bytes' number, a colon, and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def placed(leaves: DataFrame) -> DataFrame:
    """Adds at (place within grp from 0, by id and leaf; nulls first) and n (leaves of grp) to leaves (grp, id, leaf, ...).

    Rows are sorted in ranges and written; a row's place is its row in its file and what the files
    before hold of its group. Rows that are equal in all are told apart by where they were read.
    """
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("turn")]
    rows = leaves.withColumn("turn", F.monotonically_increasing_id())
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn"), "leaves")
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # a row for each file and group in it: about as many as files and groups together
    parts = rows.groupBy("grp", "file").agg(F.count(F.lit(1)).alias("here"), F.min("row").alias("first"))
    before = Window.partitionBy("grp").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("grp").alias("grp_"), F.col("file").alias("file_"), (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("begin"), F.sum("here").over(Window.partitionBy("grp")).alias("n"))
    parts = if_small(written(parts, "ranges"), BROADCAST)
    return rows.join(parts, F.col("grp").eqNullSafe(F.col("grp_")) & (F.col("file") == F.col("file_"))).select(*leaves.columns, (F.col("row") + F.col("begin")).alias("at"), "n")


def climbed(leaves: list[str], n: int, height: int) -> list[list[str]]:
    """Nodes by level above the leaves of one partition: up to its root, or as far as a tree of ``n`` leaves goes."""
    rows = [leaves]
    while len(rows) <= height and (n > FANOUT**height or len(rows[-1]) > 1):
        below = rows[-1]
        rows.append([sha("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return rows


def in_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table["at"]))


def partition_roots(leaves: DataFrame, height: int) -> DataFrame:
    """(grp, part, parts, root): each partition's own root, and how many its group has."""

    def root(table: pa.Table) -> pa.Table:
        table = in_order(table)
        top = climbed(table["leaf"].to_pylist(), table["n"][0].as_py(), height)[-1]
        return table.slice(0, 1).select(["grp", "part", "parts"]).append_column("root", pa.array(top))

    kind = leaves.schema["grp"].dataType.simpleString()
    return leaves.select("grp", "part", "parts", "at", "n", "leaf").groupBy("grp", "part").applyInArrow(root, f"grp {kind}, part bigint, parts bigint, root string")


def exchanged(roots: DataFrame) -> DataFrame:
    """(grp, part, root, up) of partition roots (grp, part, parts, root): the root of the group, and by level on the way to it the siblings (at: how many stand before the own node; others: hashes)."""
    roots = written(roots, "roots")
    deep = lambda n: F.ceil(F.length(F.bin(n - 1)) / DIGIT).cast("int")
    rounds = F.when(F.col("parts") > 1, deep(F.col("parts"))).otherwise(0)
    top = F.pow(F.lit(FANOUT), F.greatest(F.col("rounds") - 1, F.lit(0))).cast("bigint")
    none = F.expr("cast(array() as array<struct<at: int, others: array<string>>>)")
    rows = roots.withColumn("rounds", rounds).withColumn("room", F.ceil(F.col("parts") / top).cast("bigint") * top)
    # every partition stands for one without leaves as well, as long as there is room
    twins = F.array(F.struct("part", "root"), F.struct((F.col("part") + F.col("parts")).alias("part"), F.lit(None).cast("string").alias("root")))
    rows = rows.select("grp", "parts", "rounds", "room", F.inline(F.filter(twins, lambda t: t["part"] < F.col("room"))), none.alias("up"))
    for r in range(rows.agg(F.max("rounds")).first()[0] or 0):
        scale = FANOUT**r
        digit = F.pmod(F.floor(F.col("part") / scale), F.lit(FANOUT)).cast("bigint")
        live = F.col("rounds") > r
        peers = F.filter(F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda j: F.col("part") + (j - digit) * scale), lambda to: to < F.col("room"))  # noqa: B023
        sent = rows.select("grp", "parts", "rounds", "room", F.col("part").alias("of"), digit.alias("digit"), "root", "up", F.explode(F.when(live, peers).otherwise(F.array("part"))).alias("part"))
        own = F.col("of") == F.col("part")
        met = sent.groupBy("grp", "part", "parts", "rounds", "room").agg(
            F.sort_array(F.collect_list(F.when(F.col("root").isNotNull(), F.struct("digit", "root")))).alias("run"), F.max(F.when(own, F.col("digit"))).alias("digit"), F.max(F.when(own, F.col("up"))).alias("up"))
        before = F.size(F.filter("run", lambda x: x["digit"] < F.col("digit")))
        others = F.transform(F.filter("run", lambda x: x["digit"] != F.col("digit")), lambda x: x["root"])
        above = F.when(F.size("run") > 0, F.sha2(F.array_join(F.transform("run", lambda x: x["root"]), ""), 256))
        rows = met.select("grp", "part", "parts", "rounds", "room", F.when(live, above).otherwise(F.get("run", F.lit(0))["root"]).alias("root"), F.when(live, F.concat("up", F.array(F.struct(before.alias("at"), others.alias("others"))))).otherwise(F.col("up")).alias("up"))
    return written(rows.filter(F.col("part") < F.col("parts")).select("grp", "part", "root", "up"), "proofs")


def folded(node: str, way: list[dict]) -> str:
    """The root that a node and the siblings on its way give."""
    for level in way:
        node = sha("".join([*level["others"][: level["at"]], node, *level["others"][level["at"] :]]))
    return node


def ways(rows: list[list[str]], i: int) -> list[dict]:
    """The siblings of leaf ``i`` by level, up to a partition's root."""
    out = []
    for level in rows[:-1]:
        a = i // FANOUT * FANOUT
        out.append({"at": i - a, "others": level[a:i] + level[i + 1 : a + FANOUT]})
        i //= FANOUT
    return out


def grown(leaves: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """(leaves with at, n, part and parts; grp, part, root, up) of leaves (grp, id, leaf, ...)."""
    run = FANOUT**height
    rows = placed(leaves).withColumns({"part": F.floor(F.col("at") / run).cast("bigint"), "parts": F.ceil(F.col("n") / run).cast("bigint")})
    return rows, exchanged(partition_roots(rows, height))


def manifest(docs: DataFrame, columns: list[str], tampered: dict[str, Column] | None = None, where: Column | None = None, id_col: str = "doc_id", group_col: str = "lang", height: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row: its hash over ``columns``, the root of its group and of all, the hash of the siblings on its way, and what they and its leaf, as it is now, fold to.

    ``tampered`` has columns as they are now, for rows of which ``where`` holds. Groups stand in the
    order of their names' bytes, null first; leaves by id, null first, and rows of one id by their
    hash. Equal rows are leaves each; a single leaf is its own root; without siblings the proof is the
    hash of nothing. No rows give no rows. Other columns do not matter.
    """
    leaf = leaf_of([F.col(c) for c in columns])
    now = leaf_of([(tampered or {}).get(c, F.col(c)) for c in columns])
    own = docs.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), leaf.alias("leaf"), F.when(where if where is not None else F.lit(False), now).alias("now"))
    rows, proofs = grown(own, height)
    groups = proofs.filter("part = 0").select(F.lit(0).alias("grp"), F.col("grp").alias("id"), F.col("root").alias("leaf"))
    tops, over = grown(groups, height)
    kind = groups.schema["id"].dataType.simpleString()
    level = "array<struct<at: int, others: array<string>>>"

    def group_ways(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        table, top = in_order(table), above.to_pylist()[0]
        nodes = climbed(table["leaf"].to_pylist(), table["n"][0].as_py(), height)
        way = [ways(nodes, i) + top["up"] for i in range(table.num_rows)]
        schema = pa.schema([("grp_", table.schema.field("id").type), ("subroot", pa.string()), ("all", pa.string()), ("over", above.schema.field("up").type)])
        return pa.table([table["id"], table["leaf"], pa.array([top["root"]] * len(way)), pa.array(way, above.schema.field("up").type)], schema=schema)

    tops = tops.groupBy("grp", "part").cogroup(over.groupBy("grp", "part")).applyInArrow(group_ways, f"grp_ {kind}, subroot string, all string, over {level}")
    tops = if_small(written(tops, "subroots"), BROADCAST // 10)
    known = proofs.join(tops, F.col("grp").eqNullSafe(F.col("grp_"))).select("grp", "part", "subroot", F.col("all").alias("root"), F.concat("up", "over").alias("up"))
    id_kind = own.schema["id"].dataType.simpleString()

    def proven(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        table, top = in_order(table), above.to_pylist()[0]
        leaves, seen = table["leaf"].to_pylist(), table["now"].to_pylist()
        nodes = climbed(leaves, table["n"][0].as_py(), height)
        high = "".join(x for level in top["up"] for x in level["others"])
        proof, fold = [], []
        for i, leaf in enumerate(leaves):
            way = ways(nodes, i)
            proof.append(sha("".join(x for level in way for x in level["others"]) + high))
            fold.append(folded(seen[i] or leaf, way + top["up"]))
        same = lambda x: pa.array([x] * len(leaves), pa.string())
        names = [id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return pa.table([table["id"], table["leaf"], same(top["subroot"]), same(top["root"]), pa.array(proof, pa.string()), pa.array(fold, pa.string()), pa.array([x == top["root"] for x in fold], pa.bool_())], names=names)

    pairs = rows.select("grp", "part", "at", "n", "id", "leaf", "now").groupBy("grp", "part").cogroup(known.groupBy("grp", "part"))
    return pairs.applyInArrow(proven, f"`{id_col}` {id_kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def documents_manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``manifest`` of documents, some of which are held with their text in lower case: those with a CRC-32 of their id that three divides."""
    where = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    return manifest(docs, COLUMNS, {"text": lower_az(F.col("text"))}, where, height=height)


def oracle(source: str = "documents") -> str:
    """The same in DuckDB SQL, a level of all trees at a time."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    head = " || ".join(part(c) for c in COLUMNS[:-1])
    digits = "CAST(doc_id AS VARCHAR)"
    byte = f"CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr({digits}, CAST(i // 8 AS INT) + 1, 1))) ELSE c END"
    crc = f"xor(list_reduce(range(0, 8 * length({digits})), lambda c, i: xor(({byte}) >> 1, 3988292384 * (({byte}) & 1)), CAST(4294967295 AS BIGINT)), 4294967295)"
    tree = lambda name, base: f"{name}(g, lvl, i, h) AS ({base} UNION ALL SELECT g, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {name}) WHERE m > 1 GROUP BY g, lvl, i // 8)"
    # sides of each node: the siblings before and behind it
    sides = lambda tree: f"""SELECT a.g, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM {tree} a JOIN {tree} b ON a.g = b.g AND a.lvl = b.lvl AND a.i // 8 = b.i // 8
        JOIN (SELECT g AS tg, max(lvl) AS height FROM {tree} GROUP BY g) ON tg = a.g AND a.lvl < height GROUP BY a.g, a.lvl, a.i"""  # noqa: E731
    return f"""WITH RECURSIVE leaves AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, sha256({head} || {part('text')}) AS leaf, coalesce(({crc}) % 3 = 0, false) AS hit,
        sha256({head} || {part(f"translate(text, '{upper}', '{lower}')")}) AS low FROM {source}),
    {tree('sub', 'SELECT g, CAST(0 AS BIGINT), i, leaf FROM leaves')},
    subroots AS (SELECT g, arg_max(h, lvl) AS subroot, max(lvl) AS height FROM sub GROUP BY g),
    {tree('top', 'SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), g, subroot FROM subroots')},
    root AS (SELECT arg_max(h, lvl) AS root FROM top),
    steps AS (SELECT l.doc_id, l.g AS lg, l.i AS li, s.lvl AS k, s.l, s.r FROM leaves l JOIN ({sides('sub')}) s ON s.g = l.g AND s.i = l.i >> CAST(3 * s.lvl AS INT)
        UNION ALL SELECT l.doc_id, l.g, l.i, u.height + s.lvl, s.l, s.r FROM leaves l JOIN subroots u ON u.g = l.g JOIN ({sides('top')}) s ON s.i = l.g >> CAST(3 * s.lvl AS INT)),
    fold(g, i, k, h) AS (SELECT g, i, CAST(0 AS BIGINT), CASE WHEN hit THEN low ELSE leaf END FROM leaves UNION ALL SELECT f.g, f.i, f.k + 1, sha256(s.l || f.h || s.r) FROM fold f JOIN steps s ON s.lg = f.g AND s.li = f.i AND s.k = f.k),
    ends AS (SELECT g, i, arg_max(h, k) AS folded_root FROM fold GROUP BY g, i),
    proofs AS (SELECT lg, li, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM steps GROUP BY lg, li)
    SELECT l.doc_id, l.leaf, u.subroot, root.root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
    FROM leaves l JOIN subroots u ON u.g = l.g JOIN ends e ON e.g = l.g AND e.i = l.i LEFT JOIN proofs p ON p.lg = l.g AND p.li = l.i, root"""
