"""DuckDB SQL that states the mapper's results independently of its operators: window minima, joins, and a recursive fold for the vote."""

from __future__ import annotations

from .params import IndexParams, MapParams

LOWER = "abcdefghijklmnopqrstuvwxyz"
U32 = 4294967295


def bases(text: str, breaks: str = "") -> str:
    kept = f"regexp_replace(translate(coalesce({text}, ''), '{LOWER.upper()}', '{LOWER}'), '[^a-z{breaks}]', '', 'g')"
    return f"translate({kept}, '{LOWER}{breaks}', '{('ACGT' * 7)[:26]}{'N' * len(breaks)}')"


def sequences(name: str, table: str, id_col: str, prefix: str, breaks: str = "", text: str = "text") -> str:
    """CTE ``name`` (id, name, len, seq)."""
    return f"{name} AS (SELECT id, name, length(seq) AS len, seq FROM (SELECT {id_col} AS id, '{prefix}' || ({id_col}) AS name, {bases(text, breaks)} AS seq FROM {table}))"


def code(part: str, j: int) -> str:
    return f"((ascii(substr({part}, {j}, 1)) & 15) >> 1)"


def hash64(x: str, k: int) -> list[str]:
    """Successive expressions for columns x1 to x7 of the mix, each over the one before."""
    m = (1 << 2 * k) - 1
    left = lambda n: f"((x & {m >> n}) * {1 << n})"
    return [f"(xor(x, {m}) + {left(21)}) & {m}", "xor(x, x >> 24)", f"(x * 265) & {m}", "xor(x, x >> 14)", f"(x * 21) & {m}", "xor(x, x >> 28)", f"(x + {left(31)}) & {m}"]


def hashed(rel: str, x: str, k: int, rest: str) -> str:
    """Query of ``rest`` and h, the mix of column x."""
    out = f"SELECT {rest}, {x} AS x FROM {rel}"
    for e in hash64("x", k):
        out = f"SELECT * REPLACE ({e} AS x) FROM ({out})"
    return f"SELECT * RENAME (x AS h) FROM ({out})"


def kmers(name: str, seqs: str, k: int) -> list[str]:
    """CTE ``name``_k (id, i, clear, z, pal, h)."""
    f = " + ".join(f"CAST({code('part', j)} AS BIGINT) * {4 ** (k - j)}" for j in range(1, k + 1))
    r = " + ".join(f"CAST(xor({code('part', j)}, 2) AS BIGINT) * {4 ** (j - 1)}" for j in range(1, k + 1))
    parts = f"SELECT id, i, substr(seq, i + 1, {k}) AS part FROM (SELECT id, seq, unnest(range(0, len - {k - 1})) AS i FROM {seqs} WHERE len >= {k})"
    both = f"SELECT id, i, NOT regexp_matches(part, '[^ACGT]') AS clear, {f} AS f, {r} AS r FROM ({parts})"
    return [f"{name}_k AS ({hashed(f'({both})', 'least(f, r)', k, 'id, i, clear, CAST(f > r AS INT) AS z, f = r AS pal')})"]


def seeds(name: str, seqs: str, p: IndexParams) -> list[str]:
    """CTE ``name`` (id, hash, loc, str)."""
    tie = "i" if p.ties == "left" else "-i"
    over = f"OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {p.w - 1} FOLLOWING)"
    pick = f"SELECT id, count(*) {over} AS n, min(CAST(clear AS INT)) {over} AS clear, min(CASE WHEN clear AND NOT pal THEN {{'h': h, 't': {tie}, 'i': i, 'z': z}} END) {over} AS p FROM {name}_k"
    return [*kmers(name, seqs, p.k), f"{name} AS (SELECT DISTINCT id, p.h AS hash, p.i + {p.k - 1} AS loc, p.z AS str FROM ({pick}) WHERE n = {p.w} AND clear = 1 AND p IS NOT NULL)"]


def index(name: str, source: str, max_occ: int) -> str:
    return f"{name} AS (SELECT * EXCLUDE (occ) FROM (SELECT *, count(*) OVER (PARTITION BY hash) AS occ FROM {source}) WHERE occ <= {max_occ})"


def anchors(p: IndexParams) -> list[str]:
    """CTEs from targets and reads to anchors (read_id, len, chrom_id, diag, q_loc, str)."""
    joined = "SELECT s.id AS read_id, r.len, t.id AS chrom_id, s.loc AS q_loc, t.loc, xor(s.str, t.str) AS str FROM read_seeds s JOIN keys t ON s.hash = t.hash JOIN reads r ON r.id = s.id"
    return [*seeds("target_seeds", "targets", p), index("keys", "target_seeds", p.max_occ), *seeds("read_seeds", "reads", p),
            f"anchors AS (SELECT read_id, len, chrom_id, CASE WHEN str = 1 THEN loc + q_loc ELSE loc - q_loc + 2097152 END AS diag, q_loc, str FROM ({joined}))"]


def groups(p: MapParams) -> list[str]:
    """CTE groups (read_id, len, str, grp, vt_score, q_start, q_end, t_start, t_end, closed): the fold, one anchor at a time; closed orders groups as they are closed."""
    d = p.distance
    ordered = "SELECT *, row_number() OVER (PARTITION BY read_id, str ORDER BY T, q) AS n, row_number() OVER (PARTITION BY read_id ORDER BY T, q, str) AS o FROM (SELECT read_id, len, str, q_loc AS q, chrom_id * 1073741824 + diag AS T, chrom_id * 1073741824 + (CASE WHEN str = 1 THEN diag - q_loc ELSE diag + q_loc - 2097152 END) AS L FROM anchors)"
    if p.compat_origin:
        start = "SELECT DISTINCT read_id, len, s.str, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS grp, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS qs, CAST(0 AS BIGINT) AS qe, CAST(0 AS BIGINT) AS ts, CAST(0 AS BIGINT) AS te, CAST(0 AS BIGINT) AS ref, CAST(0 AS BIGINT) AS o FROM ord, (VALUES (0), (1)) AS s(str)"
    else:
        start = "SELECT read_id, len, str, CAST(1 AS BIGINT), CAST(1 AS BIGINT) AS grp, CAST(1 AS BIGINT) AS c, CAST(q AS BIGINT) AS qs, CAST(q AS BIGINT) AS qe, CAST(L AS BIGINT) AS ts, CAST(L AS BIGINT) AS te, CAST(T AS BIGINT) AS ref, CAST(o AS BIGINT) AS o FROM ord WHERE n = 1"
    joins = f"a.T <= f.ref + {d}"
    step = f"""SELECT f.read_id, f.len, f.str, f.n + 1, f.grp + CASE WHEN {joins} THEN 0 ELSE 1 END, CASE WHEN {joins} THEN f.c + 1 ELSE 1 END,
        CASE WHEN {joins} THEN least(f.qs, a.q) ELSE a.q END, CASE WHEN {joins} THEN greatest(f.qe, a.q) ELSE a.q END, CASE WHEN {joins} THEN least(f.ts, a.L) ELSE a.L END, CASE WHEN {joins} THEN greatest(f.te, a.L) ELSE a.L END,
        CASE WHEN {joins} AND a.q >= f.qs THEN f.ref ELSE a.T END, CASE WHEN {joins} THEN f.o ELSE a.o END FROM fold f JOIN ord a ON a.read_id = f.read_id AND a.str = f.str AND a.n = f.n + 1"""
    last = "SELECT *, row_number() OVER (PARTITION BY read_id, str, grp ORDER BY n DESC) AS back FROM fold"
    return [f"ord AS ({ordered})", f"fold(read_id, len, str, n, grp, c, qs, qe, ts, te, ref, o) AS ({start} UNION ALL {step})",
            f"groups AS (SELECT read_id, len, str, grp, c AS vt_score, qs AS q_start, qe AS q_end, ts AS t_start, te AS t_end, coalesce(lead(o) OVER (PARTITION BY read_id, str ORDER BY grp), 4611686018427387904 + str) AS closed FROM ({last}) WHERE back = 1)"]


def records(p: MapParams) -> list[str]:
    """CTEs covered, top and records."""
    share = lambda f, x: f"CAST(floor(CAST({f} AS FLOAT) * CAST({x} AS FLOAT)) AS BIGINT)"
    low = share(p.fraction, "best")
    top = "SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY vt_score DESC, abs((q_end - q_start) - (t_end - t_start)), closed) - 1 AS rank FROM covered"
    best = "SELECT *, max(CASE WHEN rank = 0 THEN vt_score END) OVER (PARTITION BY read_id) AS best, max(CASE WHEN rank = 1 THEN vt_score END) OVER (PARTITION BY read_id) AS second FROM top"
    tie = "(second IS NULL OR best <> second)" if p.reject_ties else "true"
    return [f"covered AS (SELECT * FROM groups WHERE q_end - q_start >= {share(p.coverage, 'len')})", f"top AS (SELECT * FROM ({top}) WHERE rank < {p.top})",
            f"records AS (SELECT * REPLACE (CASE WHEN second >= {low} THEN second END AS second) FROM ({best}) WHERE {tie} AND (rank = 0 OR vt_score >= {low}))"]


def paf(k: int) -> list[str]:
    quality = "CASE WHEN rank = 0 THEN CAST(least(60, floor((1 - coalesce(second, 0) / CAST(best AS DOUBLE)) * ln(best) * least(best, 40))) AS BIGINT) ELSE 0 END"
    start = f"(((t_start & 1073741823) - {k - 1}) & {U32})"
    return [f"""paf AS (SELECT read_id, CAST(rank AS BIGINT) AS rank, r.name AS qname, CAST(r.len AS BIGINT) AS qlen, (q_start - {k - 1}) & {U32} AS qstart, q_end AS qend, CASE WHEN str = 1 THEN '-' ELSE '+' END AS strand, t.name AS tname, CAST(t.len AS BIGINT) AS tlen,
        {start} AS tstart, t_end & 1073741823 AS tend, vt_score * {k} AS nmatch, ((t_end & 1073741823) - {start}) & {U32} AS blen, {quality} AS mapq, 'vt:i:' || vt_score AS vt FROM records JOIN reads r ON r.id = read_id JOIN targets t ON t.id = t_start >> 30)"""]


def mapping(reads: str, p: IndexParams, m: MapParams) -> list[str]:
    """All CTEs from ``documents`` as targets and a CTE for reads to paf."""
    return [sequences("targets", "documents", "doc_id", "doc"), reads, *anchors(p), *groups(m), *records(m), *paf(p.k)]


def query(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select
