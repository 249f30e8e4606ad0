"""Queries of the mapping engine over the driver tables, with their DuckDB SQL.

Texts become bases by a fixed rule (``functions.sequence.bases``); ``documents`` are the targets,
``benchmark`` items, ``conversations`` or ``documents`` the reads.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as o
from .functions import sequence as fn
from .functions.registry import register
from .operators import evaluate
from .operators.anchors import anchors
from .operators.index import SeedIndex, bucket_map, build_index, index_of, index_stats, load_index, save_index, seed_table, with_postings
from .operators.minimizers import extract, kmer_sums, minimizers, minimizers_sql
from .operators.vote import covered, decided, top_records
from .params import IndexParams, MapParams, preset
from .plans.mapping import groups_of, map_reads, paf
from .plans.profile import profiled
from .shared import shared_path, spread, written
from .sources.batches import batches
from .sources.fasta import from_text, hex_names, read_fasta, read_fastq, to_fasta, to_fastq
from .sources.fastq_source import load_fastq, plan_batches, stream_fastq
from .sources.paf import read_paf, write_paf
from .sources.places import numbered
from .sources.reads import read_reads
from .streaming.mapping import map_stream, read_stream_text, stream_text

DEFAULT = IndexParams()
RARE = IndexParams(max_occ=10)
LOOSE = MapParams(reject_ties=False)
READS = o.sequences("reads", "benchmark", "item_id", "item")
SELF = o.sequences("reads", "documents", "doc_id", "doc")
TURN = "conv_id * 1000000 + turn"
CAPACITY = 10_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spread(load(spark, sf_dir, name).select(*cols))


def targets(spark: SparkSession, sf_dir: str, breaks: str = "") -> DataFrame:
    return from_text(texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", "chrom_id", "doc", breaks)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_text(texts(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", "text", "read_id", "item")


def documents_as_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_text(texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", "read_id", "doc")


def turns(spark: SparkSession, sf_dir: str, id_name: str = "read_id") -> DataFrame:
    rows = texts(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("id", F.expr(TURN))
    return from_text(rows, "id", "text", id_name, "turn")


def big(df: DataFrame) -> DataFrame:
    """Whole numbers as 64-bit ones, as the SQL gives them."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "tinyint") else F.col(c) for c, t in df.dtypes])


def q_seq_len(spark, d):
    return big(targets(spark, d).select("chrom_id", "name", "len"))


def q_encode(spark, d):
    rows = targets(spark, d, ".").select("chrom_id", F.explode(F.split("seq", "")).alias("base")).filter("base <> ''")
    return big(rows.groupBy("chrom_id", fn.encode(F.col("base")).alias("code")).agg(F.count(F.lit(1)).alias("n")))


def q_kmers(spark, d):
    return kmer_sums(targets(spark, d).select("chrom_id", "seq"), DEFAULT, "chrom_id")


def q_hash64(spark, d):
    key = F.col("o_orderkey").cast("bigint")
    return load(spark, d, "orders").select(key.alias("o_orderkey"), fn.hash64(key, 15).alias("h15"), fn.hash64(key, 19).alias("h19"), fn.hash64(key, 21).alias("h21"))


def q_bucket_split(spark, d):
    h = fn.hash64(F.col("l_orderkey").cast("bigint"), 21)
    rows = load(spark, d, "lineitem").select(h.alias("hash")).distinct()
    return rows.select("hash", fn.bucket_id(F.col("hash"), 30).alias("bucket_id"), fn.seed_id(F.col("hash"), 30).alias("seed_id"))


def seeds_of(p: IndexParams, breaks: str = "", of=minimizers):
    return lambda spark, d: big(of(targets(spark, d, breaks).select("chrom_id", "seq"), p, "chrom_id"))


def q_index_keys(spark, d):
    return big(build_index(targets(spark, d), RARE).keys)


def q_index_map(spark, d):
    return bucket_map(build_index(targets(spark, d), RARE))


def q_index_stats(spark, d):
    return big(index_stats(targets(spark, d), RARE))


def q_key_pack(spark, d):
    """A word has room for 1024 targets, so they are dealt into pages of as many."""
    page, chrom = F.floor(F.col("chrom_id") / 1024), F.pmod("chrom_id", F.lit(1024))
    rows = build_index(targets(spark, d), RARE).keys.select("chrom_id", "loc", "str", "hash", page.alias("page"), fn.pack_key(F.col("loc"), chrom, F.col("str"), fn.seed_id(F.col("hash"), 30)).alias("word"))
    back = fn.unpack_key(F.col("word"))
    same = (back["loc"] == F.col("loc")) & (F.col("page") * 1024 + back["chrom_id"] == F.col("chrom_id")) & (back["str"] == F.col("str"))
    return big(rows.select("chrom_id", "page", "loc", "hash", "word", same.alias("same")))


def q_anchor_pack(spark, d):
    page, chrom = F.floor(F.col("chrom_id") / 1024), F.pmod("chrom_id", F.lit(1024))
    rows = anchors_of(items, DEFAULT)(spark, d).select("read_id", page.alias("page"), fn.pack_anchor(chrom, F.col("diag"), F.col("q_loc"), F.col("str")).alias("word"))
    back = fn.unpack_anchor(F.col("word"))
    return big(rows.select("read_id", "page", "word", back["target"].alias("target"), back["q_loc"].alias("q_loc"), back["str"].alias("str")))


def anchors_of(reads, p: IndexParams):
    def run(spark, d):
        seeds = minimizers(reads(spark, d).select("read_id", "len", "seq"), p, "read_id", ("len",))
        return big(anchors(seeds, build_index(targets(spark, d), p).keys).drop("len"))

    return run


def looked_up(of: DataFrame, p: IndexParams) -> SeedIndex:
    return with_postings(build_index(of, p))


def self_groups(spark, d, m: MapParams, only_covered: bool = False):
    return groups_of(documents_as_reads(spark, d), looked_up(targets(spark, d), DEFAULT), m, only_covered)


GROUP = ["read_id", "str", "grp", "vt_score", "q_start", "q_end", "t_start", "t_end"]
RECORD = ["read_id", "rank", "vt_score", "q_start", "q_end", "t_start", "t_end", "str"]


def q_vote_groups(spark, d):
    return big(self_groups(spark, d, LOOSE).select(*GROUP))


def q_vote_groups_no_origin(spark, d):
    return big(self_groups(spark, d, MapParams(compat_origin=False)).select(*GROUP))


def q_coverage(spark, d):
    return big(covered(self_groups(spark, d, LOOSE, True), LOOSE).select(*GROUP))


def q_topk(spark, d):
    return big(top_records(covered(self_groups(spark, d, LOOSE, True), LOOSE), LOOSE).select(*RECORD))


def q_fraction(spark, d):
    return big(decided(top_records(covered(self_groups(spark, d, LOOSE, True), LOOSE), LOOSE), LOOSE).select(*RECORD))


def q_tie_reject(spark, d):
    m = MapParams()
    return big(decided(top_records(covered(self_groups(spark, d, m, True), m), m), m).select(*RECORD))


def mapped(reads, p: IndexParams, m: MapParams, made=build_index):
    def run(spark, d):
        index, own = made(targets(spark, d), p), reads(spark, d)
        return big(paf(map_reads(own, index, m), own, index))

    return run


#: The other points of each preset's sweep.
SWEEPS = {
    "ont": ({"max_occ": 50, "distance": 750}, {"max_occ": 100, "distance": 700}), "hifi": ({"max_occ": 2, "distance": 4000}, {"max_occ": 5, "distance": 4000}),
    "illumina": ({"max_occ": 150}, {"max_occ": 450}),
}


def sweep(name: str):
    def run(spark, d):
        table, own = seed_table(targets(spark, d), preset(name)[0]), items(spark, d)

        def point(at: dict) -> DataFrame:
            p, m = preset(name, **at)
            index = index_of(table, p)
            return big(paf(map_reads(own, index, m), own, index)).withColumn("max_occ", F.lit(at["max_occ"]).cast("bigint"))

        return point(SWEEPS[name][0]).unionByName(point(SWEEPS[name][1]))

    return run


def q_near_dup_docs(spark, d):
    """Distinct documents mapped onto distinct documents: equal texts are one, named by their smallest id, so that copies do not use up a seed's occurrences. ``copies``: the documents that a read stands for."""
    docs = documents_as_reads(spark, d).filter("len > 0")
    # no sequence goes through the grouping: the smallest id does, and brings its sequence afterwards
    kinds = docs.groupBy(F.md5("seq").alias("key")).agg(F.min("read_id").alias("read_id"), F.count(F.lit(1)).alias("copies"))
    kinds = written(kinds.select("read_id", "copies"), "kinds")
    own = written(docs.join(kinds.select("read_id"), "read_id"), "distinct")
    index = looked_up(own.withColumnRenamed("read_id", "chrom_id"), DEFAULT)
    return big(paf(map_reads(own, index, LOOSE), own, index).join(kinds.select("read_id", "copies"), "read_id"))


def q_doc_copies(spark, d):
    """The membership beside ``q_near_dup_docs``: each document with bases and the one that stands for it."""
    rows = documents_as_reads(spark, d).filter("len > 0").select("read_id", F.md5("seq").alias("key"))
    least = rows.groupBy(F.col("key").alias("of")).agg(F.min("read_id").alias("stands"))
    return rows.join(least, F.col("key") == F.col("of")).select("read_id", "stands")


def q_device_seeds(spark, d):
    """Seeds of texts whose letters are taken as they are, in the dialect that knows only N as ambiguous."""
    raw = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    seqs = texts(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("chrom_id"), raw.alias("seq"))
    return big(minimizers(seqs, IndexParams(dialect="device"), "chrom_id"))


def q_minimizers_partial(spark, d):
    """The first hundred seeds of each target, and where to go on."""
    return big(extract(targets(spark, d).select("chrom_id", "seq"), DEFAULT, "chrom_id", 100))


def q_minimizers_chained(spark, d):
    """All seeds of the benchmark items, in calls of ten that go on where the one before stopped."""
    seqs, parts = items(spark, d).select("read_id", "seq"), []
    while True:
        got = written(extract(seqs, DEFAULT, "read_id", 10), "part")
        parts.append(got.drop("resume"))
        left = got.filter("resume is not null").select(F.col("read_id").alias("of"), F.col("resume").alias("begin"))
        if left.isEmpty():
            return big(functools.reduce(DataFrame.unionByName, parts))
        seqs = items(spark, d).select("read_id", "seq").join(left, F.col("read_id") == F.col("of")).select("read_id", "seq", "begin")


def q_index_roundtrip(spark, d):
    """The keys of an index that was saved and loaded, with their place in the saved order."""
    path = shared_path(spark, "index")
    save_index(build_index(targets(spark, d), RARE), path, layout="order")
    index = load_index(spark, path)
    keys = index.keys.select("hash", "chrom_id", "loc", "str", F.col("_metadata.file_path").alias("file"), F.lit(0).alias("block"), F.col("_metadata.row_index").alias("at"))
    return big(numbered(keys, "n").select("n", "hash", "chrom_id", "loc", "str"))


def q_paf_saved(spark, d):
    """Benchmark items mapped with an index that was saved in buckets and loaded."""
    path, own = shared_path(spark, "index"), items(spark, d)
    save_index(build_index(targets(spark, d), DEFAULT), path, 16)
    index = load_index(spark, path)
    return big(paf(map_reads(own, index, LOOSE), own, index))


def q_paf_text(spark, d):
    """PAF lines of the benchmark's items, written as text in read order and read again."""
    path, index, own = shared_path(spark, "paf"), build_index(targets(spark, d), DEFAULT), items(spark, d)
    write_paf(paf(map_reads(own, index, LOOSE), own, index), path)
    return big(read_paf(spark, path))


def q_stage_profile(spark, d):
    """Rows that each stage of a mapping makes, observed in one run."""
    _, rows, _ = profiled(items(spark, d), build_index(targets(spark, d), DEFAULT), LOOSE)
    return spark.createDataFrame(list(rows.items()), "stage string, n bigint")


def q_time_per_base(spark, d):
    """Events as timed batches: each event is dealt to a document by the remainder of its number, so every event counts."""
    batch = targets(spark, d).select("chrom_id", "len")
    n = batch.count()
    log = load(spark, d, "events").withColumn("of", F.pmod("event_id", F.lit(n)))
    rows = evaluate.time_per_base(log.join(batch, F.col("of") == F.col("chrom_id")), F.col("value"), F.col("len"))
    return rows.groupBy(F.col("event_type").alias("label")).agg(F.count("ms_per_base").alias("n"), F.round(F.avg("ms_per_base"), 6).alias("ms_per_base"))


def q_dialogue_hits(spark, d):
    """Turns of conversations mapped onto turns of conversations."""
    index, own = looked_up(turns(spark, d, "chrom_id"), DEFAULT), turns(spark, d)
    return big(paf(map_reads(own, index, LOOSE), own, index))


def q_sql_hash64(spark, d):
    register(spark)
    return load(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), *[F.expr(f"hash64_{k}(cast(o_orderkey as bigint))").alias(f"h{k}") for k in (15, 19, 21)])


def q_minimizers_table(spark, d):
    """The table function, called for each benchmark item."""
    register(spark)
    items(spark, d).createOrReplaceTempView("seedloom_items")
    return big(spark.sql("SELECT read_id, m.hash, m.loc, m.str FROM seedloom_items, LATERAL minimizers(seq, 10, 15) m"))


def q_seeds_table(spark, d):
    """The table function over whole documents, a batch of sequences at a time."""
    register(spark)
    targets(spark, d).select(F.col("chrom_id").alias("id"), "seq").createOrReplaceTempView("seedloom_targets")
    return big(spark.sql("SELECT id AS chrom_id, hash, loc, str FROM seeds(TABLE(seedloom_targets), 10, 15)"))


def q_long_reads(spark, d):
    return big(documents_as_reads(spark, d).filter("len >= 1000").select("read_id", "name", "len"))


def q_seeds_per_read(spark, d):
    """Query positions of each read that meet the index."""
    return anchors_of(documents_as_reads, DEFAULT)(spark, d).groupBy("read_id").agg(F.count_distinct("q_loc").alias("n_seeds"))


def q_speedup(spark, d):
    """Average of each event type against that of views."""
    rows = evaluate.phase_averages(load(spark, d, "events"), "event_type", F.round(F.col("value") * 1_000_000).cast("bigint"))
    base = rows.filter("label = 'view'").select(F.col("avg_ms").alias("base"))
    # the right side is one row
    return rows.crossJoin(base).select("label", F.round(F.col("base") / F.col("avg_ms"), 6).alias("speedup"))


def q_mapq(spark, d):
    rows = mapped(documents_as_reads, DEFAULT, LOOSE, looked_up)(spark, d)
    return rows.filter("rank = 0").groupBy("mapq").agg(F.count(F.lit(1)).alias("n"))


def q_mapq_zero(spark, d):
    return evaluate.mapq_zero(mapped(documents_as_reads, DEFAULT, LOOSE, looked_up)(spark, d)).select("read_id", "qname", "tname", "nmatch")


def q_batches(spark, d):
    rows = load(spark, d, "conversations").select(F.col("conv_id"), F.col("turn").alias("read_id"), F.length("text").alias("len"))
    return big(batches(rows, CAPACITY, F.col("conv_id")))


def q_hash_diff_hist(spark, d):
    keys = minimizers(targets(spark, d).select("chrom_id", "seq"), DEFAULT, "chrom_id")
    return evaluate.histogram(evaluate.successive_differences(keys, "hash", 1024, 30), "d", 1000)


def q_mean_sd(spark, d):
    keys = minimizers(targets(spark, d).select("chrom_id", "seq"), DEFAULT, "chrom_id")
    per = keys.groupBy("chrom_id").agg(F.count(F.lit(1)).alias("n_seeds"))
    return evaluate.mean_sd(per, "n_seeds").select("n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


SIM_LEN, SIM_STEP, PIECE = 400, 400, 400


def q_simulated_reads(spark, d):
    return big(evaluate.simulated(targets(spark, d), SIM_LEN, SIM_STEP))


def q_accuracy_curve(spark, d):
    """Documents cut into pieces and mapped back: every base is in a piece whose origin is known."""
    reads = evaluate.pieces(targets(spark, d).select("chrom_id", "seq"), PIECE)
    index = looked_up(targets(spark, d), DEFAULT)
    primary = map_reads(reads, index, LOOSE).filter("rank = 0").join(reads.select("read_id", "len", "origin", "start"), "read_id")
    wrong = (F.col("chrom_id") != F.col("origin")) | (F.col("t_start") > F.col("start") + F.col("len")) | (F.col("t_end") < F.col("start"))
    return evaluate.accuracy_curve(primary.select(fn.mapq(F.col("best"), F.col("second")).alias("mapq"), wrong.alias("wrong")), reads.count())


def q_profile_avg(spark, d):
    return evaluate.phase_averages(load(spark, d, "events"), "event_type", F.round(F.col("value") * 1_000_000).cast("bigint")).select("label", "n", F.round("avg_ms", 6).alias("avg_ms"))


def q_fastq_to_fasta(spark, d):
    return to_fasta(documents_as_reads(spark, d))


def q_hex_headers(spark, d):
    return hex_names(documents_as_reads(spark, d)).select("read_id", "name")


def q_fasta_scan(spark, d):
    """Targets written as FASTA text, read again, and counted."""
    path = shared_path(spark, "fasta")
    lines = targets(spark, d).orderBy("chrom_id").select(F.concat(F.lit(">"), F.col("name"), F.lit(" x\n"), F.regexp_replace("seq", "(.{70})", "$1\n")).alias("value"))
    lines.write.text(path)
    return big(read_fasta(spark, path, "ordinal").select("ordinal", "name", "len", F.md5("seq").alias("seq_md5")))


def q_fasta_reads(spark, d):
    """Targets written with two records on a line, as reads may have them, and read again."""
    path = shared_path(spark, "fasta")
    half = F.floor(F.col("len") / 2).cast("int")
    lines = targets(spark, d).orderBy("chrom_id").select(F.concat(F.lit(">"), F.col("name"), F.lit(" a>b\n"), F.substr("seq", F.lit(1), half), F.lit(">"), F.col("name"), F.lit("b\n"), F.substr("seq", half + 1)).alias("value"))
    lines.write.text(path)
    return big(read_fasta(spark, path, "ordinal", "reads").select("ordinal", "name", "len", F.md5("seq").alias("seq_md5")))


def q_fastq_scan(spark, d):
    """Documents written as FASTQ, read again, and counted."""
    path = shared_path(spark, "fastq")
    to_fastq(documents_as_reads(spark, d)).orderBy("read_id").select("value").write.text(path)
    return big(read_fastq(spark, path, "ordinal").select("ordinal", "name", "len", F.md5("seq").alias("seq_md5")))


def q_fastq_source(spark, d):
    """Documents written as FASTQ and read by the data source, in ranges of bytes."""
    path = shared_path(spark, "fastq")
    to_fastq(documents_as_reads(spark, d)).orderBy("read_id").select("value").write.text(path)
    rows = load_fastq(spark, path, 1 << 18).select("read_id", "name", "len", F.md5("seq").alias("seq_md5"))
    # a file's records are numbered in the order of their bytes, by ranges of places that are written first
    placed = written(rows.repartitionByRange("read_id").sortWithinPartitions("read_id"), "fastq")
    placed = placed.select("name", "len", "seq_md5", F.col("_metadata.file_path").alias("file"), F.lit(0).alias("block"), F.col("_metadata.row_index").alias("at"))
    return big(numbered(placed, "ordinal").select("ordinal", "name", "len", "seq_md5"))


def q_mixed_scan(spark, d):
    """Documents written as records of both kinds behind a comment, with qualities that look like headers, and read again."""
    path = shared_path(spark, "mixed")
    rows = documents_as_reads(spark, d)
    quality = F.repeat(F.when(F.col("read_id") % 3 == 0, "@").otherwise(">"), F.length("seq"))
    fastq = F.concat(F.lit("@"), F.col("name"), F.lit(" x>y\n"), F.col("seq"), F.lit("\n+@\n"), quality)
    fasta = F.concat(F.lit(">"), F.col("name"), F.lit(" @\n"), F.regexp_replace("seq", "(.{70})", "$1\n"))
    lines = rows.select((F.col("read_id") % 2).alias("kind"), "read_id", F.when(F.col("read_id") % 2 == 0, fastq).otherwise(fasta).alias("value"))
    head = spark.range(1).select(F.lit(-1).alias("kind"), F.lit(0).alias("read_id"), F.lit("; sequences\n# of both kinds").alias("value"))
    lines.unionByName(head).orderBy("kind", "read_id").select("value").write.text(path)
    return big(read_reads(spark, path, "ordinal").select("ordinal", "name", "len", F.md5("seq").alias("seq_md5")))


def q_stream_map(spark, d):
    """Benchmark items arrive as files and are mapped batch by batch."""
    base = shared_path(spark, "stream")
    own = items(spark, d)
    own.repartition(4, "read_id").write.parquet(f"{base}/in")
    save_index(build_index(targets(spark, d), DEFAULT), f"{base}/index", 16)
    index = load_index(spark, f"{base}/index")
    reads = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    map_stream(reads, index, LOOSE, f"{base}/out", f"{base}/state").awaitTermination()
    return big(spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/*").drop("batch"))


def q_stream_text(spark, d):
    """Benchmark items as FASTQ, in micro-batches by capacity of bases, mapped with a saved index into ordered PAF text, which is read again."""
    base = shared_path(spark, "stream")
    to_fastq(items(spark, d)).orderBy("read_id").select("value").write.text(f"{base}/in")
    plan_batches(spark, f"{base}/in", CAPACITY, f"{base}/batches")
    save_index(build_index(targets(spark, d), DEFAULT), f"{base}/index", 16)
    query = stream_text(stream_fastq(spark, f"{base}/in", f"{base}/batches"), load_index(spark, f"{base}/index"), LOOSE, f"{base}/out", f"{base}/state")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return big(read_stream_text(spark, f"{base}/out"))


def queries() -> dict:
    own = [q_seq_len, q_encode, q_kmers, q_hash64, q_bucket_split, q_index_keys, q_index_map, q_index_stats, q_key_pack, q_anchor_pack, q_vote_groups, q_vote_groups_no_origin, q_coverage, q_topk, q_fraction, q_tie_reject, q_dialogue_hits, q_sql_hash64, q_minimizers_table, q_long_reads, q_seeds_per_read, q_speedup, q_mapq, q_mapq_zero,
           q_batches, q_hash_diff_hist, q_mean_sd, q_simulated_reads, q_accuracy_curve, q_profile_avg, q_fastq_to_fasta, q_hex_headers, q_fasta_scan, q_stream_map,
           q_near_dup_docs, q_doc_copies, q_device_seeds, q_minimizers_partial, q_index_roundtrip, q_paf_text, q_stage_profile, q_time_per_base, q_fasta_reads, q_fastq_scan, q_mixed_scan, q_fastq_source, q_paf_saved, q_minimizers_chained, q_seeds_table, q_stream_text]
    return {f.__name__: f for f in own} | {
        "q_minimizers": seeds_of(DEFAULT), "q_minimizers_n": seeds_of(DEFAULT, "."), "q_minimizers_right": seeds_of(IndexParams(ties="right")), "q_minimizers_even": seeds_of(IndexParams(w=3, k=4)), "q_minimizers_sql": seeds_of(DEFAULT, "", minimizers_sql),
        "q_anchors": anchors_of(items, DEFAULT), "q_paf": mapped(items, DEFAULT, LOOSE),
        **{f"q_preset_{n}": mapped(items, *preset(n)) for n in SWEEPS}, **{f"q_sweep_{n}": sweep(n) for n in SWEEPS},
    }


def oracle_sql() -> dict:
    docs, dotted = o.sequences("targets", "documents", "doc_id", "doc"), o.sequences("targets", "documents", "doc_id", "doc", ".")
    seeds = lambda p, t=docs: o.query([t, *o.seeds("s", "targets", p)], "SELECT id AS chrom_id, hash, CAST(loc AS BIGINT) AS loc, CAST(str AS BIGINT) AS str FROM s")
    keys = [docs, *o.seeds("target_seeds", "targets", RARE), o.index("keys", "target_seeds", RARE.max_occ)]
    group = "SELECT read_id, CAST(str AS BIGINT) AS str, grp, vt_score, q_start, q_end, t_start, t_end FROM {}"
    record = "SELECT read_id, CAST(rank AS BIGINT) AS rank, vt_score, q_start, q_end, t_start, t_end, CAST(str AS BIGINT) AS str FROM {}"
    self_map = lambda m: o.mapping(SELF, DEFAULT, m)
    out = lambda reads, p, m: o.query(o.mapping(reads, p, m), "SELECT * FROM paf")
    word = "loc | (CAST(id % 1024 AS BIGINT) << 32) | (CAST(str AS BIGINT) << 42) | ((hash >> 30) << 43)"
    anchor = "(CAST(chrom_id % 1024 AS BIGINT) << 53) | (CAST(diag AS BIGINT) << 23) | (CAST(q_loc AS BIGINT) << 1) | str"
    hashes = {k: f"h{k} AS ({o.hashed('orders', 'CAST(o_orderkey AS BIGINT)', k, 'o_orderkey')})" for k in (15, 19, 21)}
    sim = f"""sim AS (SELECT id, seq, i, substr(seq, i * {SIM_STEP} + 1, {SIM_LEN}) AS piece FROM (SELECT id, seq, unnest(range(0, (len - {SIM_LEN}) // {SIM_STEP} + 1)) AS i FROM targets WHERE len >= {SIM_LEN})),
    noise AS (SELECT *, list_aggregate(list_transform(range(0, {SIM_LEN}), lambda j: CASE WHEN (j * 7 + i) % 40 = 0 THEN translate(substr(piece, j + 1, 1), 'ACGT', 'CGTA') ELSE substr(piece, j + 1, 1) END), 'string_agg', '') AS n FROM sim),
    simulated AS (SELECT id * 1000000 + i AS id, 'sim' || (id * 1000000 + i) AS name, CAST({SIM_LEN} AS BIGINT) AS len, CASE WHEN i % 2 = 1 THEN reverse(translate(n, 'ACGT', 'TGCA')) ELSE n END AS seq, id AS origin, i * {SIM_STEP} AS start FROM noise)"""
    cut = f"pieces AS (SELECT id * 1000000 + i AS id, 'piece' || (id * 1000000 + i) AS name, length(substr(seq, i * {PIECE} + 1, {PIECE})) AS len, substr(seq, i * {PIECE} + 1, {PIECE}) AS seq, id AS origin, i * {PIECE} AS start FROM (SELECT id, seq, unnest(range(0, (len - 1) // {PIECE} + 1)) AS i FROM targets WHERE len > 0))"
    primary = [docs, cut, "reads AS (SELECT id, name, len, seq FROM pieces)", *o.anchors(DEFAULT), *o.groups(LOOSE), *o.records(LOOSE), *o.paf(DEFAULT.k)]
    wrong = "(t_start >> 30) <> s.origin OR (t_start & 1073741823) > s.start + s.len OR (t_end & 1073741823) < s.start"
    by = f"""quality AS (SELECT p.mapq, CAST({wrong} AS BIGINT) AS wrong FROM records r JOIN paf p ON p.read_id = r.read_id AND p.rank = r.rank JOIN pieces s ON s.id = r.read_id WHERE r.rank = 0),
    curve AS (SELECT mapq, count(*) AS n_mapped, CAST(sum(wrong) AS BIGINT) AS n_wrong FROM quality GROUP BY mapq),
    down AS (SELECT *, CAST(sum(n_mapped) OVER (ORDER BY mapq DESC) AS BIGINT) AS cum_mapped, CAST(sum(n_wrong) OVER (ORDER BY mapq DESC) AS BIGINT) AS cum_wrong FROM curve)"""
    pack = f"""turns AS (SELECT conv_id, turn, length(text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS n FROM conversations),
    pack(conv_id, read_id, len, n, batch, used) AS (SELECT conv_id, turn, CAST(len AS BIGINT), n, CAST(0 AS BIGINT), CAST(len + 1 AS BIGINT) FROM turns WHERE n = 1 UNION ALL
    SELECT t.conv_id, t.turn, CAST(t.len AS BIGINT), t.n, CASE WHEN p.used + t.len + 1 > {CAPACITY} THEN p.batch + 1 ELSE p.batch END, CASE WHEN p.used + t.len + 1 > {CAPACITY} THEN t.len + 1 ELSE p.used + t.len + 1 END FROM pack p JOIN turns t ON t.conv_id = p.conv_id AND t.n = p.n + 1)"""
    return {
        "q_seq_len": o.query([docs], "SELECT id AS chrom_id, name, CAST(len AS BIGINT) AS len FROM targets"),
        "q_encode": o.query([dotted], "SELECT id AS chrom_id, CAST((ascii(b) & 15) >> 1 AS BIGINT) AS code, count(*) AS n FROM (SELECT id, unnest(string_split(seq, '')) AS b FROM targets WHERE len > 0) GROUP BY ALL"),
        "q_kmers": o.query([docs, *o.kmers("s", "targets", 15)], "SELECT id AS chrom_id, count(*) AS n, CAST(sum(z) AS BIGINT) AS n_reverse, min(h) AS least, max(h) AS most, CAST(sum(h) AS BIGINT) AS total FROM s_k WHERE clear AND NOT pal GROUP BY id"),
        "q_hash64": o.query(list(hashes.values()), "SELECT h15.o_orderkey, h15.h AS h15, h19.h AS h19, h21.h AS h21 FROM h15 JOIN h19 USING (o_orderkey) JOIN h21 USING (o_orderkey)"),
        "q_sql_hash64": o.query(list(hashes.values()), "SELECT h15.o_orderkey, h15.h AS h15, h19.h AS h19, h21.h AS h21 FROM h15 JOIN h19 USING (o_orderkey) JOIN h21 USING (o_orderkey)"),
        "q_minimizers_table": o.query([READS, *o.seeds("s", "reads", DEFAULT)], "SELECT id AS read_id, hash, CAST(loc AS BIGINT) AS loc, CAST(str AS BIGINT) AS str FROM s"),
        "q_long_reads": o.query([SELF], "SELECT id AS read_id, name, CAST(len AS BIGINT) AS len FROM reads WHERE len >= 1000"),
        "q_seeds_per_read": o.query([docs, SELF, *o.anchors(DEFAULT)], "SELECT read_id, count(DISTINCT q_loc) AS n_seeds FROM anchors GROUP BY read_id"),
        "q_speedup": "WITH a AS (SELECT event_type AS label, avg(CAST(round(value * 1000000) AS BIGINT)) / 1000000 AS ms FROM events GROUP BY event_type) SELECT label, round((SELECT ms FROM a WHERE label = 'view') / ms, 6) AS speedup FROM a",
        "q_bucket_split": o.query([f"s AS ({o.hashed('lineitem', 'CAST(l_orderkey AS BIGINT)', 21, 'l_orderkey')})"], "SELECT DISTINCT h AS hash, h & 1073741823 AS bucket_id, h >> 30 AS seed_id FROM s"),
        "q_minimizers": seeds(DEFAULT), "q_minimizers_sql": seeds(DEFAULT), "q_minimizers_n": seeds(DEFAULT, dotted), "q_minimizers_right": seeds(IndexParams(ties="right")), "q_minimizers_even": seeds(IndexParams(w=3, k=4)),
        "q_index_keys": o.query(keys, "SELECT hash, id AS chrom_id, CAST(loc AS BIGINT) AS loc, CAST(str AS BIGINT) AS str FROM keys"),
        "q_index_map": o.query(keys, 'SELECT bucket_id, CAST(sum(n) OVER (ORDER BY bucket_id) AS BIGINT) AS "end" FROM (SELECT hash & 1073741823 AS bucket_id, count(*) AS n FROM keys GROUP BY 1)'),
        "q_index_stats": o.query(keys, "SELECT (SELECT count(*) FROM targets) AS n_targets, (SELECT CAST(sum(len) AS BIGINT) FROM targets) AS n_bases, (SELECT count(*) FROM target_seeds) AS n_minimizers, (SELECT count(DISTINCT hash) FROM target_seeds) AS n_hashes, (SELECT count(*) FROM keys) AS n_keys, (SELECT count(DISTINCT hash) FROM keys) AS n_kept, (SELECT CAST(ceil(count(*) / 67108864) AS BIGINT) FROM keys) AS key_sections, CAST(ceil(1073741824 / 134217728) AS BIGINT) AS map_sections"),
        "q_key_pack": o.query(keys, f"SELECT id AS chrom_id, CAST(id // 1024 AS BIGINT) AS page, CAST(loc AS BIGINT) AS loc, hash, {word} AS word, true AS same FROM keys"),
        "q_anchor_pack": o.query([docs, READS, *o.anchors(DEFAULT)], f"SELECT read_id, CAST(chrom_id // 1024 AS BIGINT) AS page, {anchor} AS word, CAST(chrom_id % 1024 AS BIGINT) * 1073741824 + diag AS target, CAST(q_loc AS BIGINT) AS q_loc, CAST(str AS BIGINT) AS str FROM anchors"),
        "q_anchors": o.query([docs, READS, *o.anchors(DEFAULT)], "SELECT read_id, chrom_id, CAST(diag AS BIGINT) AS diag, CAST(q_loc AS BIGINT) AS q_loc, CAST(str AS BIGINT) AS str FROM anchors"),
        "q_vote_groups": o.query(self_map(LOOSE), group.format("groups")), "q_vote_groups_no_origin": o.query(self_map(MapParams(compat_origin=False)), group.format("groups")),
        "q_coverage": o.query(self_map(LOOSE), group.format("covered")), "q_topk": o.query(self_map(LOOSE), record.format("top")), "q_fraction": o.query(self_map(LOOSE), record.format("records")), "q_tie_reject": o.query(self_map(MapParams()), record.format("records")),
        "q_mapq": o.query(self_map(LOOSE), "SELECT mapq, count(*) AS n FROM paf WHERE rank = 0 GROUP BY mapq"),
        "q_mapq_zero": o.query(self_map(LOOSE), "SELECT read_id, qname, tname, nmatch FROM paf WHERE rank = 0 AND mapq = 0"),
        "q_paf": out(READS, DEFAULT, LOOSE), "q_paf_saved": out(READS, DEFAULT, LOOSE), "q_stream_map": out(READS, DEFAULT, LOOSE), "q_dialogue_hits": o.query([o.sequences("targets", "conversations", TURN, "turn"), o.sequences("reads", "conversations", TURN, "turn"), *o.mapping(SELF, DEFAULT, LOOSE)[2:]], "SELECT * FROM paf"),
        **{f"q_preset_{n}": out(READS, *preset(n)) for n in SWEEPS},
        "q_near_dup_docs": o.query([o.sequences("alls", "documents", "doc_id", "doc"), "kinds AS (SELECT md5(seq) AS key, min(id) AS id, count(*) AS copies FROM alls WHERE len > 0 GROUP BY 1)", *["{} AS (SELECT a.* FROM alls a JOIN kinds k ON k.id = a.id)".format(n) for n in ("targets", "reads")], *o.mapping("", DEFAULT, LOOSE)[2:]], "SELECT p.*, k.copies FROM paf p JOIN kinds k ON k.id = p.read_id"),
        "q_doc_copies": o.query([SELF], "SELECT id AS read_id, min(id) OVER (PARTITION BY seq) AS stands FROM reads WHERE len > 0"),
        "q_device_seeds": o.query(["targets AS (SELECT id, length(seq) AS len, translate(seq, 'BCDEFGHIJKLMOPQRSTUVWXYZ', 'CCTTGGAACCTTGAACCTTGGAAC') AS seq FROM (SELECT doc_id AS id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS seq FROM documents))", *o.seeds("s", "targets", DEFAULT)], "SELECT id AS chrom_id, hash, CAST(loc AS BIGINT) AS loc, CAST(str AS BIGINT) AS str FROM s"),
        "q_minimizers_chained": o.query([READS, *o.seeds("s", "reads", DEFAULT)], "SELECT id AS read_id, hash, CAST(loc AS BIGINT) AS loc, CAST(str AS BIGINT) AS str FROM s"),
        "q_seeds_table": seeds(DEFAULT),
        "q_minimizers_partial": o.query([docs, *o.seeds("s", "targets", DEFAULT)], "SELECT id AS chrom_id, hash, CAST(loc AS BIGINT) AS loc, CAST(str AS BIGINT) AS str, CAST(CASE WHEN n = 100 AND more IS NOT NULL THEN loc - 13 END AS BIGINT) AS resume FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loc) AS n, lead(loc) OVER (PARTITION BY id ORDER BY loc) AS more FROM s) WHERE n <= 100"),
        "q_index_roundtrip": o.query(keys, "SELECT row_number() OVER (ORDER BY hash & 1073741823, hash >> 30, id, loc) - 1 AS n, hash, id AS chrom_id, CAST(loc AS BIGINT) AS loc, CAST(str AS BIGINT) AS str FROM keys"),
        "q_stream_text": o.query(o.mapping(READS, DEFAULT, LOOSE), "SELECT row_number() OVER (ORDER BY read_id, rank) - 1 AS n, concat_ws(chr(9), qname, qlen, qstart, qend, strand, tname, tlen, tstart, tend, nmatch, blen, mapq, vt) AS value FROM paf"),
        "q_paf_text": o.query(o.mapping(READS, DEFAULT, LOOSE), "SELECT row_number() OVER (ORDER BY read_id, rank) - 1 AS n, concat_ws(chr(9), qname, qlen, qstart, qend, strand, tname, tlen, tstart, tend, nmatch, blen, mapq, vt) AS value FROM paf"),
        "q_stage_profile": o.query(o.mapping(READS, DEFAULT, LOOSE), "SELECT * FROM (VALUES ('reads', (SELECT count(*) FROM reads)), ('seeds', (SELECT count(*) FROM read_seeds)), ('anchors', (SELECT count(*) FROM anchors)), ('groups', (SELECT count(*) FROM groups)), ('covered', (SELECT count(*) FROM covered)), ('records', (SELECT count(*) FROM records))) AS t(stage, n)"),
        "q_time_per_base": o.query([docs], "SELECT event_type AS label, count(x) AS n, round(avg(x), 6) AS ms_per_base FROM (SELECT event_type, value / nullif(len, 0) AS x FROM events JOIN targets ON id = event_id % (SELECT count(*) FROM targets)) GROUP BY 1"),
        "q_fasta_reads": o.query([docs], "SELECT row_number() OVER (ORDER BY id, i) - 1 AS ordinal, name || CASE WHEN i = 1 THEN 'b' ELSE '' END AS name, CAST(length(s) AS BIGINT) AS len, md5(s) AS seq_md5 FROM (SELECT id, name, i, CASE WHEN i = 0 THEN substr(seq, 1, len // 2) ELSE substr(seq, len // 2 + 1) END AS s FROM targets, (VALUES (0), (1)) AS v(i))"),
        "q_mixed_scan": o.query([SELF], "SELECT row_number() OVER (ORDER BY id % 2, id) - 1 AS ordinal, name, CAST(len AS BIGINT) AS len, md5(seq) AS seq_md5 FROM reads"),
        "q_fastq_source": o.query([SELF], "SELECT row_number() OVER (ORDER BY id) - 1 AS ordinal, name, CAST(len AS BIGINT) AS len, md5(seq) AS seq_md5 FROM reads"),
        "q_fastq_scan": o.query([SELF], "SELECT row_number() OVER (ORDER BY id) - 1 AS ordinal, name, CAST(len AS BIGINT) AS len, md5(seq) AS seq_md5 FROM reads"),
        **{f"q_sweep_{n}": " UNION ALL ".join(f"SELECT *, CAST({at['max_occ']} AS BIGINT) AS max_occ FROM ({out(READS, *preset(n, **at))})" for at in SWEEPS[n]) for n in SWEEPS},
        "q_batches": o.query([pack], "SELECT conv_id AS stream, read_id, len, batch FROM pack"),
        "q_hash_diff_hist": o.query([docs, *o.seeds("s", "targets", DEFAULT)], "SELECT CAST((d // 1000) * 1000 + 500 AS BIGINT) AS bin, count(*) AS n FROM (SELECT hash - lag(hash) OVER (ORDER BY hash) AS d FROM (SELECT DISTINCT hash FROM s)) WHERE d IS NOT NULL GROUP BY 1"),
        "q_mean_sd": o.query([docs, *o.seeds("s", "targets", DEFAULT)], "SELECT count(*) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS sd FROM (SELECT id, count(*) AS c FROM s GROUP BY id)"),
        "q_simulated_reads": o.query([docs, sim], "SELECT id AS read_id, name, len, seq, origin, CAST(start AS BIGINT) AS start FROM simulated"),
        "q_accuracy_curve": o.query([*primary, by], "SELECT mapq, n_mapped, n_wrong, cum_mapped, cum_wrong / cum_mapped AS cum_err, cum_mapped / (SELECT count(*) FROM pieces) AS mapped_share FROM down"),
        "q_profile_avg": "SELECT event_type AS label, count(*) AS n, round(avg(CAST(round(value * 1000000) AS BIGINT)) / 1000000, 6) AS avg_ms FROM events GROUP BY event_type",
        "q_fastq_to_fasta": o.query([SELF], "SELECT id AS read_id, '>' || name || chr(10) || seq AS value FROM reads"),
        "q_hex_headers": "SELECT doc_id AS read_id, lower(to_hex(doc_id)) AS name FROM documents",
        "q_fasta_scan": o.query([docs], "SELECT row_number() OVER (ORDER BY id) - 1 AS ordinal, name, CAST(len AS BIGINT) AS len, md5(seq) AS seq_md5 FROM targets"),
    }
