"""Perplexity under an interpolated modified Kneser-Ney trigram model.

Counts are made in Spark. Tasks count the trigrams they read and deal them, packed, by their middle
token; so the task that gathers them sees whole contexts (u, v) and whole bigrams (v, w), and leaves
one file. A middle token too frequent for one file is spread over files by the whole trigram, and
what these have of its contexts and bigrams is summed in a second exchange, dealt by the bigram.
The model is a folder of sorted hash arrays in the shared folder, which workers map into memory:

- ``vocab-*``: sorted 64-bit hashes of the training tokens, their ids and counts. Ids are smaller
  for more frequent tokens, which packs them well.
- ``grams-*`` and ``hot-*``: tables of trigram counts, of contexts (how often they go on, and with
  how many tokens once, twice and more often) and of bigrams (how many tokens come before them).
  Keys are the upper 48 bits of a hash; entries counted once have no more than their key.
- ``uni-*``: by id, how many tokens come before a token, and as a context the sum of its bigrams'
  numbers and how many of these are 1, 2 and more.

p(w | u v) = (c(uvw) - D) / c(uv) + g(uv) p(w | v);  p(w | v) = (n(vw) - D') / n(v) + g(v) p(w);
p(w) = (n(w) - D'') / n + g / (V + 1). n(vw) is the number of distinct u before vw, n(v) the sum of
n(vw), n(w) the number of distinct v; V + 1 leaves room for an unknown token. Before a text stand two
begins, and bigrams after a begin count as they occur; each text ends in a token. A context that
training has not seen leaves its share to the next order.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, dropped, shared_path, written

HELD_OUT_MOD, HELD_OUT = 7, 2
#: Bytes of text worked on at a time; a longer text is one piece.
PIECE = 2 << 20
#: Trigrams a task gathers before it hands them on.
GATHER = 1_000_000
#: Trigram tokens aimed at in a file; tokens from which on a middle token is spread, by so many to a part; entries of the vocabulary, and ids, in a file.
FILE_GRAMS, HOT, FILE_VOCAB, FILE_IDS = 2_000_000, 1_000_000, 1_000_000, 250_000
#: Files that a worker keeps open.
OPEN = 4_000
END = np.uint64(0x1D8E4E27C47D124F)
LOWER = np.frombuffer(LOWER_BYTES, np.uint8)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LONG_WORD = 64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): token hashes of the texts data[offsets[i]:offsets[i + 1]], each followed by END, and tokens by text."""
    n = len(offsets) - 1
    data = LOWER[data]
    word = ~SPACE[data]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = True
    edge[-1] = True
    starts = np.flatnonzero(word & (np.concatenate(([True], ~word[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & (np.concatenate((~word[1:], [True])) | edge[1:])) + 1 if len(data) else starts
    lengths = ends - starts
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    eight = np.empty(len(data) + 1, np.uint64)
    for o in range(8):
        part = padded[o : o + (len(padded) - o) // 8 * 8].view(np.uint64)
        eight[o::8] = part[: len(eight[o::8])]
    h = mixed(lengths.astype(np.uint64))
    live = np.flatnonzero(lengths <= LONG_WORD)
    for j in range(0, LONG_WORD, 8):
        live = live[lengths[live] > j]
        if not len(live):
            break
        left = np.minimum(lengths[live] - j, 8).astype(np.uint64)
        bits = eight[starts[live] + j] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        h[live] = mixed(h[live] * np.uint64(0x9E3779B97F4A7C15) ^ bits)
    for i in np.flatnonzero(lengths > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    counts = np.diff(np.searchsorted(starts, offsets))
    out = np.full(len(starts) + n, END, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), counts)] = h
    return out, counts + 1


def pieces(batches: Iterator[pa.RecordBatch], text_at: int, raw: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, hashes, counts) of pieces of the batches, by bytes of text; raw: (rows, bytes, offsets)."""
    for batch in batches:
        sizes = np.array(pc.binary_length(batch.column(text_at)).fill_null(0), np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if b > a:
                rows = batch.slice(a, b - a)
                data = np.frombuffer(b"".join(x.as_buffer() if x.is_valid else b"" for x in rows.column(text_at)), np.uint8)
                offsets = np.concatenate(([0], np.cumsum(sizes[a:b])))
                yield rows, *((data, offsets) if raw else tokens(data, offsets))


def summed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of the columns."""
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[at], *(np.add.reduceat(c[order], at) if len(at) else c for c in columns)


def by_both(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Order by ``x``, at most ``most``, and then by the upper bits of ``y``, in one sort."""
    bits = np.uint64(max(1, most.bit_length()))
    return np.argsort(x << (np.uint64(64) - bits) | y >> bits)


def in_turn(parts: np.ndarray) -> np.ndarray:
    """Stable order of parts; few parts are sorted by counting."""
    return np.argsort(parts.astype(np.uint16) if parts.max(initial=0) < 1 << 16 else parts, kind="stable")


def kinds_of(group: np.ndarray, n: int, counts: np.ndarray) -> list[np.ndarray]:
    """For each of ``n`` groups how many counts are 1, 2 and more."""
    return [np.bincount(group[np.minimum(counts, 3) == i], minlength=n).astype(np.int64) for i in (1, 2, 3)]


def fours(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4, and 3 or more."""
    return np.array([*[(counts == i).sum() for i in (1, 2, 3, 4)], (counts >= 3).sum()], np.int64)


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers, the first column in order, as compressed byte planes."""
    n, parts, widths = len(columns[0]), [], []
    for i, x in enumerate(columns):
        x = x.astype(np.uint64)
        x = np.diff(x, prepend=np.uint64(0)) if i == 0 else x
        widths.append(max(1, (int(x.max(initial=0)).bit_length() + 7) // 8))
        parts.append(np.ascontiguousarray(x).view(np.uint8).reshape(n, 8)[:, : widths[-1]].T.tobytes())
    raw = b"".join(parts)
    return struct.pack(f"<QB{len(widths)}B", n, len(widths), *widths) + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpacked(blob: bytes) -> list[np.ndarray]:
    n, k = struct.unpack_from("<QB", blob)
    widths = struct.unpack_from(f"<{k}B", blob, 9)
    raw = pa.decompress(blob[9 + k :], n * sum(widths), "zstd", asbytes=True) if n else b""
    out, at = [], 0
    for i, width in enumerate(widths):
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        x = x.reshape(-1).view(np.uint64)
        out.append(np.cumsum(x, dtype=np.uint64) if i == 0 else x)
    return out


def save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays as one file; it appears whole, so that a task may run twice."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    sizes = [x.nbytes for x in arrays]
    with fs.open_output_stream(part) as out:
        out.write(np.array([len(sizes), *sizes], np.int64).tobytes())
        for x in arrays:
            out.write(np.ascontiguousarray(x).tobytes() + bytes(-x.nbytes % 8))
    fs.move(part, f"{path}/{name}")


def load(folder: str, name: str) -> list[np.ndarray]:
    """The arrays of a file, as bytes: mapped into memory where the shared folder is mounted, else read."""
    fs, path = pafs.FileSystem.from_uri(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        data = np.memmap(f"{path}/{name}", np.uint8, "r")
    else:
        with fs.open_input_stream(f"{path}/{name}") as file:
            data = np.frombuffer(file.read(), np.uint8)
    n = int(data[:8].view(np.int64)[0])
    at, out = 8 * (n + 1), []
    for size in data[8:at].view(np.int64).tolist():
        out.append(data[at : at + size])
        at += size + -size % 8
    return out


class Files:
    """Open files of a folder, the last ``OPEN`` of them."""

    def __init__(self, folder: str) -> None:
        self.folder, self.held = folder, {}

    def __getitem__(self, name: str) -> list[np.ndarray]:
        if name not in self.held:
            if len(self.held) >= OPEN:
                self.held.pop(next(iter(self.held)))
            self.held[name] = load(self.folder, name)
        return self.held[name]


def column(x: np.ndarray) -> list[np.ndarray]:
    """Numbers as a byte each; those of 255 and more beside it."""
    big = np.flatnonzero(x >= 255)
    return [np.minimum(x, 255).astype(np.uint8), big.astype(np.uint32), x[big].astype(np.int64)]


def values(parts: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    small, big, more = parts[0], parts[1].view(np.uint32), parts[2].view(np.int64)
    out = small[at].astype(np.int64)
    over = np.flatnonzero(out == 255)
    if len(over):
        out[over] = more[np.searchsorted(big, at[over])]
    return out


def halves(keys: np.ndarray) -> list[np.ndarray]:
    return [(keys >> np.uint64(32)).astype(np.uint32), (keys >> np.uint64(16)).astype(np.uint16)]


def found(hi: np.ndarray, lo: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in sorted halves, -1 where they are not."""
    hi, lo = hi.view(np.uint32), lo.view(np.uint16)
    out = np.full(len(keys), -1, np.int64)
    if len(hi):
        high, low = halves(keys)
        at, open_ = np.searchsorted(hi, high), np.arange(len(keys))
        while len(open_):
            here = np.minimum(at[open_], len(hi) - 1)
            same = (at[open_] < len(hi)) & (hi[here] == high[open_])
            met = same & (lo[here] == low[open_])
            out[open_[met]] = here[met]
            open_ = open_[same & ~met]
            at[open_] += 1
    return out


#: Columns of a table: trigrams (count), contexts (count and three kinds), bigrams (number). Arrays of one: keys counted once, other keys, columns.
TABLES = {"trigrams": 1, "contexts": 4, "bigrams": 1}
WIDTH = {t: 4 + 3 * k for t, k in TABLES.items()}
BEGINS = {"trigrams": 0, "contexts": WIDTH["trigrams"], "bigrams": WIDTH["trigrams"] + WIDTH["contexts"]}


def table(keys: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Arrays of a table with sorted keys. A first column of 1 stands for 1 and one kind of count 1."""
    one = columns[0] == 1
    return [*halves(keys[one]), *halves(keys[~one]), *[x for c in columns for x in column(c[~one])]]


def look_up(file: list[np.ndarray], of: str, keys: np.ndarray) -> np.ndarray:
    """Columns of a table for keys, zeros where it has none."""
    k, arrays = TABLES[of], file[BEGINS[of] : BEGINS[of] + WIDTH[of]]
    out = np.zeros((k, len(keys)), np.int64)
    at = found(arrays[2], arrays[3], keys)
    more, rest = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
    for i in range(k):
        out[i, more] = values(arrays[4 + 3 * i : 7 + 3 * i], at[more])
    out[:2, rest[found(arrays[0], arrays[1], keys[rest]) >= 0]] = 1
    return out


def pair_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mixed(mixed(x + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15) + y)


def file_of(v: np.ndarray, key: np.ndarray, spread: np.ndarray, n: int) -> np.ndarray:
    """File of a trigram: by its middle token, and for a frequent one by the trigram's key too."""
    return (mixed(v * np.uint64(0xD6E8FEB86659FD93) + key % spread.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def grams(ids: np.ndarray, counts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): the two tokens before each token of the texts."""
    first = np.cumsum(counts) - counts
    v = np.concatenate((ids[:1], ids[:-1]))
    v[first] = begin
    u = np.concatenate((v[:1], v[:-1]))
    u[first] = begin
    return u, v


class Vocabulary:
    """Ids and counts of tokens, from the ``vocab-*`` files: (least hash, entries) of each."""

    def __init__(self, files: Files, parts: list[tuple[int, int]]) -> None:
        self.files, self.lows, self.n = files, np.array([low for low, _ in parts], np.uint64), len(parts)

    def look_up(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count); -1 and 0 for unknown tokens."""
        ids, counts = np.full(len(sorted_hashes), -1, np.int64), np.zeros(len(sorted_hashes), np.int64)
        cuts = np.concatenate((np.searchsorted(sorted_hashes, self.lows[1:]), [len(sorted_hashes)])) if self.n else np.zeros(0, np.int64)
        at = 0
        for i, end in enumerate(cuts.tolist()):
            if end > at:
                keys, own, *count = self.files[f"vocab-{i:06}"]
                keys, q = keys.view(np.uint64), sorted_hashes[at:end]
                place = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == q)
                ids[at + hit] = own.view(np.uint64 if len(own) == 8 * len(keys) else np.uint32)[place[hit]].astype(np.int64)
                counts[at + hit] = values(count, place[hit])
            at = end
        return ids, counts


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from how many counts are 1, 2, 3 and 4; half of each count's least excess where these are missing."""
    if min(n[:4]) <= 0:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)]


def blob_rows(kind: str, parts: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (kind, part, blob) of columns dealt into parts; the first column is in order."""
    order = in_turn(parts)
    parts = parts[order]
    cuts = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1], [True]))) if len(parts) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([int(parts[a])], pa.int32()), pa.array([packed(*[c[order[a:b]] for c in columns])], pa.binary())], names=["kind", "part", "blob"])


ROWS = "kind string, part int, blob binary"


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, str], list]:
    """Blobs of the rows of a task, by part and kind."""
    held: dict[tuple[int, str], list] = {}
    for batch in batches:
        for kind, part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            held.setdefault((part, kind), []).append(bytes(blob.as_buffer()))
    return held


def joined(blobs: list[bytes], k: int) -> list[np.ndarray]:
    parts = [unpacked(b) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(k)]


def saved_words(words: DataFrame, folder: str, size: int) -> list[tuple[int, int]]:
    """Writes the ``vocab-*`` files; returns their least hashes and sizes. Ids go by the count's logarithm, the greatest first, then by hash."""
    n_ranges = max(1, -(-size // FILE_VOCAB))
    # ranges of the hash's upper 31 bits, in their unsigned order
    part = F.shiftright(F.shiftrightunsigned("h", 33) * F.lit(n_ranges), 31).cast("int")
    ranged = words.select(part.alias("part"), "h", "n", F.floor(F.log2("n")).cast("int").alias("level"))
    sizes = {(r[0], r[1]): r[2] for r in ranged.groupBy("level", "part").count().collect()}
    begins, at = {}, 0
    for level, p in sorted(sizes, key=lambda x: (-x[0], x[1])):
        begins[p, level] = at
        at += sizes[level, p]
    places = {p: i for i, p in enumerate(sorted({p for p, _ in begins}))}
    kind = np.uint32 if size < (1 << 32) - 1 else np.uint64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            parts, keys, counts, levels = (t.column(c).to_numpy() for c in ("part", "h", "n", "level"))
            for p in np.unique(parts).tolist():
                here = parts == p
                k, c, level = keys[here].view(np.uint64), counts[here], levels[here]
                order = np.argsort(k)
                k, c, level = k[order], c[order], level[order]
                ids = np.zeros(len(k), kind)
                for x in np.unique(level).tolist():
                    of = np.flatnonzero(level == x)
                    ids[of] = begins[p, x] + np.arange(len(of))
                save(folder, f"vocab-{places[p]:06}", [k, ids, *column(c)])
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(k)], pa.int64())], names=["part", "n"])

    made = sorted((r[0], r[1]) for r in ranged.repartition(n_ranges, "part").mapInArrow(run, "part int, n bigint").collect())
    return [(-(-(p << 31) // n_ranges) << 33, n) for p, n in made]


def fitted(train: DataFrame) -> dict:
    """Counts the rows (text) and leaves the model's files in the shared folder; returns their names and the model's few numbers."""
    spark = train.sparkSession
    folder = shared_path(spark, "kneser-ney")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = folder.replace("file:///", "file:/").replace("file:/", "file:///")

    def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "n"])
        for _, hashes, _ in pieces(batches, 0):
            k, c = np.unique(hashes, return_counts=True)
            keys, counts = summed(np.concatenate((keys, k)), np.concatenate((counts, c)))
            if len(keys) > GATHER:
                yield out()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield out()

    words = written(train.mapInArrow(count_tokens, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "tokens")
    size, total = (int(x) for x in words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first())
    parts = saved_words(words, folder, size)
    dropped(words)
    texts, begin = train.count(), size
    n_files, n_ids, hot = max(1, -(-total // FILE_GRAMS)), max(1, -(-(size + 1) // FILE_IDS)), HOT

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, held, gathered_ = Vocabulary(Files(folder), parts), [], 0

        def tally() -> list[np.ndarray]:
            u, v, w, s, n = (np.concatenate([h[i] for h in held]) for i in range(5))
            key = pair_key(pair_key(u, v), w)
            order = np.argsort(key)
            at = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
            one = order[at]
            return [u[one], v[one], w[one], s[one], np.add.reduceat(n[order], at)]

        def out(u: np.ndarray, v: np.ndarray, w: np.ndarray, s: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = by_both(v, u << np.uint64(64 - begin.bit_length()), begin)
            u, v, w, s, n = (x[order] for x in (u, v, w, s, n))
            yield from blob_rows("grams", file_of(v, pair_key(pair_key(u, v), w), s, n_files), v, u, w, s > 1, n)

        for _, hashes, counts in pieces(batches, 0):
            distinct, at = np.unique(hashes, return_inverse=True)
            ids, often = vocab.look_up(distinct)
            w = ids[at].astype(np.uint64)
            u, v = grams(w, counts, begin)
            spread = np.maximum(1, -(-often // hot))[at]
            s = np.concatenate((spread[:1], spread[:-1]))
            s[np.cumsum(counts) - counts] = max(1, -(-texts // hot))
            held.append([u, v, w, s, np.ones(len(w), np.int64)])
            gathered_ += len(w)
            if gathered_ > GATHER:
                held = [tally()]
                gathered_ = len(held[0][0])
                if gathered_ > GATHER // 2:
                    yield from out(*held[0])
                    held, gathered_ = [], 0
        if held:
            yield from out(*tally())

    def uni(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What bigrams add to their tokens: to the second that one more token comes before it, to the first the number and its kind."""
        vs, at = np.unique(v, return_inverse=True)
        mass = np.bincount(at, n.astype(np.float64), len(vs)).astype(np.int64)
        ws, before = np.unique(w, return_counts=True)
        ids = np.union1d(vs, ws)
        cols = np.zeros((5, len(ids)), np.int64)
        cols[0, np.searchsorted(ids, ws)] = before
        cols[1:, np.searchsorted(ids, vs)] = [mass, *kinds_of(at, len(vs), n)]
        yield from blob_rows("uni", (ids % np.uint64(n_ids)).astype(np.int64), ids, *cols)

    def note(kind: str, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([-1], pa.int32()), pa.array([fours(counts).tobytes()], pa.binary())], names=["kind", "part", "blob"])

    def made(f: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(["made"]), pa.array([f], pa.int32()), pa.array([b""], pa.binary())], names=["kind", "part", "blob"])

    def bigrams(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, v, w, n) of distinct bigrams in the order of keys, from parts of their numbers."""
        key = pair_key(v, w)
        order = np.argsort(key)
        at = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0))) if len(key) else np.zeros(0, np.int64)
        one = order[at]
        return key[one], v[one], w[one], np.add.reduceat(n[order], at) if len(at) else n

    def save_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = gathered(batches)
        for f, kind in list(held):
            v, u, w, s, n = joined(held.pop((f, kind)), 5)
            n, context = n.astype(np.int64), pair_key(u, v)
            key = pair_key(context, w)
            order = np.argsort(key)
            at = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
            one, n = order[at], np.add.reduceat(n[order], at)
            key, context, v, w, s = key[one], context[one], v[one], w[one], s[one] > 0
            yield note("three", n)
            heads, of = np.unique(context, return_inverse=True)
            columns = [np.bincount(of, n.astype(np.float64), len(heads)).astype(np.int64), *kinds_of(of, len(heads), n)]
            spread = np.zeros(len(heads), bool)
            spread[of] = s
            before = np.where(v == begin, n, 1)
            whole = bigrams(v[~s], w[~s], before[~s])
            save(folder, f"grams-{f:06}", [*table(key, [n]), *table(heads[~spread], [c[~spread] for c in columns]), *table(whole[0], [whole[3]])])
            yield made(f)
            yield note("two", whole[3])
            yield from uni(*whole[1:])
            if s.any():
                # of a spread token this file has parts only
                yield from blob_rows("contexts", (heads[spread] % np.uint64(n_files)).astype(np.int64), heads[spread], *[c[spread] for c in columns])
                k, v2, w2, n2 = bigrams(v[s], w[s], before[s])
                order = np.argsort(v2, kind="stable")
                yield from blob_rows("bigrams", (k[order] % np.uint64(n_files)).astype(np.int64), v2[order], w2[order], n2[order])

    def save_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = gathered(batches)
        for f in sorted({f for f, _ in held}):
            heads, *columns = joined(held.pop((f, "contexts"), []), 5)
            heads, *columns = summed(heads, *[c.astype(np.int64) for c in columns])
            v, w, n = joined(held.pop((f, "bigrams"), []), 3)
            key, v, w, n = bigrams(v, w, n.astype(np.int64))
            save(folder, f"hot-{f:06}", [*table(np.zeros(0, np.uint64), [np.zeros(0, np.int64)]), *table(heads, columns), *table(key, [n])])
            yield note("two", n)
            yield made(f)
            yield from uni(v, w, n)

    def save_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = gathered(batches)
        for j, kind in list(held):
            ids, *cols = joined(held.pop((j, kind)), 6)
            sums = [np.bincount((ids // np.uint64(n_ids)).astype(np.int64), c.astype(np.float64), -(-(begin + 1 - j) // n_ids)).astype(np.int64) for c in cols]
            save(folder, f"uni-{j:06}", [x for c in sums for x in column(c)])
            yield note("one", sums[0])

    counted = written(train.mapInArrow(count_grams, ROWS).repartition(n_files, "part").mapInArrow(save_grams, ROWS), "grams")
    more = written(counted.filter("kind in ('contexts', 'bigrams')").repartition(n_files, "part").mapInArrow(save_hot, ROWS), "hot")
    single = counted.filter("kind = 'uni'").union(more.filter("kind = 'uni'")).repartition(n_ids, "part").mapInArrow(save_ids, ROWS)
    single = written(single, "single")
    n = {k: np.zeros(5, np.int64) for k in ("one", "two", "three")}
    for rows in (counted, more, single):
        for r in rows.filter("part = -1").select("kind", "blob").collect():
            if r[0] in n:
                n[r[0]] += np.frombuffer(bytes(r[1]), np.int64)
    have = [[r[0] for r in x.filter("kind = 'made'").select("part").collect()] for x in (counted, more)]
    dropped(counted, more, single)
    types = int(n["one"][[0, 1, 4]].sum()), int(n["two"][[0, 1, 4]].sum())
    return {"folder": folder, "parts": parts, "n_files": n_files, "n_ids": n_ids, "hot": hot, "have": have, "total": total, "size": size, "texts": texts, "bigrams": types[1], "d": [discounts(n[k][:4].tolist()) for k in ("one", "two", "three")], "one": n["one"].tolist()}


class Model:
    """Log probabilities from the files of ``fitted``."""

    def __init__(self, m: dict) -> None:
        self.m, self.files = m, Files(m["folder"])
        self.vocab = Vocabulary(self.files, m["parts"])
        self.d1, self.d2, self.d3 = (np.array([0, *d]) for d in m["d"])
        self.have = np.zeros((2, m["n_files"]), bool)
        for i, files in enumerate(m["have"]):
            self.have[i, files] = True
        n = m["one"]
        self.rest = (self.d1[1] * n[0] + self.d1[2] * n[1] + self.d1[3] * n[4]) / m["bigrams"] / (m["size"] + 1) if m["bigrams"] else 1 / (m["size"] + 1)

    def tokens(self, ids: np.ndarray) -> np.ndarray:
        """For known ids: tokens before, sum of bigrams, their kinds."""
        out = np.zeros((5, len(ids)), np.int64)
        of = ids % self.m["n_ids"]
        for j, at in by_part(of):
            file = self.files[f"uni-{j:06}"]
            for i in range(5):
                out[i, at] = values(file[3 * i : 3 * i + 3], ids[at] // self.m["n_ids"])
        return out

    def rows(self, of: str, keys: np.ndarray, files: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Columns of a table for keys, which are in these files, or where ``hot`` in those for spread tokens."""
        n = self.m["n_files"]
        where = np.where(hot, (keys % np.uint64(n)).astype(np.int64) + n, files)
        # by file and there by key, so that one search follows the other through the arrays
        order = by_both(where.astype(np.uint64), keys, 2 * n)
        keys, out = keys[order], np.zeros((TABLES[of], len(keys)), np.int64)
        cuts = np.searchsorted(where[order], np.arange(2 * n + 1))
        for f in np.flatnonzero((np.diff(cuts) > 0) & self.have.ravel()).tolist():
            at = slice(cuts[f], cuts[f + 1])
            out[:, order[at]] = look_up(self.files[f"{'hot' if f >= n else 'grams'}-{f % n:06}"], of, keys[at])
        return out

    def scores(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(known tokens, base log10, model log10) of each text."""
        m, begin = self.m, self.m["size"]
        distinct, at = np.unique(hashes, return_inverse=True)
        ids, often = self.vocab.look_up(distinct)
        # one more row for what begins a text
        ids, often = np.append(ids, begin), np.append(often, m["texts"])
        known = ids >= 0
        stats = np.zeros((5, len(ids)), np.int64)
        if m["total"]:
            stats[:, known] = self.tokens(ids[known])
        before, mass = stats[0], stats[1]
        p1 = self.rest + np.where(known, before - self.d1[np.minimum(before, 3)], 0) / max(1, m["bigrams"])
        g2 = np.where(mass > 0, self.d2[1:] @ stats[2:] / np.maximum(mass, 1), 1.0)
        spread = np.maximum(1, -(-often // m["hot"]))
        w = at
        u, v = grams(w, counts, len(ids) - 1)
        prob = g2[v] * p1[w]
        if m["total"]:
            key = lambda *xs: [ids[x].astype(np.uint64) for x in xs]
            # bigrams
            ask = np.flatnonzero((mass[v] > 0) & known[w])
            x, y = key(v[ask], w[ask])
            n = self.rows("bigrams", pair_key(x, y), file_of(x, x, np.ones(len(x), np.int64), m["n_files"]), spread[v[ask]] > 1)[0]
            prob[ask] += (n - self.d2[np.minimum(n, 3)]) / mass[v[ask]]
            # contexts, and trigrams where the context goes on
            ask = np.flatnonzero(known[u] & known[v])
            x, y = key(u[ask], v[ask])
            context = pair_key(x, y)
            c, *kinds = self.rows("contexts", context, file_of(y, y, np.ones(len(y), np.int64), m["n_files"]), spread[v[ask]] > 1)
            on = np.flatnonzero(c > 0)
            ask, context, c, kinds = ask[on], context[on], c[on], np.stack(kinds)[:, on]
            prob[ask] *= self.d3[1:] @ kinds / c
            seen = np.flatnonzero(known[w[ask]])
            ask, context, c = ask[seen], context[seen], c[seen]
            y, z = key(v[ask], w[ask])
            three = pair_key(context, z)
            n = self.rows("trigrams", three, file_of(y, three, spread[v[ask]], m["n_files"]), np.zeros(len(three), bool))[0]
            prob[ask] += (n - self.d3[np.minimum(n, 3)]) / c
        base = np.log10((often[w] + 1) / (m["total"] + m["size"] + 1))
        first = np.cumsum(counts) - counts
        each = lambda x: np.add.reduceat(x, first) if len(first) else x
        return each((often[w] > 0).astype(np.int64)), each(base), each(np.log10(prob))


def by_part(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of it)."""
    order = in_turn(parts)
    cuts = np.flatnonzero(np.concatenate(([True], parts[order][1:] != parts[order][:-1], [True]))) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(parts[order[a]]), order[a:b]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from documents whose crc32(id as text) mod 7 is not 2 (a null id learns too).
    Tokens are words split at ASCII white space after lower-casing A-Z, and one end; null texts are
    empty and score their end. Without training rows the unknown token has probability one.
    Repeated rows count and score each; other columns are not read.
    N-grams are told apart by 48 bits of their hash within a file of some two million.
    """
    out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(HELD_OUT_MOD)) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    m = fitted(rows.filter("not held_out").select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(m)
        for piece, hashes, counts in pieces(batches, 2):
            known, base, own = model.scores(hashes, counts)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(counts), pa.array(known), pa.array(np.full(len(counts), m["total"])), pa.array(base), pa.array(own)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)
