"""Scalar expressions: bases, k-mers, hashes, packed words, coordinates, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Offset that keeps forward diagonals positive.
DIAGONAL = 1 << 21
#: Bits of a position within a target, in words that hold target and position.
TARGET_BITS = 30
U32 = (1 << 32) - 1


def bases(text: Column, breaks: str = "") -> Column:
    """A text as bases: letters a-z in any ASCII case become A, C, G, T in turn, characters in ``breaks`` become N, the rest goes."""
    low = F.translate(text, ALPHABET.upper(), ALPHABET)
    kept = F.regexp_replace(low, f"[^a-z{breaks}]", "")
    return F.translate(kept, ALPHABET + breaks, ("ACGT" * 7)[:26] + "N" * len(breaks))


def encode(base: Column, dialect: str = "host") -> Column:
    """Code of a base: A 0, C 1, T 2, G 3; 4 and more are ambiguous. The device dialect knows only N as ambiguous."""
    if dialect == "device":
        return F.when(base == "N", 7).otherwise(F.shiftright(F.ascii(base).bitwiseAND(7), 1).bitwiseAND(3))
    return F.shiftright(F.ascii(base).bitwiseAND(15), 1)


def complement(code: Column) -> Column:
    return code.bitwiseXOR(2)


def kmer(digits: Column) -> Column:
    """Number of a string of base codes."""
    return F.conv(digits, 4, 10).cast("bigint")


def canonical(forward: Column, reverse: Column) -> tuple[Column, Column]:
    """(smaller of both, 1 if that is the reverse); null for palindromes."""
    same = forward == reverse
    return F.when(~same, F.least(forward, reverse)), F.when(~same, (forward > reverse).cast("int"))


def hash_steps(k: int) -> list:
    """Steps of an invertible mix of a 2k-bit number. Left shifts are masked first, so that nothing overflows."""
    mask = (1 << 2 * k) - 1
    left = lambda y, n: F.shiftleft(y.bitwiseAND(mask >> n), n)
    return [
        lambda x: (x.bitwiseXOR(mask) + left(x, 21)).bitwiseAND(mask), lambda x: x.bitwiseXOR(F.shiftright(x, 24)), lambda x: (x * 265).bitwiseAND(mask), lambda x: x.bitwiseXOR(F.shiftright(x, 14)),
        lambda x: (x * 21).bitwiseAND(mask), lambda x: x.bitwiseXOR(F.shiftright(x, 28)), lambda x: (x + left(x, 31)).bitwiseAND(mask),
    ]


def hash64(x: Column, k: int) -> Column:
    """Mix of a 2k-bit number as one expression, for plain columns: ``x`` is written out many times in it."""
    for step in hash_steps(k):
        x = step(x)
    return x


def with_hash(df: DataFrame, col: str, k: int) -> DataFrame:
    """``df`` with the column mixed, a projection for each step, so that whatever made the column is evaluated once."""
    for step in hash_steps(k):
        df = df.withColumn(col, step(F.col(col)))
    return df


def bucket_id(h: Column, bits: int) -> Column:
    return h.bitwiseAND((1 << bits) - 1)


def seed_id(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, bits)


def pack_key(loc: Column, chrom: Column, strand: Column, seed: Column) -> Column:
    """Index word: position in bits 0-31, target 32-41, strand 42, seed id above."""
    word = loc.cast("bigint").bitwiseOR(F.shiftleft(chrom.cast("bigint"), 32))
    return word.bitwiseOR(F.shiftleft(strand.cast("bigint"), 42)).bitwiseOR(F.shiftleft(seed.cast("bigint"), 43))


def unpack_key(word: Column) -> dict[str, Column]:
    return {"loc": word.bitwiseAND(U32), "chrom_id": F.shiftright(word, 32).bitwiseAND(1023), "str": F.shiftright(word, 42).bitwiseAND(1), "seed_id": F.shiftrightunsigned(word, 43)}


def pack_anchor(chrom: Column, diag: Column, q: Column, strand: Column) -> Column:
    """Anchor word; words order as (target, diagonal, query position, strand)."""
    word = F.shiftleft(chrom.cast("bigint"), 53).bitwiseOR(F.shiftleft(diag.cast("bigint"), 23))
    return word.bitwiseOR(F.shiftleft(q.cast("bigint"), 1)).bitwiseOR(strand.cast("bigint"))


def unpack_anchor(word: Column) -> dict[str, Column]:
    return {"target": F.shiftrightunsigned(word, 23), "q_loc": F.shiftright(word, 1).bitwiseAND((1 << 22) - 1), "str": word.bitwiseAND(1)}


def diagonal(t: Column, q: Column, strand: Column) -> Column:
    return F.when(strand == 1, t + q).otherwise(t - q + DIAGONAL)


def target_position(diag: Column, q: Column, strand: Column) -> Column:
    """Inverse of ``diagonal``."""
    return F.when(strand == 1, diag - q).otherwise(diag + q - DIAGONAL)


def chrom_of(word: Column) -> Column:
    return F.shiftright(word, TARGET_BITS)


def position_of(word: Column) -> Column:
    return word.bitwiseAND((1 << TARGET_BITS) - 1)


def threshold(share: float, of: Column) -> Column:
    """Whole part of a product in 32-bit floating point."""
    return (F.lit(share).cast("float") * of.cast("float")).cast("int")


def span_difference(q_start: Column, q_end: Column, t_start: Column, t_end: Column) -> Column:
    return F.abs((q_end - q_start) - (t_end - t_start))


def mapq(best: Column, second: Column) -> Column:
    """Mapping quality from the best score and the second (null: there is none)."""
    share = 1 - F.coalesce(second, F.lit(0)).cast("double") / best.cast("double")
    return F.least(F.lit(60), (share * F.ln(best.cast("double")) * F.least(best, F.lit(40)).cast("double")).cast("int"))


def strand_sign(strand: Column) -> Column:
    return F.when(strand == 1, "-").otherwise("+")


def unsigned32(x: Column) -> Column:
    """A difference as the 32-bit unsigned number it wraps to."""
    return x.cast("bigint").bitwiseAND(U32)


def name_of(header: Column) -> Column:
    """A record's name: its header up to a space or the line's end."""
    return F.substring_index(F.substring_index(header, "\n", 1), " ", 1)
