"""A filter of an index's hashes: a bit map of bounded size that says of most other hashes that they are not there.

Filters of two indexes of one size merge by a bitwise or of their words. A hash sets two bits, named by
its lowest and its highest bits; hashes of the index are a bijective mix of k-mers, so these are as good
as random. A hash without both bits is in no key; one with both may be.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each key, and its least and greatest size (as a power of two): 16 MB at most, whatever the index holds. A filter that is too small for its index lets more pass; results do not change.
PER_KEY, LEAST, MOST = 8, 12, 27


def size_for(keys: int, hash_bits: int) -> int:
    return max(6, min(max(LEAST, (PER_KEY * max(1, keys) - 1).bit_length()), MOST, hash_bits))


def presence(keys: DataFrame, bits: int, hash_bits: int) -> DataFrame:
    """(word, bits): the words of the filter that are not zero. Words are put together before the shuffle."""
    low = F.col("hash").bitwiseAND((1 << bits) - 1)
    high = F.shiftrightunsigned("hash", max(0, hash_bits - bits))
    at = keys.select(F.explode(F.array(low, high)).alias("at"))
    return at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))


def bit_words(filter_rows: DataFrame, bits: int) -> np.ndarray:
    """The filter as an array, for the workers: its size is bounded by ``MOST``."""
    rows = filter_rows.toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words


def may_hold(words: np.ndarray, h: np.ndarray, hash_bits: int) -> np.ndarray:
    """Which hashes may be in the index."""
    bits = len(words).bit_length() - 1 + 6
    u = np.uint64
    has = lambda at: (words[(at >> u(6)).astype(np.int64)] >> (at & u(63)) & u(1)).astype(bool)
    return has(h & u((1 << bits) - 1)) & has(h >> u(max(0, hash_bits - bits)))
