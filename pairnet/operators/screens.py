"""Bloom filters as tables: a semi-join that may let a few rows too many pass
and never loses one, for the side of a join that is large and mostly unmatched.

A filter is a run of 64-bit words, cut into blocks of 512. A key's hash names
its word, and all its bits lie in that one, so a test is one lookup and one
comparison. The blocks are built by a distributed aggregate (bits are or-ed
map-side), and the table is broadcast only when its size, known from the
number of keys before it is built, is at most ``MAX_FILTER_BYTES``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairnet.session import checkpoint

WORDS = 512
BITS_PER_KEY, HASHES = 16, 4
#: A larger filter isn't built: ``screened`` then returns its rows as they are.
MAX_FILTER_BYTES = 64 << 20


def filter_blocks(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    """Blocks of a filter for so many distinct keys."""
    return max(1, math.ceil(keys * bits_per_key / (64 * WORDS)))


def _place(key: Sequence[Column], blocks: int) -> Column:
    """The word of a key, counted through all blocks. Never NULL, and known
    not to be: the optimizer would otherwise add a filter for it below the
    key's expressions and so compute these twice a row."""
    return F.coalesce(F.pmod(F.xxhash64(*key), F.lit(blocks * WORDS)), F.lit(0).cast("long"))


def _mask(key: Sequence[Column], hashes: int) -> Column:
    """The bits of a key in its word: six bits of a second hash for each."""
    h = F.xxhash64(F.lit(1), *key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(hashes)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def bloom_table(df: DataFrame, key: Sequence[Column], blocks: int, hashes: int = HASHES) -> DataFrame:
    """``_block``, ``_words`` (512 longs): the filter of all keys of ``df``."""
    own = df.select(_place(key, blocks).alias("_at"), _mask(key, hashes).alias("_mask"))
    # Every word once more, empty, so that each block has them all.
    empty = df.sparkSession.range(blocks * WORDS).select(F.col("id").alias("_at"), F.lit(0).cast("long").alias("_mask"))
    words = own.unionByName(empty).groupBy("_at").agg(F.bit_or("_mask").alias("_mask"))
    # WORDS rows a block.
    return words.groupBy(F.shiftright("_at", 9).alias("_block")) \
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_mask")))["_mask"].alias("_words"))


def screened(df: DataFrame, key: Sequence[Column], keys: DataFrame, keys_key: Sequence[Column], count: int | None = None,
             max_bytes: int = MAX_FILTER_BYTES, bits_per_key: int = BITS_PER_KEY, hashes: int = HASHES) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among the keys of ``keys``: all that
    are, and less than one in 100 of the others.

    ``count``: an upper bound of the distinct keys (else the rows of ``keys``
    are counted). No row is shuffled: the filter is broadcast, or, if it would
    be larger than ``max_bytes``, ``df`` is returned as it is. ``keys`` is read
    once more, so it should be a written table. A NULL key is one like others."""
    n = keys.count() if count is None else count
    blocks = filter_blocks(n, bits_per_key)
    if blocks * WORDS * 8 > max_bytes:
        return df
    table = F.broadcast(checkpoint(bloom_table(keys, keys_key, blocks, hashes), "bloom"))
    own = "_"
    while any(c.startswith(own) for c in df.columns):
        own += "_"
    block, word, mask, words = (f"{own}{c}" for c in ("block", "word", "mask", "words"))
    at = _place(key, blocks)
    hashed = df.withColumns({block: F.shiftright(at, 9), word: at.bitwiseAND(F.lit(WORDS - 1)).cast("int"),
                             mask: _mask(key, hashes)})
    held = F.get(F.col(words), F.col(word))
    return hashed.join(table.toDF(block, words), block).where(held.bitwiseAND(F.col(mask)) == F.col(mask)) \
        .select(*[F.col(f"`{c}`") for c in df.columns])
