"""Marks of a large set of keys: rows whose key cannot be in the set are left out where they lie, without a shuffle.

The keys' hashes set bits of a bitmap of fixed size, small enough to broadcast whatever the size of the set. A key of
the set always finds its bit; another key may find one too, the more often the fuller the bitmap. So a marked row may
still belong to no key of the set, an unmarked one never does: what follows must test the keys themselves and gets the
same result, from fewer rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bitmap has 2^BITS bits (16 MB), in rows of 2^ROW_BITS words of 64 bits.
BITS = 27
ROW_BITS = 9


def _bit(*keys: str) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << BITS) - 1))


def marks_of(hashes: DataFrame) -> DataFrame:
    """The bitmap, ``place, words``, of the one column of ``hashes``, made by ``xxhash64`` of the keys."""
    bit = F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << BITS) - 1))
    some = hashes.select(bit.alias("bit")).selectExpr("shiftright(bit, 6) AS word", "shiftleft(1L, CAST(bit & 63 AS INT)) AS bits")
    none = hashes.sparkSession.range(1 << (BITS - 6)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = some.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = words.groupBy(F.shiftright("word", ROW_BITS).alias("place")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return rows.select("place", F.col("words.bits").alias("words"))


def marked(rows: DataFrame, marks: DataFrame, flag: str, *keys: str) -> DataFrame:
    """``rows`` and a column ``flag``: whether the bit of their ``keys`` is set. Null keys hash as well as others."""
    own = rows.columns
    at = F.col("_bit")
    found = F.getbit(F.col("_words")[F.shiftright(at, 6).bitwiseAND(F.lit((1 << ROW_BITS) - 1)).cast("int")], at.bitwiseAND(F.lit(63)).cast("int"))
    return (
        rows.select("*", _bit(*keys).alias("_bit"))
        .join(F.broadcast(marks.toDF("_place", "_words")), F.shiftright(at, 6 + ROW_BITS) == F.col("_place"))
        .select(*own, (found == 1).alias(flag))
    )
