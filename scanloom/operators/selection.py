"""Rows at given ranks of an order, without sorting everything before them.

A page deep inside a table (``offset`` of millions) by ``orderBy().offset().limit()`` makes every task keep its first
``offset + limit`` rows and one task merge them all. Rank selection avoids that: splitters taken from the first sort
column (``approxQuantile``, a bounded sketch) cut the rows into ranges, one aggregation counts the rows below each
splitter exactly, and only the range that holds the wanted ranks is kept for the next round. Each round reads the one
sort column, and its bounds reach the Parquet scan as pushed filters. When the range holds at most ``SORTED_AT_MOST``
rows, or cannot be cut further because its rows share one key, its rows are sorted and the page taken from them.
Ranks stay exact: splitters only choose the range, the counts place it.

Nulls of the first sort column come first (Spark's ascending order) and are one block of their own. A first sort
column that is not numeric is sorted directly, as are pages that end within ``DIRECT`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Splitters per round: a round narrows the range about this many times.
SPLITTERS = 64
#: A range of at most so many rows is sorted for its page.
SORTED_AT_MOST = 50_000
#: Pages that end before this rank are taken by a bounded sort in each task.
DIRECT = 10_000


def _between(key: Column, low, high) -> Column:
    condition = key.isNotNull()
    if low is not None:
        condition &= key >= F.lit(low)
    if high is not None:
        condition &= key < F.lit(high)
    return condition


def key_range(df: DataFrame, first: str, start: int, stop: int) -> tuple[Column, int]:
    """A condition on ``first`` that holds all rows of ranks ``start`` to ``stop - 1`` (from 0, ascending, nulls
    first), and the number of rows that come before the rows it keeps."""
    key = F.col(first)
    nulls, values = df.agg(F.count_if(key.isNull()), F.count(key)).first()
    if stop <= nulls:
        return key.isNull(), 0
    low = high = None
    before, inside = nulls, values
    with_nulls, start = start < nulls, max(start, nulls)
    while inside > SORTED_AT_MOST:
        window = df.where(_between(key, low, high))
        splitters = sorted(set(window.approxQuantile(first, [k / SPLITTERS for k in range(1, SPLITTERS)], 0.25 / SPLITTERS)))
        splitters = [s for s in splitters if (low is None or s > low) and (high is None or s < high)]
        if not splitters:
            break  # one key fills the range
        below = window.agg(*[F.count_if(key < F.lit(s)) for s in splitters]).first()
        new_low, new_high, new_before, under_high = low, high, before, before + inside
        for s, n in zip(splitters, below):
            if before + n <= start:
                new_low, new_before = s, before + n
            if before + n >= stop and new_high == high:
                new_high, under_high = s, before + n
        if (new_low, new_high) == (low, high):
            break
        low, high, before, inside = new_low, new_high, new_before, under_high - new_before
    condition = _between(key, low, high)
    if with_nulls:  # then no value lies below ``low``: the page starts among the nulls
        return condition | key.isNull(), 0
    return condition, before


def ranked_slice(df: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit - 1`` of ``df`` ordered by ``order`` ascending, as ``offset().limit()``."""
    first = order[0]
    if offset + limit <= DIRECT or not isinstance(df.schema[first].dataType, T.NumericType):
        return df.orderBy(*order).offset(offset).limit(limit)
    condition, before = key_range(df, first, offset, offset + limit)
    return df.where(condition).orderBy(*order).offset(offset - before).limit(limit)
