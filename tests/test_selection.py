"""Rank selection: deep pages equal a full sort, and only a bounded range is sorted."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import make
from scanloom.operators import ranges, selection


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_deep_page_sorts_one_range_only(spark):
    size = 2_000_000  # 7919 is prime to 2,000,000: depths are 0 .. size - 1 once each, in a scrambled order
    df = spark.range(size).select((F.col("id") * 7919 % size).cast("double").alias("depth"), F.col("id"))
    page = ranges.depth_page(df, 100, 1_000_000, ("depth", "id"))
    assert [r.depth for r in page.collect()] == [float(k) for k in range(1_000_000, 1_000_100)]
    kept = [int(n) for n in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan(page))]
    assert kept and max(kept) <= selection.SORTED_AT_MOST + 100  # no task keeps the million rows before the page


@pytest.mark.parametrize("offset", [0, 3, 9_990, 10_500, 19_990, 29_999, 40_000])
def test_pages_with_ties_and_nulls_equal_a_full_sort(spark, offset, monkeypatch):
    monkeypatch.setattr(selection, "SORTED_AT_MOST", 500)
    monkeypatch.setattr(selection, "DIRECT", 0)
    rows = [(None if k % 97 == 0 else float(k % 1_000 if k < 20_000 else 7), k) for k in range(30_000)]
    df = make(spark, rows, "depth double, o_orderkey long")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[offset : offset + 10]
    got = selection.ranked_slice(df, ("depth", "o_orderkey"), offset, 10).collect()
    assert [(r.depth, r.o_orderkey) for r in got] == want


def test_small_tables_and_text_keys(spark, monkeypatch):
    monkeypatch.setattr(selection, "DIRECT", 0)
    df = make(spark, [(float(k),) for k in (5, 1, 3)], "depth double")
    assert [r.depth for r in selection.ranked_slice(df, ("depth",), 1, 5).collect()] == [3.0, 5.0]
    assert selection.ranked_slice(df.where("false"), ("depth",), 0, 5).count() == 0
    words = make(spark, [(w,) for w in "d a c b".split()], "w string")
    assert [r.w for r in selection.ranked_slice(words, ("w",), 1, 2).collect()] == ["b", "c"]
