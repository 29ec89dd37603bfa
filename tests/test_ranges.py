import random

import pytest

from conftest import make
from scanloom.operators import numbering, ranges, reports


def depths(spark, values):
    return make(spark, [(float(v),) for v in values], "depth double")


def listed(df):
    return [r.depth for r in df.collect()]


def test_bounds(spark):
    df = depths(spark, [100, 150, 200, 250, 300])
    assert sorted(listed(ranges.depth_range(df, 150, 250))) == [150, 200, 250]
    assert ranges.depth_range(df, None, 150).count() == 2
    assert ranges.depth_range(df, 150).count() == 4
    assert ranges.depth_range(df).count() == 5
    close = depths(spark, [0, 100.5, 200, 999.9])
    for low, high in ((0, 0.1), (100.4, 100.6), (100.5, 100.5)):
        assert ranges.depth_range(close, low, high).count() == 1
    assert listed(ranges.depth_lookup(close, 100.5)) == [100.5]
    assert listed(ranges.depth_lookup(close, 100.6)) == []


def test_pages(spark):
    df = depths(spark, [300, 100, 200, 150, 250])
    assert listed(ranges.depth_page(df)) == [100, 150, 200, 250, 300]
    assert listed(ranges.depth_page(df, 2, 2)) == [200, 250]
    assert ranges.count_frames(depths(spark, range(1000)), 400, 600).collect()[0].frames == 201


@pytest.mark.parametrize("offset, count, more", [(0, 10, True), (20, 10, True), (40, 10, False), (45, 5, False), (50, 0, False)])
def test_page_metadata(spark, offset, count, more):
    df = depths(spark, range(50))
    page = ranges.page_has_more(df, limit=10, offset=offset).collect()
    assert len(page) == count and all(r.has_more == more for r in page)
    (meta,) = ranges.page_metadata(df, limit=10, offset=offset).collect()
    extent = (float(offset), float(offset + count - 1)) if count else (None, None)
    assert (meta["count"], meta.total, meta.depth_min, meta.depth_max) == (count, None, *extent)
    assert (meta.limit, meta.offset, meta.has_more) == (10, offset, more)


@pytest.mark.parametrize(
    "request_",
    [
        {"limit": 0},
        {"limit": 1001},
        {"limit": -1},
        {"offset": -1},
        {"depth_min": 200.0, "depth_max": 100.0},
        {"depth_min": -1.0},
        {"depth_max": -0.5},
        {"depth_min": float("nan")},
    ],
)
def test_refused_requests(spark, request_):
    df = depths(spark, [1])
    for read in (ranges.page_has_more, ranges.page_metadata):
        with pytest.raises(ValueError):
            read(df, **request_)


@pytest.mark.parametrize("values", [[], [100.5], [100, 250, 150, 300, 200]])
def test_extent(spark, values):
    expected = (float(min(values)), float(max(values))) if values else (None, None)
    (got,) = ranges.depth_extent(depths(spark, values)).collect()
    assert (got.depth_min, got.depth_max) == expected
    (got,) = ranges.store_metrics(depths(spark, values)).collect()
    assert (got.total_frames, got.depth_min, got.depth_max) == (len(values), *expected)


def test_walk_is_ordered_disjoint_and_complete(spark):
    pages = ranges.page_walk(depths(spark, random.Random(1).sample(range(50), 50)), 10).orderBy("row_no").collect()
    assert [r.depth for r in pages] == [float(k) for k in range(50)]
    assert [r.row_no for r in pages] == list(range(1, 51))
    assert [r.page_no for r in pages] == [k // 10 for k in range(50)]


def test_row_numbers_with_a_key_that_fills_a_third(spark):
    rng = random.Random(5)
    rows = [(5.0 if k % 3 == 0 else rng.random() * 10, k) for k in range(6000)]
    df = make(spark, rows, "depth double, tie long").repartition(7)
    got = numbering.number_rows(df, "depth", "tie").orderBy("row_no").collect()
    assert [(r.depth, r.tie) for r in got] == sorted(rows)
    assert [r.row_no for r in got] == list(range(1, 6001))


def test_running_totals_across_blocks(spark):
    batches = [(k, 3 + k % 4, k % 3) for k in range(2500)]
    df = make(spark, batches, "batch_no long, rows long, failed long")
    rows, failed, every = 0, 0, sum(b[1] for b in batches)
    got = reports.running_totals(df).orderBy("batch_no").collect()
    assert len(got) == 2500
    for r, (no, n, f) in zip(got, batches):
        rows, failed = rows + n, failed + f
        assert (r.batch_no, r.total_rows, r.total_failed, r.total_stored) == (no, rows, failed, rows - failed)
        assert r.percent_done == pytest.approx(100 * rows / every, abs=0.0501)
