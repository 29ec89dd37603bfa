import re
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import make
from scanloom.operators import keyed
from scanloom.sources.frame_table import TASK_BYTES, FrameTable, StaleVersionError, write_tasks

T1 = datetime(2024, 1, 1, tzinfo=timezone.utc)
T2 = datetime(2024, 2, 1, tzinfo=timezone.utc)
T3 = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = "depth double, image_png binary, width int, height int, ord long"


def frames(spark, *rows):
    """Rows of (depth, image) or (depth, image, width, height), in order."""
    full = [(*r, 150, 1) if len(r) == 2 else r for r in rows]
    return make(spark, [(float(d), bytearray(i), w, h, k) for k, (d, i, w, h) in enumerate(full)], SCHEMA)


def held(table):
    """{depth: (image, width, height, created month, updated month)}"""
    month = lambda c: F.month(c)
    rows = table.read().select("*", month("created_at").alias("c"), month("updated_at").alias("u")).collect()
    assert len({r.depth for r in rows}) == len(rows)
    return {r.depth: (bytes(r.image_png), r.width, r.height, r.c, r.u) for r in rows}


@pytest.fixture
def table(spark, tmp_path):
    return FrameTable(spark, str(tmp_path / "frames"), zone_width=50.0)


def test_insert_then_replace(spark, table):
    table.upsert(frames(spark, (100, b"a"), (101, b"b")), "one", now=T1)
    table.upsert(frames(spark, (101, b"new", 200, 2), (102, b"c")), "two", now=T2)
    assert held(table) == {
        100.0: (b"a", 150, 1, 1, None),
        101.0: (b"new", 200, 2, 1, 2),
        102.0: (b"c", 150, 1, 2, None),
    }


def test_created_stays_and_updated_moves(spark, table):
    for load, now in (("a", T1), ("b", T2), ("c", T3)):
        table.upsert(frames(spark, (100.5, b"same")), load, now=now)
    assert held(table) == {100.5: (b"same", 150, 1, 1, 3)}


def test_last_row_of_a_load_wins_and_counts_as_update(spark, table):
    rows = frames(spark, (1, b"x"), (2, b"y"), (1, b"z"))
    table.upsert(rows, "a", order=F.col("ord"), now=T1)
    assert held(table) == {1.0: (b"z", 150, 1, 1, 1), 2.0: (b"y", 150, 1, 1, None)}


def test_repeats_need_an_order(spark, table):
    with pytest.raises(ValueError, match="more than once"):
        table.upsert(frames(spark, (1, b"x"), (1, b"z")), "a", now=T1)
    assert held(table) == {}


def test_a_load_name_seen_before_loads_again(spark, table):
    table.upsert(frames(spark, (1, b"x")), "a", now=T1)
    table.upsert(frames(spark, (1, b"other")), "a", now=T2)
    assert held(table) == {1.0: (b"other", 150, 1, 1, 2)}


def test_a_writers_step_is_done_once(spark, table):
    table.upsert(frames(spark, (1, b"x")), "a", now=T1, writer=("w", 0))
    table.upsert(frames(spark, (1, b"other")), "a", now=T2, writer=("w", 0))
    table.upsert(frames(spark, (2, b"y")), "a", now=T2, writer=("v", 0))
    assert held(table) == {1.0: (b"x", 150, 1, 1, None), 2.0: (b"y", 150, 1, 2, None)}


@pytest.mark.parametrize("name", ["run=5", "run#1", "a%b", "2024-06-01T10:00", "a/b", "{*}[x]", ""])
def test_any_load_name(spark, table, name):
    table.upsert(frames(spark, (1, b"a"), (2, b"b"), (60, b"c")), name, now=T1)
    table.upsert(frames(spark, (2, b"new"), (61, b"d"), (3, b"e")), name, now=T2)
    assert {d: v[0] for d, v in held(table).items()} == {1.0: b"a", 2.0: b"new", 3.0: b"e", 60.0: b"c", 61.0: b"d"}


def test_a_stale_merge_raises_and_changes_nothing(spark, table, tmp_path):
    table.upsert(frames(spark, (1, b"a"), (2, b"b")), "a", now=T1)
    stale = table.version()
    table.upsert(frames(spark, (3, b"c")), "b", now=T1)
    staged = frames(spark, (2, b"late"))
    with pytest.raises(StaleVersionError):
        table.merge_staged(staged, F.col("ord"), "c", stale, 0, T2)
    assert {d: v[0] for d, v in held(table).items()} == {1.0: b"a", 2.0: b"b", 3.0: b"c"}


@pytest.mark.parametrize("row", [(None, b"x"), (float("nan"), b"x"), (1.0, None)])
def test_frames_without_depth_or_image_raise(spark, table, row):
    rows = make(spark, [(row[0], row[1] and bytearray(row[1]), 1, 1)], "depth double, image_png binary, width int, height int")
    with pytest.raises(Exception, match="a frame needs"):
        table.upsert(rows, "a", now=T1)
    assert held(table) == {}


def test_the_log_is_one_file_per_version_and_stays_short(spark, table):
    for k in range(25):
        table.clear(f"c{k}")
    names = [p.name for p in (Path(table.root) / "log").glob("*.json")]
    assert max(names) == f"{25:012d}.json" and len(names) <= 21


def test_empty_upsert_changes_nothing(spark, table):
    table.upsert(frames(spark, (1, b"x")), "a", now=T1)
    table.upsert(frames(spark).where("false"), "b", now=T2)
    assert held(table) == {1.0: (b"x", 150, 1, 1, None)}


def test_untouched_zones_keep_their_files(spark, table):
    table.upsert(frames(spark, (10, b"x"), (60, b"y"), (-5, b"n")), "a", now=T1)
    table.upsert(frames(spark, (61, b"z")), "b", now=T2)
    gens = {r.zone: r.gen for r in table.zones().collect()}
    assert gens[-1] == gens[0] != gens[1]
    assert sorted(held(table)) == [-5.0, 10.0, 60.0, 61.0]


def test_range_read_opens_only_zones_in_reach(spark, table):
    table.upsert(frames(spark, *[(d, b"x") for d in range(0, 300, 5)]), "a", now=T1)
    part = table.read(100, 149)
    assert sorted(r.depth for r in part.collect()) == [float(d) for d in range(100, 150, 5)]
    assert {f.split("zone=")[1].split("/")[0] for f in part.inputFiles()} == {"2"}
    assert table.read(1000).count() == 0


@pytest.mark.parametrize("low, high", [(None, None), (12, None), (12, 222), (60, 99)])
@pytest.mark.parametrize("offset", [0, 3, 20, 47, 1000])
def test_pages_open_only_their_zones(spark, table, low, high, offset):
    depths = [float(d) for d in range(0, 300, 5)]
    table.upsert(frames(spark, *[(d, b"x") for d in depths]), "a", now=T1)
    page = table.page(10, offset, low, high)
    inside = [d for d in depths if (low is None or d >= low) and (high is None or d <= high)]
    assert [r.depth for r in page.collect()] == inside[offset : offset + 10]
    assert len(page.inputFiles()) <= 2


def test_a_page_far_down_keeps_few_rows(spark, table):
    wide = spark.range(60_000).selectExpr("CAST(id AS DOUBLE) AS depth", "encode('x', 'UTF-8') AS image_png", "1 AS width", "1 AS height")
    table.upsert(wide, "a", now=T1)
    page = table.page(10, 59_930)
    assert page.agg(F.min("depth"), F.count("*")).first()[:] == (59_930.0, 10)
    limits = re.findall(r"limit=([0-9]+)|Limit ([0-9]+)", page._jdf.queryExecution().executedPlan().toString())
    assert limits and max(int(a or b) for a, b in limits) <= 60


def test_extreme_depths(spark, table):
    table.upsert(frames(spark, (float("inf"), b"i"), (-float("inf"), b"j"), (1e300, b"k")), "a", now=T1)
    assert sorted(held(table)) == [-float("inf"), 1e300, float("inf")]
    assert table.read(float("inf")).count() == 1


def test_delete(spark, table):
    table.upsert(frames(spark, (100.5, b"a"), (200, b"b")), "a", now=T1)
    keys = make(spark, [(100.5,), (999.9,), (201.0,)], "depth double")
    before = {r.zone: r.gen for r in table.zones().collect()}
    report = table.delete(keys, "d")
    assert {r.zone: r.gen for r in table.zones().collect()} == {4: before[4]}
    assert {r.depth: r.deleted for r in report.collect()} == {100.5: True, 201.0: False, 999.9: False}
    assert sorted(held(table)) == [200.0]
    (metrics,) = table.metrics().collect()
    assert tuple(metrics) == (1, 200.0, 200.0)


def test_clear_and_refill(spark, table):
    table.upsert(frames(spark, (1, b"a"), (99, b"b")), "a", now=T1)
    table.clear("c")
    assert held(table) == {}
    assert tuple(table.metrics().collect()[0]) == (0, None, None)
    table.upsert(frames(spark, (1, b"n")), "b", now=T2)
    assert held(table) == {1.0: (b"n", 150, 1, 2, None)}


def test_metrics_equal_a_scan(spark, table):
    table.upsert(frames(spark, *[(d, b"x") for d in range(7, 507, 3)]), "a", now=T1)
    table.upsert(frames(spark, *[(d, b"y") for d in range(0, 100)]), "b", now=T2)
    (got,) = table.metrics().collect()
    (scan,) = table.read().agg(F.count("*"), F.min("depth"), F.max("depth")).collect()
    assert tuple(got) == tuple(scan)


def test_reopened_table_keeps_its_zone_width(spark, table):
    table.upsert(frames(spark, (1, b"a")), "a", now=T1)
    again = FrameTable(spark, table.root, zone_width=7.0)
    assert again.zone_width == 50.0 and held(again) == held(table)
    with pytest.raises(ValueError):
        FrameTable(spark, table.root + "-x", zone_width=0)


def test_a_failed_load_leaves_nothing_visible(spark, table):
    table.upsert(frames(spark, (1, b"a")), "a", now=T1)
    broken = frames(spark, (1, b"b")).withColumn("width", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception):
        table.upsert(broken, "b", now=T2)
    assert held(table) == {1.0: (b"a", 150, 1, 1, None)}
    table.upsert(frames(spark, (1, b"b")), "b", now=T2)
    assert held(table) == {1.0: (b"b", 150, 1, 1, 2)}


def test_a_load_cut_off_before_its_log_entry_is_repeated_cleanly(spark, table, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(FrameTable, "_append_log", lambda *_: (_ for _ in ()).throw(RuntimeError("cut off")))
        with pytest.raises(RuntimeError):
            table.upsert(frames(spark, (1, b"a"), (2, b"b")), "a", now=T1)
    assert held(table) == {}
    table.upsert(frames(spark, (1, b"a"), (2, b"b")), "a", now=T2)
    assert held(table) == {1.0: (b"a", 150, 1, 2, None), 2.0: (b"b", 150, 1, 2, None)}


def test_one_depth_holding_a_third_of_all_rows(spark):
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("depth"),
        F.encode(F.col("id").cast("string"), "UTF-8").alias("image_png"),
        F.lit(1).alias("width"),
        F.lit(1).alias("height"),
        "id",
    )
    last = keyed.last_wins(rows, F.col("id"))
    assert last.count() == 20000
    (hot,) = last.where("depth = 7").collect()
    assert (bytes(hot.image_png), hot.times_seen) == (b"29997", 10001)


def test_write_tasks():
    assert write_tasks(0, 0, 8) == 1
    assert write_tasks(1000, 1000, 8) == 1
    assert write_tasks(100_000, 10**6, 8) == 5
    assert write_tasks(10**6, TASK_BYTES, 8) == 8
    assert write_tasks(10**9, TASK_BYTES * 10**6, 8) == 10**6
