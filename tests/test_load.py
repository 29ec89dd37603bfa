from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from conftest import ramp
from scanloom.functions import png
from scanloom.functions.palette import palette
from scanloom.operators import reports
from scanloom.plans.load import reload_frames
from scanloom.sources.frame_table import FrameTable
from scanloom.streaming.ingest import stream_batch_metrics, stream_ingest
from test_frame_table import frames, held
from test_pixels import resized

T1 = datetime(2024, 1, 1, tzinfo=timezone.utc)
T2 = datetime(2024, 2, 1, tzinfo=timezone.utc)


@pytest.fixture
def table(spark, tmp_path):
    return FrameTable(spark, str(tmp_path / "frames"), zone_width=100.0)


def test_whole_load(spark, table, write_lines):
    path = write_lines([[100, *ramp()], [200, *ramp(start=50)]])
    report = reload_frames(spark, table, path, "one", now=T1)
    got = held(table)
    colours = palette()
    for depth, start in ((100.0, 0), (200.0, 50)):
        expected = [list(colours[g]) for g in resized(ramp(start=start), 150)]
        assert png.decode(got[depth][0]).tolist() == [expected]
        assert got[depth][1:] == (150, 1, 1, None)
    (status,) = report.status.collect()
    assert (status.status, status.message) == ("success", "Successfully ingested 2 frames")


def test_partial_load(spark, table, write_lines):
    path = write_lines([[100, *ramp(8)], [200, "abc", *ramp(7)], [300, *ramp(8)]], 8)
    report = reload_frames(spark, table, path, "one", 8, 6, now=T1)
    assert sorted(held(table)) == [100.0, 300.0]
    (summary,) = report.summary.collect()
    assert (summary.rows_read, summary.rows_stored, summary.rows_failed) == (3, 2, 1)
    assert (summary.batches, summary.batch_size, summary.source_width, summary.target_width) == (1, 500, 8, 6)
    assert summary.duration_seconds > 0 and summary.rows_per_second > 0
    (status,) = report.status.collect()
    assert status.status == "partial"
    assert status.message == "Processed 3 rows but only stored 2 frames (some rows failed)"
    (reject,) = report.rejects.collect()
    assert (reject.depth, reject.reject) == (200.0, "bad_pixel")
    (check,) = reports.validate_load(report.summary, table.read()).collect()
    assert check.validation_passed and check.rows_skipped
    (totals,) = reports.running_totals(report.batches).collect()
    assert (totals.total_rows, totals.total_failed, totals.percent_done) == (3, 1, 100.0)


def test_second_run_changes_only_the_update_time(spark, table, write_lines):
    path = write_lines([[k, *ramp(8, k)] for k in range(20)], 8)
    reload_frames(spark, table, path, "one", 8, 6, now=T1)
    first = held(table)
    reload_frames(spark, table, path, "one", 8, 6, now=T2)
    assert held(table) == {d: (*v[:4], 2) for d, v in first.items()}


def test_another_file_under_the_same_name_is_loaded(spark, table, write_lines):
    reload_frames(spark, table, write_lines([[1, *ramp(8)]], 8, "a.csv"), "one", 8, 6, now=T1)
    report = reload_frames(spark, table, write_lines([[2, *ramp(8)], [3, *ramp(8)]], 8, "b.csv"), "one", 8, 6, now=T1)
    assert sorted(held(table)) == [1.0, 2.0, 3.0]
    assert report.status.first().message == "Successfully ingested 2 frames"


def test_strict_load_goes_by_name(spark, table, write_lines):
    path = write_lines([[7, 5, 100], [9, 6, 101]], header=["col2", "col1", "depth"])
    reload_frames(spark, table, path, "one", 2, 2, now=T1, strict=True)
    got, colours = held(table), palette()
    assert {d: png.decode(v[0])[0].tolist() for d, v in got.items()} == {
        100.0: [list(colours[5]), list(colours[7])],
        101.0: [list(colours[6]), list(colours[9])],
    }
    with pytest.raises(ValueError, match="missing"):
        reload_frames(spark, table, write_lines([[1, 2, 3]], header=["a", "b", "depth"]), "x", 2, 2, strict=True)


def test_a_file_of_another_width_is_refused(spark, table, write_lines, tmp_path):
    write_lines([[1, 1, 1, 1, 1]], 4, "a.csv")
    write_lines([[2, 9, 9]], 2, "b.csv")
    with pytest.raises(Exception, match="CSV header"):
        reload_frames(spark, table, str(tmp_path), "x", 4, 4, now=T1)
    assert held(table) == {}


def test_an_empty_file_clears_nothing(spark, table, write_lines):
    table.upsert(frames(spark, (5, b"old")), "old", now=T1)
    with pytest.raises(ValueError, match="no lines"):
        reload_frames(spark, table, write_lines([], 8), "x", 8, 6, clear_existing=True)
    assert list(held(table)) == [5.0]


def test_last_row_in_file_order_wins(spark, table, write_lines):
    rows = [[k % 10, *[k % 256] * 4] for k in range(3000)]
    path = write_lines(rows, 4)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        report = reload_frames(spark, table, path, "one", 4, 4, now=T1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    colours = palette()
    got = held(table)
    assert len(got) == 10
    for depth in range(10):
        assert png.decode(got[float(depth)][0])[0, 0].tolist() == list(colours[(2990 + depth) % 256])
        assert got[float(depth)][3:] == (1, 1)
    (check,) = reports.validate_load(report.summary, table.read()).collect()
    assert not check.validation_passed and check.rows_stored == 3000 and check.table_count == 10


def test_clear_existing(spark, table, write_lines):
    table.upsert(frames(spark, (5, b"old"), (700, b"old")), "old", now=T1)
    path = write_lines([[5, *ramp(8)]], 8)
    reload_frames(spark, table, path, "new", 8, 6, clear_existing=True, now=T2)
    got = held(table)
    assert list(got) == [5.0] and got[5.0][3:] == (2, None)


def test_checks_come_before_clearing(spark, table, write_lines, tmp_path):
    table.upsert(frames(spark, (5, b"old")), "old", now=T1)
    with pytest.raises(FileNotFoundError):
        reload_frames(spark, table, str(tmp_path / "none.csv"), "x", clear_existing=True)
    with pytest.raises(ValueError, match="Expected 201 columns"):
        reload_frames(spark, table, write_lines([[1, *ramp(100)]], 100), "x", clear_existing=True)
    assert list(held(table)) == [5.0]


def test_header_only_load(spark, table, write_lines):
    report = reload_frames(spark, table, write_lines([], 8), "none", 8, 6, now=T1)
    assert held(table) == {}
    assert report.summary.collect()[0].rows_read == 0


def test_size_estimate(spark, table, write_lines):
    reload_frames(spark, table, write_lines([[k, *ramp(8)] for k in range(4)], 8), "one", 8, 6, now=T1)
    (size,) = reports.size_estimate(table.read(), seconds=2.0).collect()
    assert size.frames == 4 and size.image_bytes > 4 * 57
    assert size.estimated_mb == 4 * 10240 / 2**20 and size.mb_per_second == size.estimated_mb / 2


def test_files_as_they_land(spark, table, write_lines, tmp_path):
    (tmp_path / "in").mkdir()

    def run(now):
        stream_ingest(spark, table, str(tmp_path / "in"), str(tmp_path / "offsets"), 4, 4, now=now).awaitTermination()

    write_lines([[1, 1, 1, 1, 1], [2, 2, 2, 2, 2]], 4, "in/a.csv")
    run(T1)
    write_lines([[2, 9, 9, 9, 9], [3, "x", 3, 3, 3], [4, 4, 4, 4, 4]], 4, "in/b.csv")
    run(T2)
    colours = palette()
    got = held(table)
    assert {d: (png.decode(v[0])[0, 0].tolist(), v[3], v[4]) for d, v in got.items()} == {
        1.0: (list(colours[1]), 1, None),
        2.0: (list(colours[9]), 1, 2),
        4.0: (list(colours[4]), 2, None),
    }
    metrics = stream_batch_metrics(table).orderBy("batch_id").collect()
    assert [tuple(m)[1:] for m in metrics] == [(0, 2, 0, 1.0, 2.0), (1, 3, 1, 2.0, 4.0)]
    run(T2)
    assert held(table) == got


def test_replayed_batches_are_left_out(spark, table, write_lines, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        write_lines([[k, *[k] * 4], [50 + k, *[k] * 4]], 4, f"in/{k}.csv")
    source, seen = str(tmp_path / "in"), []
    stream_ingest(spark, table, source, str(tmp_path / "first"), 4, 4, now=T1).awaitTermination()
    seen.append(held(table))
    # The last batch again, as if the run had ended before it was noted as done.
    for commit in (tmp_path / "first" / "commits").glob("*"):
        if commit.name.strip(".").split(".")[0] == max(p.name for p in (tmp_path / "first" / "offsets").glob("[0-9]*")):
            commit.unlink()
    stream_ingest(spark, table, source, str(tmp_path / "first"), 4, 4, now=T2).awaitTermination()
    assert held(table) == seen[0] and len(seen[0]) == 6
    assert stream_batch_metrics(table).agg(F.sum("rows")).first()[0] == 6


def test_two_folders_into_one_table(spark, table, write_lines, tmp_path):
    for k in range(2):
        (tmp_path / f"in{k}").mkdir()
        write_lines([[k, *[k] * 4]], 4, f"in{k}/a.csv")
        stream_ingest(spark, table, str(tmp_path / f"in{k}"), str(tmp_path / f"at{k}"), 4, 4, now=T1).awaitTermination()
    assert sorted(held(table)) == [0.0, 1.0]
    assert stream_batch_metrics(table).agg(F.sum("rows")).first()[0] == 2


def test_a_stream_refuses_a_file_of_another_width(spark, table, write_lines, tmp_path):
    (tmp_path / "in").mkdir()
    write_lines([[1, 1, 1, 1, 1]], 4, "in/a.csv")
    write_lines([[2, 9, 9]], 2, "in/b.csv")
    with pytest.raises(Exception, match="(CSV header|Expected 5 columns)"):
        stream_ingest(spark, table, str(tmp_path / "in"), str(tmp_path / "at"), 4, 4, now=T1).awaitTermination()
    assert 2.0 not in held(table)
