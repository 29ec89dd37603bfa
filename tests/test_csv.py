import pytest

from conftest import ramp
from scanloom.operators import numbering, reports
from scanloom.sources import csv_lines


def test_names_are_free_and_columns_go_by_position(spark, write_lines):
    path = write_lines([[100, *ramp()], [200, *ramp(start=50)]], header=["d", *[f"pixel_{k}" for k in range(200)]])
    rows = csv_lines.scan_lines(spark, path).orderBy("depth").collect()
    assert [r.depth for r in rows] == [100.0, 200.0]
    assert rows[1].px == ramp(start=50)
    assert all(r.reject is None for r in rows)


@pytest.mark.parametrize("width", [100, 201])
def test_wrong_header_width(spark, write_lines, width):
    path = write_lines([[100, *ramp(width)]], width)
    with pytest.raises(ValueError, match="Expected 201 columns"):
        csv_lines.scan_lines(spark, path, 200)


def test_missing_file(spark, tmp_path):
    for read in (csv_lines.scan_lines, csv_lines.scan_lines_strict, csv_lines.profile_lines):
        with pytest.raises(FileNotFoundError):
            read(spark, str(tmp_path / "none.csv"))


def test_cell_rules(spark, write_lines):
    cells = ["", "NA", "NaN", "45.9", "-3", "300", "inf", "-inf", "1e2", "null"]
    (row,) = csv_lines.scan_lines(spark, write_lines([[1, *cells]], 10), 10).collect()
    assert row.reject is None
    assert row.px == [0, 0, 0, 45, 0, 255, 255, 0, 100, 0]
    (row,) = csv_lines.scan_lines(spark, write_lines([[1, *cells]], 10), 10, raw=True).collect()
    assert row.px[0] is None and row.px[3:6] == [45.9, -3.0, 300.0]


def test_rejects_keep_other_rows(spark, write_lines):
    rows = [
        [100, 1, 2, 3],
        ["deep", 1, 2, 3],
        [200, 1, "abc", 3],
        ["", 1, 2, 3],
        ["NaN", 1, 2, 3],
        [300, 1, 2, 3, 4],
        [400, 1],
        [-0.0, 1, 2, 3],
    ]
    flagged = csv_lines.scan_lines(spark, write_lines(rows, 3), 3)
    got = {r.depth_text: r.reject for r in flagged.collect()}
    assert got == {
        "100": None,
        "deep": "bad_depth",
        "200": "bad_pixel",
        None: "bad_depth",
        "NaN": "bad_depth",
        "300": "too_many_cells",
        "400": None,
        "-0.0": None,
    }
    good, bad = reports.quarantine(flagged)
    assert (good.count(), bad.count()) == (3, 5)
    (short,) = good.where("depth = 400").collect()
    assert short.px == [1, 0, 0]
    (zero,) = good.where("depth_text = '-0.0'").collect()
    assert str(zero.depth) == "0.0"


def test_texts_that_only_a_cast_takes_for_numbers(spark, write_lines):
    rows = [["3d", 1, 2, 3], [4, "5d", 2, 3], [5, "0x1p3", 2, 3], [6, "7f", 2, 3], [7, "inf", "1e1", "2."]]
    got = {r.depth_text: r.reject for r in csv_lines.scan_lines(spark, write_lines(rows, 3), 3).collect()}
    assert got == {"3d": "bad_depth", "4": "bad_pixel", "5": "bad_pixel", "6": "bad_pixel", "7": None}


def test_commas_in_quotes_are_no_cells(spark, write_lines):
    (row,) = csv_lines.scan_lines(spark, write_lines([[1, '"2,5,6,7"']], 3), 3).collect()
    assert row.reject == "bad_pixel"


def test_more_columns_than_a_parser_expects(spark, write_lines):
    (row,) = csv_lines.scan_lines(spark, write_lines([[1, *[7] * 25_000]], 25_000), 25_000).collect()
    assert row.reject is None and len(row.px) == 25_000


def test_header_only(spark, write_lines):
    summary = reports.load_summary(csv_lines.scan_lines(spark, write_lines([]))).collect()[0]
    assert (summary.rows_read, summary.rows_stored, summary.rows_failed, summary.batches) == (0, 0, 0, 0)


def test_strict(spark, write_lines):
    (row,) = csv_lines.scan_lines_strict(spark, write_lines([[1.5, 0, 300, -1]], 3), 3).collect()
    assert (row.depth, row.px) == (1.5, [0, 255, 0])
    for cell in ("", "4.5", "abc"):
        with pytest.raises(Exception):
            csv_lines.scan_lines_strict(spark, write_lines([[1, 0, cell, 2]], 3), 3).collect()
    with pytest.raises(Exception):
        csv_lines.scan_lines_strict(spark, write_lines([["", 0, 1, 2]], 3), 3).collect()


def test_profile(spark, write_lines):
    rows = [[100 * k, *ramp()] for k in range(1, 6)]
    rows[1][1] = "4.5"
    rows[2][2] = "text"
    path = write_lines(rows)
    (got,) = csv_lines.profile_lines(spark, path).collect()
    assert (got.num_rows, got.num_cols, got.first_column, got.num_pixel_columns) == (5, 201, "depth", 200)
    assert got.sample_depths == [100.0, 200.0, 300.0, 400.0, 500.0]
    kinds = got.column_types
    assert (kinds["depth"], kinds["col1"], kinds["col2"], kinds["col3"]) == ("bigint", "double", "string", "bigint")
    assert got.memory_estimate_mb == pytest.approx(5 * 201 * 8 / 2**20)
    with open(path, "rb") as file:
        assert got.file_size_mb == pytest.approx(len(file.read()) / 2**20)


def test_profile_types_come_from_all_rows(spark, write_lines):
    path = write_lines([[k, "text" if k == 7 else 1, 8.5 if k == 8 else 1] for k in range(20)], 2)
    kinds = csv_lines.profile_lines(spark, path).first().column_types
    assert (kinds["depth"], kinds["col1"], kinds["col2"]) == ("bigint", "string", "double")


def test_profile_takes_the_first_rows_of_many_splits(spark, write_lines):
    path = write_lines([[k, 1, 2] for k in range(3000)], 2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        (got,) = csv_lines.profile_lines(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got.num_rows == 3000 and got.sample_depths == [0.0, 1.0, 2.0, 3.0, 4.0]


@pytest.mark.parametrize("count, size, sizes", [(10, 3, [3, 3, 3, 1]), (50, 10, [10] * 5)])
def test_blocks(spark, write_lines, tmp_path, count, size, sizes):
    scanned = csv_lines.scan_lines(spark, write_lines([[k, *ramp(4)] for k in range(count)], 4), 4)
    scanned.write.parquet(str(tmp_path / "scan"))
    numbered = numbering.number_file_rows(spark.read.parquet(str(tmp_path / "scan")))
    blocks = reports.batch_profile(numbered, size).orderBy("batch_no").collect()
    assert [b.rows for b in blocks] == sizes
    assert [b.depth_min for b in blocks] == [float(size * k) for k in range(len(sizes))]


def test_file_rows_are_numbered_across_splits_and_files(spark, write_lines, tmp_path):
    for part in range(3):
        write_lines([[1000 * part + k, 1, 2] for k in range(400)], 2, f"part-{part}.csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        scanned = csv_lines.scan_lines(spark, str(tmp_path), 2)
        assert scanned.rdd.getNumPartitions() > 5
        scanned.drop("px").write.parquet(str(tmp_path / "scan.out"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    stored = spark.read.parquet(str(tmp_path / "scan.out"))
    got = [(r.row_no, r.depth) for r in numbering.number_file_rows(stored).orderBy("row_no").collect()]
    assert got == [(400 * (n // 400) + n % 400 + 1, 1000.0 * (n // 400) + n % 400) for n in range(1200)]
