import base64
import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from conftest import make, ramp
from scanloom.functions import png
from scanloom.functions.palette import palette
from scanloom.operators import images, ranges
from scanloom.plans.process import process_lines
from test_pixels import lines, resized


def test_png_round_trip_and_damage():
    block = np.random.default_rng(1).integers(0, 256, (3, 4, 5, 3)).astype(np.uint8)
    encoded = png.encode_block(block)
    assert all(np.array_equal(png.decode(e), block[i]) for i, e in enumerate(encoded))
    assert all(e.startswith(bytes.fromhex("89504E470D0A1A0A")) for e in encoded)
    with pytest.raises(ValueError):
        png.decode(b"nothing")
    with pytest.raises(ValueError):
        png.decode(encoded[0][:45] + b"!!" + encoded[0][47:])


def test_missing_images_stay_missing(spark):
    rows = make(spark, [(1, [1, 2]), (2, None)], "id int, px array<int>")
    got = {r.id: r.rgb for r in images.decode_images(images.export_images(rows)).collect()}
    assert len(got[1]) == 2 and got[2] is None


def test_red_green_blue(spark):
    rgb = [(255, 0, 0), (0, 255, 0), (0, 0, 255)]
    df = make(spark, [(1.0, [dict(zip("rgb", c)) for c in rgb])], "depth double, rgb array<struct<r int, g int, b int>>")
    frames = images.export_images(df, "rgb")
    (row,) = images.decode_images(frames).collect()
    assert [tuple(c) for c in row.rgb] == rgb and (row.width, row.height) == (3, 1)


def test_mixed_shapes_and_missing_lines(spark):
    df = make(spark, 
        [(1.0, [1, 2, 3, 4], 2), (2.0, [9], 1), (3.0, None, 1), (4.0, [5, 6, 7, 8], 1)],
        "depth double, px array<int>, rows int",
    )
    rows = images.export_images(df, height="rows").orderBy("depth").collect()
    assert [(r.width, r.height) for r in rows] == [(2, 2), (1, 1), (None, None), (4, 1)]
    assert rows[2].image_png is None
    table = palette()
    assert png.decode(bytes(rows[0].image_png)).tolist() == [
        [list(table[1]), list(table[2])],
        [list(table[3]), list(table[4])],
    ]


def test_process_lines(spark):
    df = lines(spark, [ramp(), ramp(199), ramp(200, 50)])
    rows = process_lines(df).orderBy("depth").collect()
    assert [r.reject for r in rows] == [None, "bad_width", None]
    assert [(r.width, r.height) for r in rows] == [(150, 1), (None, None), (150, 1)]
    table = palette()
    assert png.decode(bytes(rows[2].image_png)).tolist() == [[list(table[g]) for g in resized(ramp(200, 50), 150)]]


def test_own_widths(spark):
    (row,) = process_lines(lines(spark, [ramp(100)]), 100, 75).collect()
    assert (row.width, row.height) == (75, 1)


def test_verify(spark):
    frames = process_lines(lines(spark, [ramp()])).selectExpr("*", "timestamp'2024-01-01' AS created_at")
    (good,) = images.verify_images(frames).collect()
    assert good.is_png and (good.header_width, good.header_height) == (150, 1)
    (bad,) = images.verify_images(frames.selectExpr("depth", "width", "height", "created_at", "X'00' AS image_png")).collect()
    assert not bad.is_png and bad.image_bytes == 1


def test_page_json(spark):
    data = bytes(range(256)) * 2
    df = make(spark, [(1.5, bytearray(data), 150, 1)], "depth double, image_png binary, width int, height int")
    (row,) = ranges.page_json(df).collect()
    record = json.loads(row.frame_json)
    assert list(record) == ["depth", "width", "height", "image_png_base64"]
    assert record["depth"] == 1.5
    assert base64.b64decode(record["image_png_base64"], validate=True) == data


def test_workers_need_no_installed_package(tmp_path):
    """Started elsewhere, with the package only on the driver's own path."""
    root = Path(images.__file__).resolve().parents[2]
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from scanloom.session import build_session\n"
        "from scanloom.operators.images import decode_images, export_images\n"
        "spark = build_session('local[1]', 1)\n"
        "df = spark.range(1).selectExpr('id', 'array(1, 2) AS px')\n"
        "print(len(decode_images(export_images(df)).first().rgb))\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("2"), done.stderr[-2000:]
