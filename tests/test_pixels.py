import numpy as np
import pytest

from conftest import make, ramp
from scanloom.functions import pixels
from scanloom.functions.palette import palette
from scanloom.functions.weights import FILTERS, SCALE_BITS, taps
from scanloom.operators.quality import line_gradients, uniform_lines

NAN, INF = float("nan"), float("inf")


def lines(spark, rows, kind="int"):
    return make(spark, [(float(i), r) for i, r in enumerate(rows)], f"depth double, px array<{kind}>")


def pixel_lists(df):
    return [r.px for r in df.orderBy("depth").select("px").collect()]


def resized(row, target, method="bilinear"):
    """The same resize in plain integers."""
    if len(row) == target:
        return list(row)
    out = []
    for tap in taps(len(row), target, method):
        total = sum(int(row[tap.first + i]) * w for i, w in enumerate(tap.weights))
        out.append(min(255, max(0, (total + (1 << (SCALE_BITS - 1))) >> SCALE_BITS)))
    return out


@pytest.mark.parametrize("width", [8, None])
def test_clamp(spark, width):
    row = [None, NAN, INF, -INF, 45.9, -3.0, 300.0, 255.0]
    got = pixel_lists(pixels.clamp_pixels(lines(spark, [row], "double"), width))
    assert got == [[0, 0, 255, 0, 45, 0, 255, 255]]


def test_clamp_rejects_other_widths(spark):
    assert pixel_lists(pixels.clamp_pixels(lines(spark, [[1.0], [1.0, 2.0]], "double"), 2)) == [None, [1, 2]]


@pytest.mark.parametrize("method", FILTERS)
@pytest.mark.parametrize("source, target", [(200, 150), (150, 200), (200, 100), (200, 1), (64, 48), (5, 5)])
def test_resize_matches_plain_integers(spark, source, target, method):
    random = np.random.default_rng(7)
    rows = [ramp(source), [0] * source, [255] * source, [0, 255] * (source // 2) + [9] * (source % 2)]
    rows += random.integers(0, 256, (4, source)).tolist()
    got = pixel_lists(pixels.resize_lines(lines(spark, rows), source, target, method))
    assert got == [resized(r, target, method) for r in rows]


def test_lambda_form_gives_the_same(spark, monkeypatch):
    rows = np.random.default_rng(3).integers(0, 256, (5, 40)).tolist()
    for method in FILTERS:
        written = pixel_lists(pixels.resize_lines(lines(spark, rows), 40, 31, method))
        with monkeypatch.context() as m:
            m.setattr(pixels, "MAX_WRITTEN_TERMS", 3)
            assert pixel_lists(pixels.resize_lines(lines(spark, rows), 40, 31, method)) == written


@pytest.mark.parametrize("value", [0, 128, 255])
def test_constant_lines_stay_constant(spark, value):
    df = lines(spark, [[value] * 200, ramp()])
    df = pixels.resize_lines(df.selectExpr("*", "px AS resized"), 200, 150, column="resized")
    first, second = uniform_lines(df).orderBy("depth").collect()
    assert (first.uniform_before, first.uniform_after, first.kept) == (True, True, True)
    assert (second.uniform_before, second.kept) == (False, True)


@pytest.mark.parametrize("width", [150, None])
def test_rising_lines_stay_rising(spark, width):
    rising = np.linspace(0, 255, 200).astype(int).tolist()
    small = pixels.resize_lines(lines(spark, [rising, [255] * 100 + [0] * 100]), 200, 150)
    up, down = line_gradients(small, width).orderBy("depth").collect()
    assert up.rising and up.min_step >= -1
    assert not down.rising
    got = pixel_lists(small)[0]
    assert got[0] <= 5 and got[-1] >= 250
    steps = np.diff(got)
    assert (up.min_step, up.max_step) == (steps.min(), steps.max())


def test_gradient_of_one_pixel(spark):
    for width in (1, None):
        (row,) = line_gradients(lines(spark, [[7]]), width).collect()
        assert (row.min_step, row.max_step, row.rising) == (None, None, True)


def test_colours(spark):
    table = palette()
    (row,) = pixels.colour_lines(lines(spark, [[0, 64, 128, 192, 255]])).collect()
    assert [tuple(c) for c in row.rgb] == [table[g] for g in (0, 64, 128, 192, 255)]
    own = [(i, 255 - i, 7) for i in range(256)]
    (row,) = pixels.colour_lines(lines(spark, [[3, 250]]), own).collect()
    assert [tuple(c) for c in row.rgb] == [own[3], own[250]]


def test_images_are_resized_row_by_row(spark):
    image = np.random.default_rng(5).integers(0, 256, (10, 200)).tolist()
    df = make(spark, [(1.0, image)], "depth double, image array<array<int>>")
    (row,) = pixels.resize_images(df, 200, 150).collect()
    assert row.image == [resized(r, 150) for r in image]
    (row,) = pixels.colour_images(df).collect()
    table = palette()
    assert [[tuple(c) for c in r] for r in row.rgb] == [[table[g] for g in r] for r in image]


def test_unfold_leaves_out_missing_lines(spark):
    got = pixels.unfold(lines(spark, [[5, 6], None, []]), "px", "depth").orderBy("x").collect()
    assert [(r.depth, r.x, r.pixel) for r in got] == [(0.0, 0, 5), (0.0, 1, 6)]
