import numpy as np
import pytest

from scanloom.functions.palette import STOPS, check_palette, palette, palette_frame
from scanloom.functions.weights import FILTERS, SCALE_BITS, taps


def test_three_quarters_weights():
    table = taps(200, 150)
    assert sum(len([w for w in t.weights if w]) for t in table) == 398
    share = [[w / (1 << SCALE_BITS) for w in t.weights] for t in table]
    assert share[0] == pytest.approx([0.7, 0.3], abs=1e-6)
    assert [w for w in share[2] if w] == pytest.approx([0.2727, 0.6364, 0.0909], abs=1e-4)
    assert [w for w in share[-1] if w] == pytest.approx([0.3, 0.7], abs=1e-6)


@pytest.mark.parametrize("method", FILTERS)
@pytest.mark.parametrize("source, target", [(200, 150), (150, 200), (200, 100), (200, 1), (64, 48), (1, 5)])
def test_weights_add_up_and_stay_inside(source, target, method):
    table = taps(source, target, method)
    assert len(table) == target
    for tap in table:
        assert 0 <= tap.first and tap.first + len(tap.weights) <= source
        assert abs(sum(tap.weights) - (1 << SCALE_BITS)) <= len(tap.weights)


def test_enlarging_interpolates_between_two_pixels():
    # Doubling a pair: the outer pixels repeat, the inner ones mix 3:1.
    full = 1 << SCALE_BITS
    table = [(t.first, t.weights) for t in taps(2, 4)]
    assert table == [(0, (full,)), (0, (3 * full // 4, full // 4)), (0, (full // 4, 3 * full // 4)), (1, (full,))]


def test_bad_arguments():
    with pytest.raises(ValueError):
        taps(0, 5)
    with pytest.raises(ValueError):
        taps(5, 5, "box")


@pytest.mark.parametrize(
    "gray, rgb",
    [
        (0, (0, 0, 139)),
        (32, (0, 69, 139)),
        (45, (0, 97, 139)),
        (64, (0, 139, 139)),
        (78, (0, 152, 130)),
        (100, (0, 173, 117)),
        (128, (0, 200, 100)),
        (192, (255, 215, 0)),
        (224, (255, 140, 0)),
        (255, (255, 69, 0)),
    ],
)
def test_palette_values(gray, rgb):
    assert palette()[gray] == rgb


def test_palette_equals_integer_linspace_and_is_never_black():
    expected = np.zeros((256, 3), np.uint8)
    for (low, left), (high, right) in zip(STOPS, STOPS[1:]):
        for c in range(3):
            expected[low : high + 1, c] = np.linspace(left[c], right[c], high - low + 1, dtype=np.uint8)
    assert np.array_equal(np.array(palette()), expected)
    assert min(sum(rgb) for rgb in palette()) > 0


def test_palette_frame(spark):
    rows = palette_frame(spark).orderBy("gray").collect()
    assert [(r.r, r.g, r.b) for r in rows] == palette()


def test_check_palette():
    with pytest.raises(ValueError):
        check_palette([(0, 0, 0)] * 255)
    with pytest.raises(ValueError):
        check_palette([(0, 0, 256)] * 256)
