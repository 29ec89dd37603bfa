"""Integer resampling weights for a change of line width.

The tables are tiny (one entry per output pixel) and are built on the driver
when a plan is made.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

# Weights are stored as integers scaled by 2**SCALE_BITS.
SCALE_BITS = 22


@dataclass(frozen=True)
class Tap:
    """One output pixel: the first source position and the weights from there on."""

    first: int
    weights: tuple[int, ...]


def _triangle(t: float) -> float:
    return max(0.0, 1.0 - abs(t))


def _cubic(t: float) -> float:
    # Cubic convolution with a = -1/2.
    t = abs(t)
    if t < 1.0:
        return 1.5 * t**3 - 2.5 * t**2 + 1.0
    if t < 2.0:
        return -0.5 * t**3 + 2.5 * t**2 - 4.0 * t + 2.0
    return 0.0


def _sinc(t: float) -> float:
    return 1.0 if t == 0.0 else math.sin(math.pi * t) / (math.pi * t)


def _windowed_sinc(t: float) -> float:
    return _sinc(t) * _sinc(t / 3.0) if -3.0 <= t < 3.0 else 0.0


# Kernel and its half-width in source pixels when enlarging.
KERNELS: dict[str, tuple[Callable[[float], float], float]] = {
    "bilinear": (_triangle, 1.0),
    "bicubic": (_cubic, 2.0),
    "lanczos": (_windowed_sinc, 3.0),
}
FILTERS = ("nearest", *KERNELS)


def taps(source: int, target: int, method: str = "bilinear") -> list[Tap]:
    """The weights of every output pixel of a ``source`` -> ``target`` resize."""
    if source < 1 or target < 1:
        raise ValueError(f"widths must be positive, got {source} and {target}")
    if method == "nearest":
        return [Tap(k, (1 << SCALE_BITS,)) for k in _nearest_positions(source, target)]
    if method not in KERNELS:
        raise ValueError(f"unknown filter {method!r}, expected one of {FILTERS}")
    kernel, half_width = KERNELS[method]
    ratio = source / target
    stretch = max(ratio, 1.0)
    reach = half_width * stretch
    table = []
    for x in range(target):
        centre = (x + 0.5) * ratio
        first = max(0, int(centre - reach + 0.5))
        stop = min(source, int(centre + reach + 0.5))
        raw = [kernel((k - centre + 0.5) / stretch) for k in range(first, stop)]
        total = sum(raw)
        table.append(Tap(first, tuple(_scaled(w / total) for w in raw)))
    return table


def _scaled(weight: float) -> int:
    """Round half away from zero to the integer scale."""
    return int(math.copysign(0.5, weight) + weight * (1 << SCALE_BITS))


def _nearest_positions(source: int, target: int) -> list[int]:
    # The position advances by repeated addition, so that a centre falling on a
    # pixel border rounds the same way as in step-wise scaling.
    step = source / target
    position, found = step * 0.5, []
    for _ in range(target):
        found.append(min(source - 1, int(position)))
        position += step
    return found
