"""Pixel work on array columns, as JVM expressions.

A line's width is known when its plan is made, so the per-pixel arithmetic is
written out pixel by pixel and compiled, instead of going through a lambda that
Spark would interpret for every pixel. Two things keep this sound:

* a line of another width yields null (the caller turns that into a reject);
* the width test is a higher-order ``exists``. Spark compiles such a projection
  in many short methods; fused into one whole-stage method it would be too long
  for the JVM to compile to machine code, and run about ten times slower.

Above ``MAX_WRITTEN_TERMS`` terms the lambda form is used, which has no size
limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.palette import Rgb, check_palette, palette
from scanloom.functions.weights import SCALE_BITS, Tap, taps

MAX_WRITTEN_TERMS = 4000
_HALF = 1 << (SCALE_BITS - 1)


def of_width(column: str, width: int, body: str) -> str:
    """SQL for ``body`` where the array has this width, else null."""
    return f"CASE WHEN exists(array(size({column})), n -> n = {width}) THEN {body} END"


def _clamped(value: str) -> str:
    # NaN sorts above every number, so it is replaced before the bounds apply.
    return f"CAST(least(greatest(nanvl(coalesce({value}, 0D), 0D), 0D), 255D) AS INT)"


def clamp_pixels(df: DataFrame, width: int | None = None, column: str = "px") -> DataFrame:
    """Pixels to 0..255: bounds first, then fractions dropped; missing and NaN give 0."""
    name = f"`{column}`"
    if width is None or width > MAX_WRITTEN_TERMS:
        body = f"transform({name}, v -> {_clamped('CAST(v AS DOUBLE)')})"
        if width is not None:
            body = of_width(name, width, body)
    else:
        cells = ", ".join(_clamped(f"CAST({name}[{k}] AS DOUBLE)") for k in range(width))
        body = of_width(name, width, f"array({cells})")
    return df.withColumn(column, F.expr(body))


def _weighted(row: str, tap: Tap, bounded: bool) -> str:
    if tap.weights == (1 << SCALE_BITS,):
        return f"{row}[{tap.first}]"
    terms = " + ".join(f"{row}[{tap.first + i}] * {w}" for i, w in enumerate(tap.weights) if w)
    value = f"shiftright({terms} + {_HALF}, {SCALE_BITS})"
    return f"least(greatest({value}, 0), 255)" if bounded else value


def _resized(row: str, table: Sequence[Tap], bounded: bool) -> str:
    """SQL for one row's resized array."""
    most = max(len(tap.weights) for tap in table)
    if sum(len(tap.weights) for tap in table) <= MAX_WRITTEN_TERMS:
        return "array(" + ", ".join(_weighted(row, tap, bounded) for tap in table) + ")"
    # Every entry is padded with zero weights to the same number of taps.
    entries = ", ".join(
        "named_struct("
        + ", ".join(
            f"'k{i}', {tap.first + i if i < len(tap.weights) else tap.first}, "
            f"'w{i}', {tap.weights[i] if i < len(tap.weights) else 0}"
            for i in range(most)
        )
        + ")"
        for tap in table
    )
    terms = " + ".join(f"{row}[t.k{i}] * t.w{i}" for i in range(most))
    value = f"shiftright({terms} + {_HALF}, {SCALE_BITS})"
    if bounded:
        value = f"least(greatest({value}, 0), 255)"
    return f"transform(array({entries}), t -> {value})"


def resize_lines(
    df: DataFrame, source: int, target: int = 150, method: str = "bilinear", column: str = "px"
) -> DataFrame:
    """Change the width of every line from ``source`` to ``target`` pixels.

    Equal widths leave the column alone. Lines of another width become null.
    """
    if source == target:
        return df
    body = _resized(f"`{column}`", taps(source, target, method), method in ("bicubic", "lanczos"))
    return df.withColumn(column, F.expr(of_width(f"`{column}`", source, body)))


def resize_images(
    df: DataFrame, source: int, target: int = 150, method: str = "bilinear", column: str = "image"
) -> DataFrame:
    """The same for ``array<array<int>>`` images; the number of rows stays."""
    if source == target:
        return df
    body = _resized("line", taps(source, target, method), method in ("bicubic", "lanczos"))
    return df.withColumn(
        column, F.expr(f"transform(`{column}`, line -> CASE WHEN size(line) = {source} THEN {body} END)")
    )


def palette_column(table: Sequence[Rgb] | None = None) -> Column:
    """The palette as a constant ``array<struct<r,g,b>>``."""
    rows = check_palette(table if table is not None else palette())
    return F.expr(
        "array(" + ", ".join(f"named_struct('r', {r}, 'g', {g}, 'b', {b})" for r, g, b in rows) + ")"
    )


def colour_lines(
    df: DataFrame, table: Sequence[Rgb] | None = None, column: str = "px", into: str = "rgb"
) -> DataFrame:
    """Look every gray pixel up in the palette."""
    colours = palette_column(table)
    return df.withColumn(into, F.transform(F.col(column), lambda gray: F.get(colours, gray)))


def colour_images(
    df: DataFrame, table: Sequence[Rgb] | None = None, column: str = "image", into: str = "rgb"
) -> DataFrame:
    """The same for ``array<array<int>>`` images."""
    colours = palette_column(table)
    return df.withColumn(
        into,
        F.transform(F.col(column), lambda line: F.transform(line, lambda gray: F.get(colours, gray))),
    )


def unfold(df: DataFrame, column: str, *keys: str, value: str = "pixel") -> DataFrame:
    """One row per array element: the keys, position ``x`` from 0, the element.

    The outer form keeps Spark from testing the array's size below the
    projections, which would compute every pixel a second time.
    """
    rows = df.select(*keys, F.posexplode_outer(column).alias("x", value))
    return rows.where(F.col("x").isNotNull())
