"""Per-line checks on pixel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.pixels import of_width


def _steps(column: str) -> Column:
    """Differences of neighbouring pixels; empty for lines of one pixel."""
    px = F.col(column)
    count = F.greatest(F.size(px) - 1, F.lit(0))
    return F.zip_with(F.slice(px, F.lit(2), count), F.slice(px, F.lit(1), count), lambda b, a: b - a)


def line_gradients(df: DataFrame, width: int | None = None, column: str = "px", tolerance: int = 1) -> DataFrame:
    """Smallest and largest step per line, and whether it never falls by more than ``tolerance``.

    With ``width`` the steps are written out; lines of another width get nulls.
    """
    if width is None:
        steps = _steps(column)
    else:
        terms = ", ".join(f"`{column}`[{k + 1}] - `{column}`[{k}]" for k in range(width - 1))
        steps = F.expr(of_width(f"`{column}`", width, f"array({terms})"))
    lines = df.select("depth", steps.alias("_steps"))
    low = F.array_min("_steps")
    rising = F.when(F.size("_steps") == 0, True).otherwise(low >= -tolerance)
    return lines.select(
        "depth", low.alias("min_step"), F.array_max("_steps").alias("max_step"), rising.alias("rising")
    )


def uniform_lines(df: DataFrame, before: str = "px", after: str = "resized") -> DataFrame:
    """Is a line constant, and does it stay so, at the same value, once resized?"""

    def constant(column: str) -> Column:
        return F.array_min(column) == F.array_max(column)

    return df.select(
        "depth",
        constant(before).alias("uniform_before"),
        constant(after).alias("uniform_after"),
        (
            ~constant(before) | (constant(after) & (F.array_min(before) == F.array_min(after)))
        ).alias("kept"),
    )
