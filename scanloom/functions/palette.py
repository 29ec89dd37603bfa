"""The gray -> RGB table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Rgb = tuple[int, int, int]

# Gray level and its colour.
STOPS: tuple[tuple[int, Rgb], ...] = (
    (0, (0, 0, 139)),
    (64, (0, 139, 139)),
    (128, (0, 200, 100)),
    (192, (255, 215, 0)),
    (255, (255, 69, 0)),
)


def palette(stops: Sequence[tuple[int, Rgb]] = STOPS) -> list[Rgb]:
    """256 colours, straight lines between the stops, fractions dropped."""
    table: list[Rgb] = []
    for level in range(256):
        (low, left), (high, right) = next(
            pair for pair in zip(stops, stops[1:]) if pair[0][0] <= level <= pair[1][0]
        )
        span, step = high - low, level - low
        table.append(tuple((a * (span - step) + b * step) // span for a, b in zip(left, right)))
    return table


def check_palette(table: Sequence[Rgb]) -> list[Rgb]:
    """The table as plain tuples, or ``ValueError`` if it is not 256 byte triples."""
    rows = [tuple(int(v) for v in row) for row in table]
    if len(rows) != 256 or any(len(row) != 3 or min(row) < 0 or max(row) > 255 for row in rows):
        raise ValueError("a palette needs 256 colours of three values in 0..255")
    return rows


def palette_frame(spark: SparkSession, stops: Sequence[tuple[int, Rgb]] = STOPS) -> DataFrame:
    """The same table as rows ``(gray, r, g, b)``."""
    level = F.col("id").cast("int")
    colours = {}
    for channel, name in enumerate("rgb"):
        value = F.lit(stops[-1][1][channel])
        for (low, left), (high, right) in reversed(list(zip(stops, stops[1:]))):
            span = high - low
            along = left[channel] * (F.lit(high) - level) + right[channel] * (level - F.lit(low))
            value = F.when(level < high, F.floor(along / F.lit(span)).cast("int")).otherwise(value)
        colours[name] = value
    return spark.range(256).select(level.alias("gray"), *[v.alias(n) for n, v in colours.items()])
