"""From pixel lines to frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions.palette import Rgb
from scanloom.functions.pixels import clamp_pixels, resize_lines
from scanloom.operators.images import export_images


def process_lines(
    lines: DataFrame,
    source_width: int = 200,
    target_width: int = 150,
    method: str = "bilinear",
    table: Sequence[Rgb] | None = None,
    clamped: bool = False,
) -> DataFrame:
    """Clamp, check the width, resize, colour and encode every line.

    Gives ``image_png``, ``width`` and ``height`` in place of ``px``. A line of
    another width gets no image and the reject reason ``bad_width``; other
    reasons already set are kept, and such lines get no image either. All of
    it is one pass over the input without a shuffle.
    """
    if "reject" not in lines.columns:
        lines = lines.withColumn("reject", F.lit(None).cast("string"))
    wrong = F.col("px").isNull() | (F.size("px") != source_width)
    lines = lines.withColumn("reject", F.coalesce("reject", F.when(wrong, F.lit("bad_width"))))
    if not clamped:
        lines = clamp_pixels(lines, source_width)
    lines = lines.withColumn("px", F.when(F.col("reject").isNull(), F.col("px")))
    return export_images(resize_lines(lines, source_width, target_width, method), "px", table)
