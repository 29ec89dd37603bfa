"""Reads over depth-keyed rows: ranges, look-ups, pages, counts.

``order`` lists the sort columns; it matters only where depths repeat, which a
frame table never has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.numbering import number_rows
from scanloom.operators.selection import ranked_slice

DEFAULT_LIMIT = 100
MAX_LIMIT = 1000


def check_page_request(
    depth_min: float | None = None,
    depth_max: float | None = None,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
) -> None:
    """Raise ``ValueError`` for a page request outside the allowed values."""
    for label, bound in (("depth_min", depth_min), ("depth_max", depth_max)):
        if bound is not None and not bound >= 0:
            raise ValueError(f"{label} must be >= 0, got {bound}")
    if depth_min is not None and depth_max is not None and depth_max < depth_min:
        raise ValueError(f"depth_max ({depth_max}) must be >= depth_min ({depth_min})")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be in 1..{MAX_LIMIT}, got {limit}")
    if offset < 0:
        raise ValueError(f"offset must be >= 0, got {offset}")


def depth_range(df: DataFrame, depth_min: float | None = None, depth_max: float | None = None) -> DataFrame:
    """Rows within the bounds, both included, each optional."""
    if depth_min is not None:
        df = df.where(F.col("depth") >= F.lit(float(depth_min)))
    if depth_max is not None:
        df = df.where(F.col("depth") <= F.lit(float(depth_max)))
    return df


def depth_lookup(df: DataFrame, depth: float) -> DataFrame:
    """The row at exactly this depth, if any."""
    return df.where(F.col("depth") == F.lit(float(depth)))


def depth_page(
    df: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, order: Sequence[str] = ("depth",)
) -> DataFrame:
    """``limit`` rows after skipping ``offset``, by ascending depth; deep pages by rank selection."""
    return ranked_slice(df, order, offset, limit)


def page_has_more(
    df: DataFrame,
    depth_min: float | None = None,
    depth_max: float | None = None,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    order: Sequence[str] = ("depth",),
) -> DataFrame:
    """One page with ``has_more``, found by reading one row beyond the page."""
    return (
        _numbered_page(df, depth_min, depth_max, limit, offset, order)
        .where(F.col("page_row") <= limit)
        .drop("page_row")
    )


def _numbered_page(df, depth_min, depth_max, limit, offset, order) -> DataFrame:
    check_page_request(depth_min, depth_max, limit, offset)
    rows = depth_page(depth_range(df, depth_min, depth_max), limit + 1, offset, order)
    # At most limit + 1 <= 1001 rows reach these windows.
    everything = Window.partitionBy()
    return (
        rows.withColumn("page_row", F.row_number().over(Window.orderBy(*order)))
        .withColumn("has_more", F.count("*").over(everything) > limit)
    )


def page_metadata(
    df: DataFrame,
    depth_min: float | None = None,
    depth_max: float | None = None,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    order: Sequence[str] = ("depth",),
) -> DataFrame:
    """One row about a page: its count and depth extent, the request, ``has_more``.

    ``total`` stays null: counting the whole range is a separate, dearer query.
    """
    check_page_request(depth_min, depth_max, limit, offset)
    rows = depth_page(depth_range(df.select(*order), depth_min, depth_max), limit + 1, offset, order)
    shown = rows.withColumn("shown", F.row_number().over(Window.orderBy(*order)) <= limit)
    on_page = F.when(F.col("shown"), F.col("depth"))
    return shown.agg(
        F.count_if(F.col("shown")).alias("count"),
        F.lit(None).cast("long").alias("total"),
        F.min(on_page).alias("depth_min"),
        F.max(on_page).alias("depth_max"),
        F.lit(limit).alias("limit"),
        F.lit(offset).alias("offset"),
        (F.count("*") > limit).alias("has_more"),
    )


def page_walk(df: DataFrame, page_size: int, order: Sequence[str] = ("depth",)) -> DataFrame:
    """All pages at once: every row with its ``row_no`` and ``page_no`` (from 0)."""
    if page_size < 1:
        raise ValueError(f"page size must be >= 1, got {page_size}")
    numbered = number_rows(df, *order)
    return numbered.withColumn("page_no", F.floor((F.col("row_no") - 1) / F.lit(page_size)))


def count_frames(df: DataFrame, depth_min: float | None = None, depth_max: float | None = None) -> DataFrame:
    """Number of rows, in all or within inclusive bounds."""
    return depth_range(df, depth_min, depth_max).agg(F.count("*").alias("frames"))


def depth_extent(df: DataFrame) -> DataFrame:
    """Smallest and largest depth; two nulls if there are no rows."""
    return df.agg(F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max"))


def store_metrics(df: DataFrame) -> DataFrame:
    """Count and extent of any frames in one pass; a frame table has them in its log."""
    return df.agg(
        F.count("*").alias("total_frames"),
        F.min("depth").alias("depth_min"),
        F.max("depth").alias("depth_max"),
    )


def iso_time(moment: Column) -> Column:
    """ISO-8601 text; the fraction is written only when there is one."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    exact = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(exact.endswith(".000000"), whole).otherwise(exact)


def frame_metadata(df: DataFrame) -> DataFrame:
    """Frame records without the image itself; a stored ``image_bytes`` spares reading it."""
    return df.select(
        "depth",
        "width",
        "height",
        (F.col("image_bytes").cast("int") if "image_bytes" in df.columns else F.octet_length("image_png")).alias("image_size_bytes"),
        iso_time(F.col("created_at")).alias("created_at"),
        iso_time(F.col("updated_at")).alias("updated_at"),
    )


def base64_text(data: Column) -> Column:
    """Base64 on one line (Spark's own result is broken into lines)."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def plain_number(value: Column) -> Column:
    """A double as decimal text without an exponent, as far as 1e15; beyond that as Spark writes it."""
    text = value.cast("string")
    digits = F.regexp_replace(value.try_cast("decimal(38,20)").cast("string"), r"(\.[0-9]*?)0+$", "$1")
    digits = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(text.contains("E") & (F.abs(value) < 1e15), digits).otherwise(text)


def page_json(df: DataFrame) -> DataFrame:
    """Each frame as a JSON record with its image in base64; depths are written without an exponent."""
    record = F.struct(
        F.col("width"),
        F.col("height"),
        base64_text(F.col("image_png")).alias("image_png_base64"),
    )
    rest = F.substring(F.to_json(record), 2, 1 << 30)
    return df.select("depth", F.concat(F.lit('{"depth":'), plain_number(F.col("depth")), F.lit(","), rest).alias("frame_json"))
