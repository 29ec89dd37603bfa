"""Row numbers over data too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.session import shared_folder


def number_rows(df: DataFrame, *order: str | Column, name: str = "row_no") -> DataFrame:
    """Number rows 1, 2, ... in the given total order.

    The range-partitioned sort is checkpointed, so both passes below see the
    same partitions. Only one count per partition is combined in a single task.
    Pass narrow rows: all columns given are sorted and kept once on disk.
    """
    shared_folder(df.sparkSession)
    sorted_rows = df.orderBy(*order).checkpoint()
    # The id holds the partition in its upper bits and the place in it in the lower 33.
    placed = (
        sorted_rows.withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_place", F.col("_id") - F.shiftleft("_part", 33))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    # One row per sort partition; Spark broadcasts them if they are few enough.
    return placed.join(starts, "_part").select(
        *df.columns, (F.col("_start") + F.col("_place") + 1).alias(name)
    )


def number_file_rows(df: DataFrame, name: str = "row_no") -> DataFrame:
    """Number scanned rows in file order: path, then split, then place in the split.

    Needs the ``source_*`` columns of a scan as stored in a table (ids must not
    change between passes). No sort of the rows: only per-split counts are put
    in order.
    """
    split = ["source_file", "source_block"]
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*split)
        .agg(F.count("*").alias("_rows"), F.min("source_row").alias("_first"))
        .select(*split, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    # Number of splits = bytes read / split size. Spark broadcasts it only if it is small enough.
    return df.join(starts, split).select(
        *df.columns, (F.col("_start") + F.col("source_row") - F.col("_first") + 1).alias(name)
    )
