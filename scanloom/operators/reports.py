"""Load accounting. Flagged rows carry ``reject``: null if stored, else the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.session import shared_folder

BYTES_PER_FRAME = 10 * 1024
MEGABYTE = 1024 * 1024


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row frames as one row, without a join."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.any_value(c, F.lit(True)).alias(c) for c in stacked.columns])


def quarantine(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected rows."""
    return flagged.where(F.col("reject").isNull()), flagged.where(F.col("reject").isNotNull())


def batch_profile(numbered: DataFrame, batch_size: int = 500) -> DataFrame:
    """Rows and depth extent of every block of ``batch_size`` rows, by ``row_no`` from 1."""
    if batch_size < 1:
        raise ValueError(f"batch size must be >= 1, got {batch_size}")
    failed = (
        F.count_if(F.col("reject").isNotNull()) if "reject" in numbered.columns else F.lit(0).cast("long")
    )
    return (
        numbered.withColumn("batch_no", F.floor((F.col("row_no") - 1) / F.lit(batch_size)))
        .groupBy("batch_no")
        .agg(
            F.count("*").alias("rows"),
            failed.alias("failed"),
            F.min("depth").alias("depth_min"),
            F.max("depth").alias("depth_max"),
        )
    )


def running_totals(batches: DataFrame) -> DataFrame:
    """Totals after each batch: rows, stored, failed, percent of all rows read.

    Works on the aggregated batches in ranges of 1024: totals are kept within a
    range, and only one sum per range is carried across. The batches are
    checkpointed, as both steps read them.
    """
    shared_folder(batches.sparkSession)
    block = F.floor(F.col("batch_no") / 1024)
    ranged = batches.select("batch_no", "rows", "failed", block.alias("_block")).checkpoint()
    sums = ranged.groupBy("_block").agg(F.sum("rows").alias("_r"), F.sum("failed").alias("_f"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    carried = sums.select(
        "_block",
        F.coalesce(F.sum("_r").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_f").over(before), F.lit(0)).alias("_failed_before"),
        F.sum("_r").over(whole).alias("_all"),
    )
    within = Window.partitionBy("_block").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.join(carried, "_block").select(
        "batch_no",
        (F.col("_rows_before") + F.sum("rows").over(within)).alias("total_rows"),
        (F.col("_failed_before") + F.sum("failed").over(within)).alias("total_failed"),
        "_all",
    )
    return totals.select(
        "batch_no",
        "total_rows",
        (F.col("total_rows") - F.col("total_failed")).alias("total_stored"),
        "total_failed",
        F.round(F.col("total_rows") * 100 / F.col("_all"), 1).alias("percent_done"),
    )


def load_summary(
    flagged: DataFrame,
    batch_size: int = 500,
    source_width: int = 200,
    target_width: int = 150,
    seconds: float | None = None,
) -> DataFrame:
    """One row: rows read, stored and failed, number of batches, widths, time and rate."""
    read, failed = F.count("*"), F.count_if(F.col("reject").isNotNull())
    spent = F.lit(None if seconds is None else float(seconds)).cast("double")
    return flagged.agg(read.alias("rows_read"), failed.alias("rows_failed")).select(
        "rows_read",
        (F.col("rows_read") - F.col("rows_failed")).alias("rows_stored"),
        "rows_failed",
        F.ceil(F.col("rows_read") / F.lit(batch_size)).alias("batches"),
        F.lit(batch_size).alias("batch_size"),
        F.lit(source_width).alias("source_width"),
        F.lit(target_width).alias("target_width"),
        F.round(spent, 2).alias("duration_seconds"),
        F.round(F.when(spent > 0, F.col("rows_read") / spent).otherwise(0.0), 1).alias("rows_per_second"),
    )


def load_status(summary: DataFrame) -> DataFrame:
    """The summary with ``status`` (success or partial) and a message."""
    complete = F.col("rows_read") == F.col("rows_stored")
    return summary.select(
        F.when(complete, "success").otherwise("partial").alias("status"),
        F.when(complete, F.format_string("Successfully ingested %d frames", "rows_stored"))
        .otherwise(
            F.format_string(
                "Processed %d rows but only stored %d frames (some rows failed)", "rows_read", "rows_stored"
            )
        )
        .alias("message"),
        F.col("rows_read").alias("rows_processed"),
        F.col("rows_stored").alias("frames_stored"),
        *[F.col("duration_seconds")] * ("duration_seconds" in summary.columns),
    )


def validate_load(summary: DataFrame, table: DataFrame) -> DataFrame:
    """Compare a load with its table: does the table hold as many frames as were stored?

    As a check of counts it also fails when depths repeated in the load or the
    table held other frames before.
    """
    held = table.agg(
        F.count("*").alias("table_count"),
        F.min("depth").alias("depth_min"),
        F.max("depth").alias("depth_max"),
    )
    return side_by_side(summary.select("rows_read", "rows_stored"), held).select(
        "rows_read",
        "rows_stored",
        "table_count",
        "depth_min",
        "depth_max",
        (F.col("table_count") == F.col("rows_stored")).alias("validation_passed"),
        (F.col("rows_read") != F.col("rows_stored")).alias("rows_skipped"),
    )


def size_estimate(table: DataFrame, seconds: float | None = None, stored: int | None = None) -> DataFrame:
    """Stored megabytes as assumed (10 KiB a frame) and as they are.

    The rate is that of the ``stored`` frames of a load, by default of all
    frames. A column ``image_bytes`` spares reading the images.
    """
    assumed = F.lit(float(BYTES_PER_FRAME)) / F.lit(float(MEGABYTE))
    megabytes = F.col("frames") * F.lit(float(BYTES_PER_FRAME)) / F.lit(float(MEGABYTE))
    size = F.col("image_bytes") if "image_bytes" in table.columns else F.octet_length("image_png")
    rate = megabytes if stored is None else F.lit(float(stored)) * assumed
    spent = F.lit(None if seconds is None else float(seconds)).cast("double")
    return table.agg(
        F.count("*").alias("frames"),
        F.coalesce(F.sum(size), F.lit(0)).alias("image_bytes"),
    ).select(
        "frames",
        megabytes.alias("estimated_mb"),
        "image_bytes",
        F.when(spent > 0, rate / spent).otherwise(0.0).alias("mb_per_second"),
    )
