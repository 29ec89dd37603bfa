"""The test tables seen as scan lines, readings and frames."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.session import fresh_folder

WIDTH = 64
TARGET = 48
# A fixed clock keeps results comparable.
EARLIER = datetime(2024, 1, 1, tzinfo=timezone.utc)
NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as raw lines of 64 pixels, some outside 0..255."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("double").alias("depth"),
        F.expr("transform(embedding, v -> (CAST(v AS DOUBLE) + 0.5D) * 256D)").alias("px"),
        "label",
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders keyed by price; prices may repeat, so the order key breaks ties."""
    return table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("depth"), "o_orderkey")


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames keyed by customer: every depth occurs many times."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("double").alias("depth"),
        F.encode("o_orderpriority", "UTF-8").alias("image_png"),
        F.length("o_orderpriority").alias("width"),
        F.lit(1).alias("height"),
        "o_orderkey",
        "o_orderstatus",
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as loaded rows; those of type error count as rejected."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("value").alias("depth"),
        F.when(F.col("event_type") == "error", F.lit("bad_pixel")).alias("reject"),
    )


def clock_text(column: str) -> Column:
    """A moment as UTC text, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(column, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def write_csv(
    df: DataFrame,
    cells: Column,
    depth: Column | str = "depth",
    split_by: str | None = None,
    path: str | None = None,
    width: int = WIDTH,
    by_name: bool = False,
) -> str:
    """Write lines as wide CSV in depth order, or one file per value of ``split_by``; returns the folder.

    With ``by_name`` columns have the names of a strict load, in falling order.
    """
    spark = df.sparkSession
    path = path or fresh_folder(spark, "csv")
    rows = df.withColumn("_cells", cells)
    pixels = [F.col("_cells")[k].alias(f"col{k + 1}" if by_name else f"p{k}") for k in range(width)]
    key = (F.col(depth) if isinstance(depth, str) else depth).alias("depth" if by_name else "depth_m")
    if split_by is None:
        columns = [*pixels[::-1], key] if by_name else [key, *pixels]
        rows.orderBy("depth").select(*columns).write.option("header", True).csv(path)
    else:
        parts = rows.repartition(split_by).select(key, *pixels, split_by)
        parts.write.partitionBy(split_by).option("header", True).csv(path)
    return path
