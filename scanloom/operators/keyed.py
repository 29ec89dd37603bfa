"""Keyed writes as DataFrame functions: last-wins, upsert, delete."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAYLOAD = ("image_png", "width", "height")


def file_order() -> Column:
    """Order of rows as scanned: file, split in the file, place in the split."""
    return F.struct("source_file", "source_block", "source_row")


def last_wins(
    df: DataFrame, order: Column, keys: Sequence[str] = ("depth",), payload: Sequence[str] = PAYLOAD
) -> DataFrame:
    """One row per key: the last by ``order``, with ``times_seen``.

    Late materialisation: the last ``order`` of each key is found on the narrow columns alone, combined in each task
    before the shuffle, so a key that fills a third of the input still sends one narrow row per task; only then are
    the images of the winning rows fetched, by a join on key and order. No aggregation ever holds an image. Null keys
    and orders match as equals; of rows tied on both, one is kept. Rows whose order is null lose to any other.
    """
    rows = df.select(*keys, *payload, F.struct(*keys, order.alias("_order")).alias("_at"))
    winners = (
        df.select(*keys, order.alias("_order"))
        .groupBy(*keys).agg(F.max("_order").alias("_order"), F.count("*").alias("times_seen"))
        .select(F.struct(*keys, "_order").alias("_at"), "times_seen")
    )
    # One struct of key and order: its equality holds for nulls too, and the join leaves the rows dealt out by it.
    first = Window.partitionBy("_at").orderBy("_at")  # only ties of key and order have more than one row here
    return (
        rows.join(winners, "_at")
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") == 1)
        .select(*keys, *payload, "times_seen")
    )


def new_frames(
    incoming: DataFrame, now: datetime, keys: Sequence[str] = ("depth",), payload: Sequence[str] = PAYLOAD
) -> DataFrame:
    """What :func:`upsert_frames` gives when there are no frames yet, without grouping."""
    moment = F.lit(now).cast("timestamp")
    return incoming.select(
        *keys,
        *payload,
        moment.alias("created_at"),
        F.when(F.col("times_seen") > 1, moment).alias("updated_at"),
    )


def upsert_frames(
    current: DataFrame,
    incoming: DataFrame,
    now: datetime,
    keys: Sequence[str] = ("depth",),
    payload: Sequence[str] = PAYLOAD,
    range_tasks: int | None = None,
) -> DataFrame:
    """Insert or replace by depth.

    ``current`` holds unique depths with ``created_at`` and ``updated_at``;
    ``incoming`` holds unique depths with ``times_seen`` (see :func:`last_wins`).
    A replaced frame keeps ``created_at`` and gets ``updated_at``. So does a new
    one that occurred more than once, as its later copies replaced the first.

    Both sides go through a single shuffle: they are stacked and grouped by
    depth, at most two rows to a group. With ``range_tasks`` that shuffle leaves
    the rows in so many ranges of the keys, ready to be written in key order.
    """
    moment = F.lit(now).cast("timestamp")
    kept = current.select(
        *keys,
        *payload,
        "created_at",
        "updated_at",
        F.lit(0).alias("_new"),
        F.lit(0).cast("long").alias("times_seen"),
    )
    added = incoming.select(
        *keys,
        *payload,
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.lit(1).alias("_new"),
        F.col("times_seen").cast("long").alias("times_seen"),
    )
    stacked = kept.unionByName(added)
    if range_tasks is not None:
        stacked = stacked.repartitionByRange(range_tasks, *keys)
    merged = stacked.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.col("_new")).alias("_row"),
        F.max("created_at").alias("_created"),
        F.max("updated_at").alias("_updated"),
        F.max("_new").alias("_new"),
        F.max("times_seen").alias("_times"),
    )
    touched = (F.col("_new") == 1) & (F.col("_created").isNotNull() | (F.col("_times") > 1))
    return merged.select(
        *keys,
        *[F.col(f"_row.{name}").alias(name) for name in payload],
        F.coalesce("_created", moment).alias("created_at"),
        F.when(touched, moment).otherwise(F.col("_updated")).alias("updated_at"),
    )


def delete_frames(current: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose depth is not among ``keys``."""
    return current.join(keys.select("depth"), "depth", "left_anti")


def deletion_report(current: DataFrame, keys: DataFrame) -> DataFrame:
    """For every key to delete: was there such a row?"""
    present = current.select("depth", F.lit(True).alias("_hit"))
    return (
        keys.select("depth")
        .distinct()
        .join(present, "depth", "left")
        .select("depth", F.col("_hit").isNotNull().alias("deleted"))
    )
