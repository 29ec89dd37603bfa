"""CSV files loaded as they land, one micro-batch at a time."""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scanloom.plans.load import load_lines
from scanloom.session import create_file, path_exists, read_file
from scanloom.sources.csv_lines import csv_cells, flag_lines, landed_header, with_source_row
from scanloom.sources.frame_table import FrameTable


def stream_ingest(
    spark: SparkSession,
    table: FrameTable,
    path: str,
    checkpoint: str,
    source_width: int = 200,
    target_width: int = 150,
    files_per_batch: int | None = None,
    name: str = "stream",
    now: datetime | None = None,
    bytes_per_batch: int = 4 << 30,
) -> StreamingQuery:
    """Start loading the files under ``path`` that were not loaded yet, then stop.

    Every micro-batch is one load. Its steps are numbered per ``checkpoint``,
    which holds the stream's own random name: if a batch is replayed after a
    failure, the table's log has its step and leaves it out; another source or
    a new checkpoint never shares numbers with it. A file with a wrong number
    of columns ends the stream with an error before its batch is loaded. A
    batch takes ``files_per_batch`` files if given, else ``bytes_per_batch``.
    """
    limit = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", bytes_per_batch)
    cells = csv_cells(spark.readStream, source_width, landed_header(spark, path, source_width))
    lines = flag_lines(cells.option(*limit).option("recursiveFileLookup", True).csv(path), source_width)
    writer = _writer(spark, checkpoint)

    def load(batch: DataFrame, batch_id: int) -> None:
        load_lines(
            table, with_source_row(batch), f"{name}, batch {batch_id}", source_width, target_width, now=now,
            writer=(writer, batch_id), folder=f"{_folder(name)}-{writer}-{batch_id:08d}",
        )

    return (
        lines.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _writer(spark: SparkSession, checkpoint: str) -> str:
    """The random name kept beside the offsets of a checkpoint."""
    path = f"{checkpoint.rstrip('/')}/writer-name"
    if not path_exists(spark, path):
        create_file(spark, path, uuid.uuid4().hex)
    return read_file(spark, path)


def _folder(name: str) -> str:
    """A part of a path for any name."""
    return hashlib.sha256(name.encode()).hexdigest()[:16]


def stream_batch_metrics(table: FrameTable, name: str = "stream") -> DataFrame:
    """Rows, failures and depth extent of every micro-batch loaded so far.

    ``stream`` tells the checkpoints apart that loaded under this name.
    """
    loads = table.spark.read.option("recursiveFileLookup", True).parquet(f"{table.root}/loads/{_folder(name)}-*/record")
    place = F.col("_metadata.file_path")
    found = rf"/loads/{_folder(name)}-([0-9a-f]+)-([0-9]+)/record/"
    return (
        loads.withColumn("stream", F.regexp_extract(place, found, 1))
        .withColumn("batch_id", F.regexp_extract(place, found, 2).cast("long"))
        .groupBy("stream", "batch_id")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(F.col("reject").isNotNull()).alias("failed"),
            F.min("depth").alias("depth_min"),
            F.max("depth").alias("depth_max"),
        )
    )
