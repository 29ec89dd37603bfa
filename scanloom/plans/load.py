"""Loading a CSV into a frame table."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.operators import reports
from scanloom.operators.keyed import PAYLOAD, file_order
from scanloom.operators.numbering import number_file_rows
from scanloom.plans.process import process_lines
from scanloom.session import drop_path, size_of
from scanloom.sources.csv_lines import scan_lines, scan_lines_strict
from scanloom.sources.frame_table import FrameTable


@dataclass(frozen=True)
class LoadReport:
    """What a load did; the frames below are computed when asked for.

    ``flagged`` is the stored record of all rows read, without their images.
    """

    flagged: DataFrame
    batch_size: int
    source_width: int
    target_width: int
    seconds: float

    @property
    def summary(self) -> DataFrame:
        return reports.load_summary(
            self.flagged, self.batch_size, self.source_width, self.target_width, self.seconds
        )

    @property
    def status(self) -> DataFrame:
        return reports.load_status(self.summary)

    @property
    def rejects(self) -> DataFrame:
        return reports.quarantine(self.flagged)[1]

    @property
    def batches(self) -> DataFrame:
        """Blocks of rows in file order: sizes, failures, depth extents."""
        return reports.batch_profile(number_file_rows(self.flagged), self.batch_size)


def reload_frames(
    spark: SparkSession,
    table: FrameTable,
    path: str,
    load_id: str,
    source_width: int = 200,
    target_width: int = 150,
    batch_size: int = 500,
    clear_existing: bool = False,
    now: datetime | None = None,
    strict: bool = False,
) -> LoadReport:
    """Load all lines of a CSV, every time it is called; by default on top of the frames that are there.

    A missing file, or any file with a wrong number of columns, raises before
    anything changes; so does a file without lines if the table would be
    cleared. With ``clear_existing`` the old frames vanish in the same version
    in which the new ones appear. ``load_id`` is any text for the log.
    ``strict`` takes columns by name and whole numbers only.
    """
    lines = scan_lines_strict(spark, path, source_width, placed=True) if strict else scan_lines(spark, path, source_width)
    return load_lines(table, lines, load_id, source_width, target_width, batch_size, clear_existing, now)


def load_lines(
    table: FrameTable,
    lines: DataFrame,
    load_id: str,
    source_width: int = 200,
    target_width: int = 150,
    batch_size: int = 500,
    clear_existing: bool = False,
    now: datetime | None = None,
    writer: tuple[str, int] | None = None,
    folder: str | None = None,
) -> LoadReport:
    """Load flagged lines (see :func:`scan_lines`).

    The text is parsed and the images are encoded once: one pass without a
    shuffle writes rows to a folder of the load, split into good and rejected.
    What follows reads those files, most of it the depth column only. The
    record of all rows stays there. A step of a ``writer`` that is in the table
    is not done again; such loads name their ``folder``, so that its record is
    found.
    """
    spark, started = table.spark, time.monotonic()
    kept = f"{table.root}/loads/{folder or uuid.uuid4().hex}"
    frames = process_lines(lines, source_width, target_width, clamped=True)
    record = T.StructType([f for f in frames.schema if f.name not in PAYLOAD])
    base = table.version()
    if not base.has(writer):
        staged = frames.withColumn("ok", F.col("reject").isNull())
        staged.write.partitionBy("ok").mode("overwrite").parquet(f"{kept}/rows")
        staged = spark.read.schema(staged.schema).parquet(f"{kept}/rows")
        staged.select(*record.names).write.mode("overwrite").parquet(f"{kept}/record")
        if clear_existing and staged.isEmpty():
            raise ValueError("the CSV has no lines; the table was not cleared")
        size = size_of(spark, f"{kept}/rows")
        table.merge_staged(
            staged.where("ok"), file_order(), load_id, base, size, now, replace_all=clear_existing, writer=writer
        )
        drop_path(spark, f"{kept}/rows")
    flagged = spark.read.schema(record).parquet(f"{kept}/record")
    return LoadReport(flagged, batch_size, source_width, target_width, time.monotonic() - started)
