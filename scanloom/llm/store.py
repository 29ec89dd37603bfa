"""Intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scanloom.session import fresh_folder, ship_package


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read from there: nothing before is computed again."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_python(df: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(work, schema)


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal leading columns of sorted rows; a run may span batches."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        change[0] = bool(kept) and any(kept[-1].column(k)[-1].as_py() != columns[k][0] for k in range(keys))
        first = 0
        for at in np.flatnonzero(change):
            if at > first:
                kept.append(batch.slice(first, at - first))
            if kept:
                yield pa.Table.from_batches(kept)
            kept, first = [], int(at)
        kept.append(batch.slice(first))
    if kept:
        yield pa.Table.from_batches(kept)
