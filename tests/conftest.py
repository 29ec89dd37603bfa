import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from scanloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[8]", 4)


@pytest.fixture
def write_lines(tmp_path):
    """Write a CSV of text cells; returns its path."""

    def write(rows, width=200, name="lines.csv", header=None):
        path = tmp_path / name
        names = header or ["depth", *[f"col{k}" for k in range(1, width + 1)]]
        text = [",".join(names)] + [",".join(str(c) for c in row) for row in rows]
        path.write_text("\n".join(text) + "\n")
        return str(path)

    return write


def ramp(width=200, start=0):
    return [(start + i) % 256 for i in range(width)]


def make(spark, rows, ddl):
    """A small DataFrame, handed over as Arrow data so that no Python worker is needed."""
    schema = T.StructType.fromDDL(ddl)
    target = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [()] * len(target)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, target)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=target.names), schema)
