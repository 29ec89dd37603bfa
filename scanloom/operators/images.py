"""Image bytes: the one stage that leaves the JVM, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions import png
from scanloom.functions.palette import Rgb, check_palette, palette
from scanloom.session import ship_package

PNG_SIGNATURE_SQL = "X'89504E470D0A1A0A'"


def export_images(
    df: DataFrame,
    column: str = "px",
    table: Sequence[Rgb] | None = None,
    height: str | int = 1,
    into: str = "image_png",
) -> DataFrame:
    """Replace a pixel column by PNG bytes, ``width`` and ``height``.

    The column is ``array<int>`` of gray values, coloured here through the
    palette, or ``array<struct<r,g,b>>``. For images of several rows give them
    flattened, with ``height`` as a number or a column. A null array gives a
    null image.
    """
    element = df.schema[column].dataType.elementType
    coloured = isinstance(element, T.StructType)
    colours = np.array(check_palette(table if table is not None else palette()), np.uint8)
    others = [c for c in df.columns if c not in (column, height)]
    rows = df.select(
        *others,
        F.col(column).alias("_pixels"),
        (F.col(height) if isinstance(height, str) else F.lit(height)).cast("int").alias("_height"),
    )
    schema = T.StructType(
        [df.schema[c] for c in others]
        + [
            T.StructField(into, T.BinaryType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("height", T.IntegerType()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = batch.column("_pixels")
            heights = batch.column("_height").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + _encoded(pixels, heights, colours, coloured),
                names=schema.names,
            )

    ship_package(df.sparkSession)
    return rows.mapInArrow(encode, schema)


def _encoded(pixels: pa.ListArray, heights: np.ndarray, colours: np.ndarray, coloured: bool) -> list[pa.Array]:
    """Image, width and height arrays of one batch; equal shapes are encoded together."""
    lengths = pc.fill_null(pc.list_value_length(pixels), 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    flat = pixels.flatten()
    if coloured:
        values = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "rgb"], axis=1).astype(np.uint8)
    else:
        values = colours[flat.to_numpy(zero_copy_only=False)]
    images: list[bytes | None] = [None] * len(lengths)
    widths = np.zeros(len(lengths), np.int32)
    for length, height in {(int(n), int(h)) for n, h in zip(lengths, heights)}:
        if length == 0:
            continue
        if height < 1 or length % height:
            raise ValueError(f"{length} pixels do not fill {height} rows")
        group = np.flatnonzero((lengths == length) & (heights == height))
        width = length // height
        block = values[starts[group][:, None] + np.arange(length)]
        for at, data in zip(group, png.encode_block(block.reshape(len(group), height, width, 3))):
            images[at] = data
        widths[group] = width
    missing = lengths == 0
    return [
        pa.array(images, pa.binary()),
        pa.array(widths, pa.int32(), mask=missing),
        pa.array(heights.astype(np.int32), pa.int32(), mask=missing),
    ]


def decode_images(df: DataFrame, column: str = "image_png", into: str = "rgb") -> DataFrame:
    """Replace image bytes by their pixels, row by row, as ``array<struct<r,g,b>>``; a null image gives null."""
    others = [c for c in df.columns if c != column]
    pixel = T.StructType([T.StructField(c, T.IntegerType()) for c in "rgb"])
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(into, T.ArrayType(pixel))])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = batch.column(column).to_pylist()
            nothing = np.zeros((0, 3))
            decoded = [nothing if v is None else png.decode(v).reshape(-1, 3) for v in images]
            offsets = np.concatenate([[0], np.cumsum([len(d) for d in decoded])]).astype(np.int32)
            flat = np.concatenate(decoded) if decoded else np.zeros((0, 3))
            channels = [pa.array(flat[:, k].astype(np.int32)) for k in range(3)]
            pixels = pa.ListArray.from_arrays(
                pa.array(offsets),
                pa.StructArray.from_arrays(channels, list("rgb")),
                mask=pa.array([v is None for v in images], pa.bool_()),
            )
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pixels], names=schema.names)

    ship_package(df.sparkSession)
    return df.select(*others, column).mapInArrow(decode, schema)


def verify_images(df: DataFrame, column: str = "image_png") -> DataFrame:
    """Per frame: byte size, whether the signature is a PNG's, and the size its header states."""

    def stated(first: int) -> F.Column:
        return F.conv(F.hex(F.substring(column, first, 4)), 16, 10).cast("int")

    return df.select(
        "depth",
        "width",
        "height",
        F.octet_length(column).alias("image_bytes"),
        "created_at",
        (F.substring(column, 1, 8) == F.expr(PNG_SIGNATURE_SQL)).alias("is_png"),
        stated(17).alias("header_width"),
        stated(21).alias("header_height"),
    )
