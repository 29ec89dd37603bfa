"""Wide CSV scan lines: a header, then depth and ``width`` pixels per line.

Columns go by position; header names are free. All cells are read as text, so
a bad cell costs its own row only and types do not depend on how the file is
split.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.operators.reports import side_by_side

# Cell texts read as "no value", besides the empty cell.
MISSING_TEXTS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

SURPLUS = "_record"
MARK = 1000
# Columns a parser is ready for if no width is known; with a width, as many as it needs.
MOST_COLUMNS = 100_000
# Texts that a cast to double takes and a number never is written as: hexadecimal ones and those with a type's letter.
NOT_A_NUMBER = "(?i)[0-9.][df]|0x"
# Where a scanned row comes from, as SQL. The file's metadata column would tell
# the same, but adding it copies all text cells of every row once more.
SOURCE_PLACE = ("input_file_name() AS source_file", "input_file_block_start() AS source_block")


def _first_cells(spark: SparkSession, path: str, most: int = MOST_COLUMNS) -> list[str | None]:
    """The first line of the first file; ``FileNotFoundError`` if there is no file."""
    try:
        rows = spark.read.option("maxColumns", most).csv(path).take(1)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"CSV file not found: {path}") from error
        if "UNABLE_TO_INFER_SCHEMA" in str(error):
            return []
        raise
    return list(rows[0]) if rows else []


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first file, made unique; ``FileNotFoundError`` if there is none."""
    _first_cells(spark, path)
    return spark.read.option("header", True).option("maxColumns", MOST_COLUMNS).csv(path).columns


def _width_error(width: int, found: int) -> ValueError:
    return ValueError(f"Expected {width + 1} columns (1 depth + {width} pixels), got {found}")  # fixed value: the message


def check_width(spark: SparkSession, path: str, width: int = 200) -> list[str] | None:
    """The names in the header; raises ``ValueError`` unless it has one depth and ``width`` pixel columns.

    With these names a scan compares the header of every further file where it
    is read. Names that are empty or repeat cannot be compared: then ``None``
    is returned for a single file, and several files are refused.
    """
    names = _first_cells(spark, path, max(MOST_COLUMNS, width + 2))
    if len(names) != width + 1:
        raise _width_error(width, len(names))
    plain = all(n is not None and n == n.strip() and n for n in names)
    if plain and len({n.lower() for n in names}) == len(names) and SURPLUS not in names:
        return names
    if len(spark.read.text(path).inputFiles()) > 1:
        raise ValueError("column names that are empty or repeat cannot be compared between several files")
    return None


def landed_header(spark: SparkSession, path: str, width: int) -> list[str] | None:
    """The names that files of a folder must have; ``None`` as long as there is no file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").take(1)
    return check_width(spark, found[0].path, width) if found else None


def csv_cells(reader, width: int, names: list[str] | None):
    """A reader of text cells. With ``names`` each file's header is checked by the task that reads its beginning."""
    schema = text_schema(width, names)
    return (
        reader.schema(schema)
        .option("header", True)
        .option("enforceSchema", names is None)
        .option("columnNameOfCorruptRecord", SURPLUS)
        .option("maxColumns", max(MOST_COLUMNS, width + 2))
    )


def check_line_width(df: DataFrame, width: int, column: str = "px") -> DataFrame:
    """Rows with ``reject`` set where the array does not hold ``width`` pixels."""
    wrong = F.col(column).isNull() | (F.size(column) != width)
    return df.withColumn("reject", F.when(wrong, F.lit("bad_width")))


def cell_names(width: int) -> list[str]:
    return [f"c{k}" for k in range(width + 1)]


def text_schema(width: int, names: list[str] | None = None) -> T.StructType:
    """All cells as text, and the whole record where it has the wrong number of cells."""
    return T.StructType([T.StructField(c, T.StringType()) for c in [*(names or cell_names(width)), SURPLUS]])


def scan_lines(spark: SparkSession, path: str, width: int = 200, raw: bool = False) -> DataFrame:
    """Lines with ``depth``, ``px``, ``reject`` and the ``source_*`` position.

    ``px`` holds 0..255 pixels, or with ``raw`` the numbers as written (null
    where a cell is empty or not a number).
    """
    names = check_width(spark, path, width)
    return with_source_row(flag_lines(csv_cells(spark.read, width, names).csv(path), width, raw))


def with_source_row(lines: DataFrame) -> DataFrame:
    """Add ``source_row``, which grows along every split."""
    return lines.withColumn("source_row", F.monotonically_increasing_id())


def flag_lines(cells: DataFrame, width: int, raw: bool = False) -> DataFrame:
    """Turn the text cells of a scan, or of a stream, into flagged lines."""
    names = cell_names(width)
    cells = cells.toDF(*names, SURPLUS)
    number = ~F.coalesce(F.col(names[0]).rlike(NOT_A_NUMBER), F.lit(False))
    # Adding zero turns -0.0 into 0.0, the same key.
    depth = F.when(number, F.col(names[0]).try_cast("double")) + F.lit(0.0)
    # One look at all cells together finds the few texts that a cast would wrongly take.
    suspect = F.concat_ws(",", *names[1:]).rlike(NOT_A_NUMBER)
    if raw:
        own = F.transform(F.array(*names[1:]), lambda c: F.when(~c.rlike(NOT_A_NUMBER), c))
        px = F.when(suspect, own).otherwise(F.array(*names[1:])).try_cast("array<double>")
    else:
        px = F.expr("array(" + ", ".join(_pixel(c) for c in names[1:]) + ")")
    lines = cells.select(
        depth.alias("depth"),
        px.alias("px"),
        F.when(_too_many_cells(width), F.lit("too_many_cells"))
        .when(depth.isNull() | F.isnan(depth), F.lit("bad_depth"))
        .alias("reject"),
        F.col(names[0]).alias("depth_text"),
        *[F.expr(place) for place in SOURCE_PLACE],
        suspect.alias("_suspect"),
    )
    if raw:
        return lines.drop("_suspect")
    # A pixel that is not a number is marked by a negative value.
    bad = F.col("_suspect") | (F.array_min("px") < 0)
    return lines.withColumn("reject", F.coalesce("reject", F.when(bad, F.lit("bad_pixel")))).drop("_suspect")


def _pixel(cell: str) -> str:
    number = f"try_cast({cell} AS DOUBLE)"
    missing = ", ".join(f"'{text}'" for text in MISSING_TEXTS)
    return (
        f"CAST(least(greatest(nanvl(coalesce({number}, 0D), 0D), 0D), 255D) AS INT)"
        f" - IF({number} IS NULL AND NOT coalesce(trim({cell}), 'NA') IN ({missing}), {MARK}, 0)"
    )


def _too_many_cells(width: int) -> Column:
    # A line with too few cells is padded with missing ones, as a table reader does.
    # Commas inside quotes separate nothing.
    record = F.regexp_replace(SURPLUS, r'"(\\.|[^"\\])*"', "")
    return F.col(SURPLUS).isNotNull() & (F.size(F.split(record, ",")) > width + 1)


def scan_lines_strict(spark: SparkSession, path: str, width: int = 200, placed: bool = False) -> DataFrame:
    """Lines of whole-number cells; any other cell, or an empty one, ends the job with an error.

    Columns go by name: ``depth`` and ``col1`` to ``col<width>``, in any order;
    every file must have those of the first, in the same order. With ``placed``
    there are the columns of :func:`scan_lines` besides, for a load.
    """
    names = check_width(spark, path, width)
    wanted = ["depth", *[f"col{k}" for k in range(1, width + 1)]]
    if names is None or sorted(names) != sorted(wanted):
        missing = sorted(set(wanted) - set(names or []))
        raise ValueError(f"columns missing in a strict load: {', '.join(missing[:5]) or 'names repeat'}")
    schema = T.StructType([T.StructField(n, T.DoubleType() if n == "depth" else T.IntegerType()) for n in names])
    cells = (
        spark.read.schema(schema)
        .options(header=True, enforceSchema=False, mode="FAILFAST", maxColumns=max(MOST_COLUMNS, width + 2))
        .csv(path)
    )
    filled = "coalesce({}, CAST(raise_error('empty cell in a strict load') AS {}))"
    pixels = ", ".join(f"least(greatest({filled.format(c, 'INT')}, 0), 255)" for c in wanted[1:])
    depth = F.expr(filled.format("depth", "DOUBLE"))
    lines = cells.select(
        depth.alias("depth"),
        F.expr(f"array({pixels})").alias("px"),
        F.when(F.isnan("depth"), F.lit("bad_depth")).alias("reject"),
        F.col("depth").cast("string").alias("depth_text"),
        *[F.expr(place) for place in SOURCE_PLACE],
    )
    return with_source_row(lines) if placed else lines.select("depth", "px")


def profile_lines(spark: SparkSession, path: str, sample_rows: int = 5) -> DataFrame:
    """One row about a CSV: counts, names, column types, first depths, sizes in MB."""
    names = header(spark, path)
    cells = [f"`{c.replace('`', '``')}`" for c in names]
    rows = spark.read.option("header", True).option("maxColumns", max(MOST_COLUMNS, len(names) + 1)).csv(path)
    place = F.struct(*[F.expr(p) for p in SOURCE_PLACE], F.monotonically_increasing_id().alias("row"))
    # Every row is one array of cells; what a column holds is counted place by place, before and after one shuffle.
    column = (
        rows.select(F.posexplode(F.array(*cells)).alias("k", "cell"))
        .groupBy("k")
        .agg(_kind(F.col("cell")).alias("kind"))
        .withColumn("name", F.element_at(F.array(*[F.lit(c) for c in names]), F.col("k") + 1))
    )
    types = column.agg(F.map_from_entries(F.collect_list(F.struct("name", "kind"))).alias("column_types"))
    first = rows.select(place.alias("_place"), F.expr(f"try_cast({cells[0]} AS DOUBLE)").alias("d"))
    first = first.orderBy("_place").limit(sample_rows)
    seen = first.agg(F.array_sort(F.collect_list(F.struct("_place", "d"))).alias("seen"))
    depths = seen.select(F.transform("seen", lambda entry: entry["d"]).alias("sample_depths"))
    counted = rows.agg(F.count("*").alias("num_rows"))
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("bytes"))
    return side_by_side(counted, size, types, depths).select(
        "num_rows",
        F.lit(len(names)).alias("num_cols"),
        F.lit(names[0]).alias("first_column"),
        F.lit(len(names) - 1).alias("num_pixel_columns"),
        "column_types",
        "sample_depths",
        (F.col("num_rows") * F.lit(len(names) * 8) / F.lit(1048576.0)).alias("memory_estimate_mb"),
        (F.col("bytes") / F.lit(1048576.0)).alias("file_size_mb"),
    )


def _kind(cell: Column) -> Column:
    """bigint, double or string, by all cells of the column."""
    filled = F.count(cell)
    return (
        F.when(filled == 0, "double")
        .when((F.count(cell.try_cast("bigint")) == F.count("*")) & ~F.bool_or(cell.contains(".")), "bigint")
        .when(F.count(cell.try_cast("double")) == filled, "double")
        .otherwise("string")
    )
