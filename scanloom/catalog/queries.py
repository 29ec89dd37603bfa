"""One function per registered query: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.catalog.views import (
    EARLIER,
    NOW,
    TARGET,
    WIDTH,
    batches,
    clock_text,
    lines,
    loads,
    readings,
    table,
    write_csv,
)
from scanloom.functions import pixels
from scanloom.operators import images, keyed, numbering, quality, ranges, reports
from scanloom.plans.load import reload_frames
from scanloom.plans.process import process_lines
from scanloom.session import fresh_folder
from scanloom.sources import csv_lines
from scanloom.sources.frame_table import FrameTable
from scanloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def named(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def query(function: Query) -> Query:
    return named(function.__name__)(function)


def _rgb_rows(df: DataFrame, column: str = "rgb") -> DataFrame:
    return pixels.unfold(df, column, "depth", value="c").select("depth", "x", "c.r", "c.g", "c.b")


def _pixel_rows(df: DataFrame) -> DataFrame:
    return pixels.unfold(df, "px", "depth")


def _image_sums(frames: DataFrame) -> DataFrame:
    """Frames with a position-weighted sum of their decoded colours in place of the bytes."""
    decoded = images.decode_images(frames).withColumn("_at", F.sequence(F.lit(1), F.size("rgb")))
    weighted = F.zip_with("rgb", "_at", lambda c, at: (c["r"] + 2 * c["g"] + 3 * c["b"]) * at)
    total = F.aggregate(weighted, F.lit(0).cast("long"), lambda a, v: a + v)
    return decoded.withColumn("colour_sum", total).drop("rgb", "_at")


# Sources and sinks


@query
def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_csv(lines(spark, sf_dir), F.col("px"))
    scanned = csv_lines.scan_lines(spark, path, WIDTH, raw=True)
    return pixels.unfold(scanned, "px", "depth", value="value")


@query
def scan_lines_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("px", lambda v: v.cast("int"))
    path = write_csv(lines(spark, sf_dir), whole, by_name=True)
    return _pixel_rows(csv_lines.scan_lines_strict(spark, path, WIDTH))


@query
def profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("px", lambda v: v.cast("int"))
    path = write_csv(lines(spark, sf_dir), whole)
    profile = csv_lines.profile_lines(spark, path)
    return profile.select(
        "num_rows",
        "num_cols",
        "first_column",
        "num_pixel_columns",
        F.col("column_types")["depth_m"].alias("depth_type"),
        F.col("column_types")["p63"].alias("last_pixel_type"),
        F.concat_ws(" ", F.transform("sample_depths", lambda d: d.cast("long").cast("string"))).alias("sample_depths"),
        "memory_estimate_mb",
        (F.col("file_size_mb") > 0).alias("has_size"),
    )


@query
def check_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files of one width is read; one file without the last pixel ends the scan of the folder."""
    rows, folder = lines(spark, sf_dir), fresh_folder(spark, "widths")
    # Folders by label; that of label 3 is cut, and a scan meets it after others.
    write_csv(rows.where("label <> 3"), F.col("px"), path=f"{folder}/even/whole")
    write_csv(rows.where("label <> 3"), F.col("px"), path=f"{folder}/mixed/part-1")
    write_csv(rows.where("label = 3"), F.col("px"), path=f"{folder}/mixed/part-2", width=WIDTH - 1)
    outcomes = []
    for case in ("even", "mixed"):
        try:
            good = csv_lines.scan_lines(spark, f"{folder}/{case}/*", WIDTH).where("reject IS NULL")
            outcomes.append((case, good.count(), False))
        except (PySparkException, Py4JJavaError) as error:
            if "CSV header" not in str(error):
                raise
            outcomes.append((case, 0, True))
    cells = [f"STRUCT('{case}' AS files, {n} AS lines, {refused} AS refused)" for case, n, refused in outcomes]
    table_of = spark.range(1).select(F.expr(f"inline(array({', '.join(cells)}))"))
    return table_of.withColumn("lines", F.col("lines").cast("long"))


@query
def batch_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = numbering.number_rows(batches(spark, sf_dir), "event_id")
    return reports.batch_profile(numbered, 500)


def _loaded_table(spark: SparkSession, sf_dir: str, zone_width: float = 500.0) -> FrameTable:
    frames = FrameTable(spark, fresh_folder(spark, "frames"), zone_width)
    frames.upsert(loads(spark, sf_dir), "first", order=F.col("o_orderkey"), now=NOW)
    return frames


def _frame_rows(frames: DataFrame) -> DataFrame:
    return frames.select(
        "depth",
        F.decode("image_png", "UTF-8").alias("image_text"),
        "width",
        "height",
        clock_text("created_at").alias("created_at"),
        clock_text("updated_at").alias("updated_at"),
    )


@query
def write_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame_rows(_loaded_table(spark, sf_dir).read())


@query
def export_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = pixels.clamp_pixels(lines(spark, sf_dir), WIDTH).select("depth", "px")
    return _rgb_rows(images.decode_images(images.export_images(gray)))


@query
def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.page_json(loads(spark, sf_dir).withColumn("depth", F.col("o_orderkey").cast("double")))


@query
def verify_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = process_lines(lines(spark, sf_dir), WIDTH, TARGET).withColumn("created_at", F.lit(NOW))
    # Images of every seventh depth are no PNG and too short for a header.
    spoiled = F.when(F.col("depth") % 7 == 0, F.encode(F.lit("spoiled"), "UTF-8")).otherwise(F.col("image_png"))
    checked = images.verify_images(frames.withColumn("image_png", spoiled))
    checked = checked.fillna(0, ["header_width", "header_height"])
    return checked.select(
        "depth",
        "width",
        "height",
        (F.col("image_bytes") > 57).alias("has_data"),
        "is_png",
        "header_width",
        "header_height",
    )


# Pixel work


@query
def clamp_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixel_rows(pixels.clamp_pixels(lines(spark, sf_dir), WIDTH))


@query
def resize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = pixels.clamp_pixels(lines(spark, sf_dir), WIDTH)
    return _pixel_rows(pixels.resize_lines(gray, WIDTH, TARGET))


@query
def resize_lines_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = pixels.clamp_pixels(lines(spark, sf_dir), WIDTH).select("depth", "px")
    for method in ("nearest", "bicubic", "lanczos"):
        gray = gray.withColumn(method, F.col("px"))
        gray = pixels.resize_lines(gray, WIDTH, TARGET, method, method)
    # The three results are unfolded together, so the lines are read once.
    together = gray.withColumn("v", F.arrays_zip("nearest", "bicubic", "lanczos"))
    return pixels.unfold(together, "v", "depth", value="v").select("depth", "x", "v.nearest", "v.bicubic", "v.lanczos")


@query
def colour_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = pixels.clamp_pixels(lines(spark, sf_dir), WIDTH)
    return _rgb_rows(pixels.colour_lines(gray))


@named("process_lines")
def _process_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = process_lines(lines(spark, sf_dir), WIDTH, TARGET)
    return _rgb_rows(images.decode_images(frames.where("reject IS NULL").select("depth", "image_png")))


@query
def resize_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each line as an image of 8 rows of 8 pixels.
    gray = pixels.clamp_pixels(lines(spark, sf_dir), WIDTH)
    square = gray.withColumn(
        "image", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("px", y * 8 + 1, F.lit(8)))
    )
    coloured = pixels.colour_images(pixels.resize_images(square, 8, 6))
    rows = pixels.unfold(coloured, "rgb", "depth", value="row").withColumnRenamed("x", "y")
    return pixels.unfold(rows, "row", "depth", "y", value="c").select("depth", "y", "x", "c.r", "c.g", "c.b")


# Reads


@query
def depth_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.depth_range(readings(spark, sf_dir), 100000.0, 200000.0)


@query
def depth_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame_rows(ranges.depth_lookup(_loaded_table(spark, sf_dir).read(100.0, 100.0), 100.0))


@query
def depth_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.depth_page(readings(spark, sf_dir), 50, 100, ("depth", "o_orderkey"))


@query
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far into the table: found by rank selection, not by sorting all rows before it."""
    return ranges.depth_page(readings(spark, sf_dir), 100, 12_000, ("depth", "o_orderkey"))


@query
def page_has_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir)
    return ranges.page_has_more(rows, 100000.0, 200000.0, 100, 20, ("depth", "o_orderkey"))


@query
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir)
    return ranges.page_metadata(rows, 100000.0, 200000.0, 100, 20, ("depth", "o_orderkey"))


@query
def page_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.page_walk(readings(spark, sf_dir), 100, ("depth", "o_orderkey"))


@query
def frame_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    later = F.col("o_orderdate") + F.expr("INTERVAL 36 HOURS 250 MILLISECONDS")
    frames = orders.select(
        F.col("o_orderkey").cast("double").alias("depth"),
        F.encode("o_orderpriority", "UTF-8").alias("image_png"),
        F.length("o_orderpriority").alias("width"),
        F.lit(1).alias("height"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", later).alias("updated_at"),
    )
    return ranges.frame_metadata(frames)


@query
def count_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.count_frames(readings(spark, sf_dir), 150000.0, 300000.0)


@query
def depth_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.depth_extent(readings(spark, sf_dir))


@query
def table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a table of many zones, within bounds that cut the first of them."""
    return _frame_rows(_loaded_table(spark, sf_dir, zone_width=25.0).page(30, 60, depth_min=10.0, depth_max=140.0))


@query
def store_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded_table(spark, sf_dir).metrics()


# Keyed writes


@query
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = keyed.last_wins(loads(spark, sf_dir), F.col("o_orderkey"))
    return last.select(
        "depth", F.decode("image_png", "UTF-8").alias("image_text"), "width", "height", "times_seen"
    )


@query
def upsert_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are there already; all others are loaded over them."""
    rows, finished = loads(spark, sf_dir), F.col("o_orderstatus") == "F"
    nothing = F.lit(None).cast("timestamp")
    current = keyed.last_wins(rows.where(finished), F.col("o_orderkey")).select(
        "depth",
        *keyed.PAYLOAD,
        F.lit(EARLIER).alias("created_at"),
        nothing.alias("updated_at"),
    )
    incoming = keyed.last_wins(rows.where(~finished), F.col("o_orderkey"))
    return _frame_rows(keyed.upsert_frames(current, incoming, NOW))


@query
def upsert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a frame table, with load names that no folder could have."""
    rows, finished = loads(spark, sf_dir), F.col("o_orderstatus") == "F"
    frames = FrameTable(spark, fresh_folder(spark, "frames"), zone_width=500.0)
    frames.upsert(rows.where(finished), "run=5", order=F.col("o_orderkey"), now=EARLIER)
    frames.upsert(rows.where(~finished), "a%b/2024-06-01T10:00", order=F.col("o_orderkey"), now=NOW)
    return _frame_rows(frames.read())


@query
def delete_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt lose their frame: every such key with whether it had one, and what is left."""
    frames = _loaded_table(spark, sf_dir)
    customers = table(spark, sf_dir, "customer")
    keys = customers.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").cast("double").alias("depth"))
    report = frames.delete(keys, "debtors")
    left = frames.read().select("depth", F.lit("kept").alias("outcome"))
    gone = report.select("depth", F.when(F.col("deleted"), "deleted").otherwise("absent").alias("outcome"))
    return left.unionByName(gone)


def _reloaded(spark: SparkSession, sf_dir: str, clear_existing: bool) -> DataFrame:
    """Lines of labels below 5 lie shifted by half a depth or in place; then all lines are loaded."""
    rows = lines(spark, sf_dir)
    old = process_lines(rows.where(F.col("label") < 5), WIDTH, TARGET)
    moved = F.when(F.col("label") < 2, F.col("depth") + 0.5).otherwise(F.col("depth"))
    frames = FrameTable(spark, fresh_folder(spark, "frames"), zone_width=100.0)
    frames.upsert(old.withColumn("depth", moved), "old", now=EARLIER)
    path = write_csv(rows, F.col("px"))
    reload_frames(spark, frames, path, "all", WIDTH, TARGET, clear_existing=clear_existing, now=NOW)
    return _image_sums(frames.read()).select(
        "depth",
        "width",
        "height",
        clock_text("created_at").alias("created_at"),
        clock_text("updated_at").alias("updated_at"),
        "colour_sum",
    )


@named("reload_frames")
def _reload_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reloaded(spark, sf_dir, clear_existing=False)


@query
def reload_frames_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reloaded(spark, sf_dir, clear_existing=True)


# Accounting and checks


@query
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.load_summary(batches(spark, sf_dir)).drop("duration_seconds", "rows_per_second")


@query
def load_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.load_status(reports.load_summary(batches(spark, sf_dir)).drop("duration_seconds"))


def _spoiled_csv(spark: SparkSession, sf_dir: str, split_by: str | None = None) -> str:
    """Labels 1, 2, 4 and 5 get a bad depth and bad pixels; label 3 an empty cell, which is allowed."""
    label = F.col("label")
    cell = F.when(label == 2, F.lit("abc")).when(label == 3, F.lit("")).when(label == 4, "5d").when(label == 5, "0x1p3")
    cells = F.transform("px", lambda v, k: F.when(k == 6, F.coalesce(cell, v.cast("string"))).otherwise(v.cast("string")))
    depth = F.when(label == 1, F.lit("deep")).otherwise(F.col("depth").cast("string"))
    return write_csv(lines(spark, sf_dir), cells, depth, split_by)


@query
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = csv_lines.scan_lines(spark, _spoiled_csv(spark, sf_dir), WIDTH).drop("px")
    path = fresh_folder(spark, "scan")
    scanned.write.parquet(path)
    numbered = numbering.number_file_rows(spark.read.parquet(path))
    return reports.quarantine(numbered)[1].select("row_no", "depth_text", F.col("reject").alias("reason"))


@query
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = numbering.number_rows(batches(spark, sf_dir), "event_id")
    return reports.running_totals(reports.batch_profile(numbered, 500))


@query
def validate_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, of which the table keeps the last per customer; and just those, with other orders rejected."""
    rows, held = loads(spark, sf_dir), _loaded_table(spark, sf_dir).read()
    nothing = F.lit(None).cast("string")
    last = held.select("depth", nothing.alias("reject"))
    rejected = rows.where("o_orderstatus = 'P'").select("depth", F.lit("bad_pixel").alias("reject"))
    cases = [rows.withColumn("reject", nothing), last.unionByName(rejected)]
    checks = [reports.validate_load(reports.load_summary(flagged), held) for flagged in cases]
    return checks[0].unionByName(checks[1])


@query
def size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate is that of the frames of a load of 100 that took two seconds."""
    return reports.size_estimate(_loaded_table(spark, sf_dir).read(sizes=True), seconds=2.0, stored=100)


@query
def line_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = pixels.clamp_pixels(lines(spark, sf_dir), WIDTH)
    return quality.line_gradients(pixels.resize_lines(gray, WIDTH, TARGET), TARGET)


@query
def uniform_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Lines labelled 0 take their first pixel throughout.
    flat = F.when(F.col("label") == 0, F.array_repeat(F.col("px")[0], WIDTH)).otherwise(F.col("px"))
    gray = pixels.clamp_pixels(lines(spark, sf_dir).withColumn("px", flat), WIDTH)
    resized = pixels.resize_lines(gray.withColumn("resized", F.col("px")), WIDTH, TARGET, column="resized")
    return quality.uniform_lines(resized)


# Incremental loading


def _streamed(spark: SparkSession, sf_dir: str) -> FrameTable:
    path = _spoiled_csv(spark, sf_dir, split_by="label")
    frames = FrameTable(spark, fresh_folder(spark, "frames"), zone_width=100.0)
    run = ingest.stream_ingest(
        spark, frames, path, fresh_folder(spark, "offsets"), WIDTH, TARGET, files_per_batch=1, now=NOW
    )
    run.awaitTermination()
    return frames


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _image_sums(_streamed(spark, sf_dir).read()).select(
        "depth", "width", "height", clock_text("created_at").alias("created_at"), "colour_sum"
    )


@query
def stream_two_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams of one name, each with its own checkpoint, load even and odd lines into one table."""
    rows = lines(spark, sf_dir)
    frames = FrameTable(spark, fresh_folder(spark, "frames"), zone_width=100.0)
    for part in (0, 1):
        path = write_csv(rows.where(F.col("depth") % 2 == part), F.col("px"))
        run = ingest.stream_ingest(spark, frames, path, fresh_folder(spark, "offsets"), WIDTH, TARGET, now=NOW)
        run.awaitTermination()
    return _image_sums(frames.read()).select("depth", "width", "height", "colour_sum")


@query
def stream_batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One file per label; which batch takes which file depends on their times.
    return ingest.stream_batch_metrics(_streamed(spark, sf_dir)).drop("stream", "batch_id")
