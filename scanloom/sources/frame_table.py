"""The keyed frame table: Parquet files by depth zone, with a log of versions.

Layout below the root folder::

    data/gen=<generation>/zone=<z>/*.parquet   frames, sorted by depth
    log/<version>.json                         the zones of that version

A zone is a stretch of ``zone_width`` depths. A write makes a new generation of
the zones it touches and leaves all other zones alone; one new log file then
makes it current. Readers see the version before or after, never a mix, and a
job that fails half-way leaves nothing visible. Generations have names of their
own, so that nothing a caller passes becomes part of a path.

Only one of two writers that started from the same version can create the next
log file; the other raises ``StaleVersionError`` and changes nothing.

The log file answers whole-table counts, extents and sizes without reading any
frame, and lets a range read skip the folders outside its bounds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scanloom.operators import keyed
from scanloom.operators.ranges import DEFAULT_LIMIT, check_page_request, depth_page, depth_range
from scanloom.session import create_file, drop_path, fresh_folder, names_in, read_file, size_of

FRAME = T.StructType(
    [
        T.StructField("depth", T.DoubleType(), False),
        T.StructField("image_png", T.BinaryType(), False),
        T.StructField("width", T.IntegerType(), False),
        T.StructField("height", T.IntegerType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), True),
    ]
)
STORED = T.StructType(
    [*FRAME.fields, T.StructField("image_bytes", T.LongType()), T.StructField("zone", T.LongType())]
)
ZONES = T.StructType(
    [
        T.StructField("zone", T.LongType()),
        T.StructField("gen", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("image_bytes", T.LongType()),
        T.StructField("depth_min", T.DoubleType()),
        T.StructField("depth_max", T.DoubleType()),
    ]
)
# Zones beyond this number share one, so that infinite depths have a zone too.
LAST_ZONE = float(1 << 52)
# Frames per write task at least, if cores are free, and stored bytes per task at most.
SMALL_TASK, TASK_BYTES = 20_000, 256 << 20
# Log files kept behind the current one, for readers that are still at them.
KEPT_VERSIONS = 20


class StaleVersionError(RuntimeError):
    """Another writer published a version meanwhile; nothing was changed."""


def write_tasks(rows: int, size: int, cores: int) -> int:
    """Number of range partitions, and so at least of files, for a write of ``rows`` frames of ``size`` bytes."""
    return max(1, min(cores, -(-rows // SMALL_TASK)), -(-size // TASK_BYTES))


@dataclass(frozen=True)
class Zone:
    gen: str
    rows: int
    image_bytes: int
    depth_min: float
    depth_max: float


@dataclass(frozen=True)
class Version:
    """A version of the table as its log file tells it; as long as the list of zones.

    ``writers`` has the last step of each numbered writer, such as a stream.
    """

    number: int
    zone_width: float
    zones: dict[int, Zone] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)
    load_id: str | None = None

    def has(self, writer: tuple[str, int] | None) -> bool:
        return writer is not None and self.writers.get(writer[0], -1) >= writer[1]

    def only(self, zones: Iterable[int]) -> dict[int, Zone]:
        return {z: self.zones[z] for z in sorted(zones) if z in self.zones}


class FrameTable:
    """Opens the table at ``root``; creates it if it is missing."""

    def __init__(self, spark: SparkSession, root: str, zone_width: float = 1000.0):
        self.spark = spark
        self.root = root.rstrip("/")
        if not zone_width > 0:
            raise ValueError(f"zone width must be positive, got {zone_width}")
        if not names_in(spark, f"{self.root}/log"):
            try:
                self._append_log(Version(0, float(zone_width), load_id="create"))
            except StaleVersionError:  # created by another writer just now
                pass
        self.zone_width = self.version().zone_width

    # Reading

    def version(self) -> Version:
        """The current version."""
        newest = max(name for name in names_in(self.spark, f"{self.root}/log") if name.endswith(".json"))
        told = json.loads(read_file(self.spark, f"{self.root}/log/{newest}"))
        told["zones"] = {int(z): Zone(**about) for z, about in told["zones"].items()}
        return Version(**told)

    def zones(self) -> DataFrame:
        """Current zones: generation, rows, image bytes and depth extent of each."""
        rows = [(zone, *asdict(about).values()) for zone, about in self.version().zones.items()]
        columns = list(zip(*rows)) or [()] * len(ZONES)
        arrays = [pa.array(list(c), t) for c, t in zip(columns, to_arrow_schema(ZONES).types)]
        return self.spark.createDataFrame(pa.table(arrays, names=ZONES.fieldNames()), ZONES)

    def _stored(self, zones: dict[int, Zone]) -> DataFrame:
        paths = [f"{self.root}/data/gen={about.gen}/zone={zone}" for zone, about in zones.items()]
        if not paths:
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in STORED]
            return self.spark.range(0).select(*nothing)
        return self.spark.read.schema(STORED).option("basePath", f"{self.root}/data").parquet(*paths).select(*STORED.names)

    def read(self, depth_min: float | None = None, depth_max: float | None = None, sizes: bool = False) -> DataFrame:
        """Frames, within inclusive bounds if given; folders outside them are not opened.

        With ``sizes`` there is a column ``image_bytes``, which is stored and costs no reading of images.
        """
        low = -float("inf") if depth_min is None else float(depth_min)
        high = float("inf") if depth_max is None else float(depth_max)
        zones = {z: about for z, about in self.version().zones.items() if about.depth_max >= low and about.depth_min <= high}
        columns = [*FRAME.fieldNames(), *["image_bytes"] * sizes]
        return depth_range(self._stored(zones).select(*columns), depth_min, depth_max)

    def page(
        self,
        limit: int = DEFAULT_LIMIT,
        offset: int = 0,
        depth_min: float | None = None,
        depth_max: float | None = None,
    ) -> DataFrame:
        """``limit`` frames after skipping ``offset``, by depth, within inclusive bounds if given.

        The log's counts tell which zones the page lies in; the ones before it
        are not opened, however large the offset.
        """
        check_page_request(None, None, limit, offset)
        low = -float("inf") if depth_min is None else float(depth_min)
        high = float("inf") if depth_max is None else float(depth_max)
        chosen, held = {}, 0
        for zone, about in sorted(self.version().zones.items()):
            if about.depth_max < low or about.depth_min > high:
                continue
            rows = about.rows
            if about.depth_min < low:  # only a zone that the lower bound cuts has to be counted
                rows = depth_range(self._stored({zone: about}).select("depth"), low, high).count()
            if not chosen and rows <= offset:
                offset -= rows
                continue
            chosen[zone] = about
            held += rows
            if held >= offset + limit:
                break
        rows = depth_range(self._stored(chosen).select(*FRAME.fieldNames()), depth_min, depth_max)
        return depth_page(rows, limit, offset)

    def metrics(self) -> DataFrame:
        """Total frames, image bytes and depth extent, from the log alone."""
        return self.zones().agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("total_frames"),
            F.min("depth_min").alias("depth_min"),
            F.max("depth_max").alias("depth_max"),
        )

    def sizes(self) -> DataFrame:
        """Number of frames and bytes of their images, from the log alone."""
        zero = F.lit(0).cast("long")
        return self.zones().agg(
            F.coalesce(F.sum("rows"), zero).alias("frames"), F.coalesce(F.sum("image_bytes"), zero).alias("image_bytes")
        )

    # Writing

    def zone_of(self, depth: Column) -> Column:
        """Zone number of a depth; grows with the depth."""
        number = F.floor(F.least(F.greatest(depth / F.lit(self.zone_width), F.lit(-LAST_ZONE)), F.lit(LAST_ZONE)))
        return number.cast("long")

    def upsert(
        self,
        frames: DataFrame,
        load_id: str,
        order: Column | None = None,
        now: datetime | None = None,
        writer: tuple[str, int] | None = None,
    ) -> None:
        """Insert or replace ``frames`` (depth, image_png, width, height).

        ``order`` tells which of several rows of one depth is the last; without
        it depths must not repeat. A null or NaN depth and a null image raise
        before anything changes. ``load_id`` is any text, kept in the log.
        ``writer`` names a writer and its step; a step that is in the table is
        not done again.
        """
        base = self.version()
        if base.has(writer):
            return
        path = fresh_folder(self.spark, "staging")
        rank = order if order is not None else F.lit(0)
        sound = F.col("depth").isNotNull() & ~F.isnan("depth") & F.col("image_png").isNotNull()
        wrong = F.raise_error(F.lit("a frame needs a depth that is a number, and an image")).cast("double")
        depth = F.when(sound, F.col("depth") + F.lit(0.0)).otherwise(wrong)
        chosen = frames.select(depth.alias("depth"), *keyed.PAYLOAD, rank.alias("_order"))
        chosen.write.parquet(path)
        staged = self.spark.read.schema(chosen.schema).parquet(path)
        try:
            size = size_of(self.spark, path)
            self.merge_staged(staged, F.col("_order"), load_id, base, size, now, ordered=order is not None, writer=writer)
        finally:
            drop_path(self.spark, path)

    def merge_staged(
        self,
        staged: DataFrame,
        order: Column,
        load_id: str,
        base: Version,
        size: int,
        now: datetime | None = None,
        replace_all: bool = False,
        ordered: bool = True,
        writer: tuple[str, int] | None = None,
    ) -> None:
        """Merge rows read back from a stored table of ``size`` bytes, which is scanned more than once here."""
        now = now or datetime.now(timezone.utc)
        incoming = staged.withColumn("zone", self.zone_of(F.col("depth")))
        # Depth column only: which zones are touched, and does any depth repeat?
        per_zone = (
            incoming.groupBy("zone", "depth")
            .agg(F.count("*").alias("_times"))
            .groupBy("zone")
            .agg(F.max("_times").alias("_times"), F.count("*").alias("_depths"))
            .collect()
        )
        touched = {row.zone for row in per_zone}
        rows = sum(row["_depths"] for row in per_zone)
        # Only repeated depths need the extra shuffle that keeps the last of each.
        if any(row["_times"] > 1 for row in per_zone):
            if not ordered:
                raise ValueError("a depth occurs more than once: say which row is the last by `order`")
            incoming = keyed.last_wins(incoming, order, keys=("zone", "depth"))
        else:
            incoming = incoming.withColumn("times_seen", F.lit(1))
        old = {} if replace_all else base.only(touched)
        rows += sum(zone.rows for zone in old.values())
        size += sum(zone.image_bytes for zone in old.values())
        tasks = write_tasks(rows, size, self.spark.sparkContext.defaultParallelism)
        by_key = ("zone", "depth")
        if old:
            merged = keyed.upsert_frames(self._stored(old), incoming, now, by_key, range_tasks=tasks)
        else:
            merged = keyed.new_frames(incoming, now, by_key).repartitionByRange(tasks, *by_key)
        if replace_all:
            touched |= base.zones.keys()
        self._publish(merged, touched, load_id, base, writer)

    def delete(self, keys: DataFrame, load_id: str) -> DataFrame:
        """Remove the depths in ``keys``; returns which of them were there.

        The depth column alone tells where there is something to remove; zones
        without it keep their files.
        """
        base = self.version()
        depth = F.col("depth").cast("double") + F.lit(0.0)
        asked = keys.select(depth.alias("depth")).distinct().withColumn("zone", self.zone_of(F.col("depth")))
        near = {row.zone for row in asked.select("zone").distinct().collect()}
        current = self._stored(base.only(near))
        path = fresh_folder(self.spark, "deleted")  # the report reads it, so it stays until the session's folder goes
        found = current.select("zone", "depth", F.lit(True).alias("_hit"))
        asked = asked.join(found, ["zone", "depth"], "left").select("zone", "depth", F.col("_hit").isNotNull().alias("deleted"))
        asked.write.parquet(path)
        asked = self.spark.read.schema(asked.schema).parquet(path)
        hits = asked.where("deleted")
        touched = {row.zone for row in hits.select("zone").distinct().collect()}
        if touched:
            left = self._stored(base.only(touched)).join(hits.select("zone", "depth"), ["zone", "depth"], "left_anti")
            self._publish(left, touched, load_id, base)
        return asked.select("depth", "deleted")

    def clear(self, load_id: str) -> None:
        """Remove all frames."""
        base = self.version()
        self._publish(self._stored({}), base.zones.keys(), load_id, base)

    def _publish(
        self,
        rows: DataFrame,
        touched: Iterable[int],
        load_id: str,
        base: Version,
        writer: tuple[str, int] | None = None,
    ) -> None:
        """Write a new generation of the touched zones, then the log file that makes it current."""
        touched, gen = set(touched), f"{base.number + 1:08d}-{uuid.uuid4().hex[:12]}"
        zones = {z: about for z, about in base.zones.items() if z not in touched}
        path = f"{self.root}/data/gen={gen}"
        if touched:
            merged = Observation()
            (
                rows.select(*FRAME.fieldNames(), F.octet_length("image_png").cast("long").alias("image_bytes"), "zone")
                .observe(merged, F.count(F.lit(1)).alias("rows"))
                .sortWithinPartitions("zone", "depth")
                .write.partitionBy("zone")
                .parquet(path)
            )
            written = self._written(path, gen)
            stored = sum(about.rows for about in written.values())
            if stored != merged.get["rows"] or not written.keys() <= touched:
                raise RuntimeError(f"{merged.get['rows']} rows were merged but {stored} found; nothing was published")
            zones |= written
        writers = {**base.writers, **dict([writer] if writer else [])}
        try:
            self._append_log(Version(base.number + 1, self.zone_width, dict(sorted(zones.items())), writers, load_id))
        except StaleVersionError:
            drop_path(self.spark, path)
            raise

    def _written(self, path: str, gen: str) -> dict[int, Zone]:
        """The zones of a new generation, from its narrow columns."""
        if not names_in(self.spark, path):
            return {}
        stored = self.spark.read.schema(STORED).parquet(path)
        extents = stored.groupBy("zone").agg(F.count("*"), F.sum("image_bytes"), F.min("depth"), F.max("depth"))
        return {zone: Zone(gen, *about) for zone, *about in extents.collect() if zone is not None}

    def _append_log(self, version: Version) -> None:
        """Create the version's file, which one writer alone can do; log files far behind are removed."""
        try:
            create_file(self.spark, self._log_path(version.number), json.dumps(asdict(version)))
        except FileExistsError:
            raise StaleVersionError(f"version {version.number} of {self.root} was published by another writer") from None
        if version.number > KEPT_VERSIONS:
            drop_path(self.spark, self._log_path(version.number - KEPT_VERSIONS - 1))

    def _log_path(self, number: int) -> str:
        return f"{self.root}/log/{number:012d}.json"
