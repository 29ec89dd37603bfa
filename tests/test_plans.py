"""The plans stay the ones wanted."""

from datetime import datetime

import __spark_entry__ as registry
from scanloom.catalog import views
from scanloom.functions import pixels
from scanloom.operators import keyed, ranges
from scanloom.plans.process import process_lines
from scanloom.sources.frame_table import FrameTable
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return sum(line.lstrip(" :+-*()0123456789").startswith("Exchange ") for line in plan(df).splitlines())


def test_range_reaches_the_scan(spark):
    text = plan(ranges.depth_range(views.readings(spark, SF_DIR), 1.0, 2.0))
    assert "GreaterThanOrEqual(o_totalprice,1.0)" in text and "LessThanOrEqual(o_totalprice,2.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_page_is_a_bounded_sort(spark):
    text = plan(ranges.depth_page(views.readings(spark, SF_DIR), 50, 100))
    assert "TakeOrderedAndProject(limit=150" in text and "Exchange range" not in text


def test_processing_needs_no_shuffle_and_computes_pixels_once(spark):
    df = process_lines(views.lines(spark, SF_DIR), 64, 48)
    assert shuffles(df) == 0
    resized = pixels.unfold(pixels.resize_lines(pixels.clamp_pixels(views.lines(spark, SF_DIR), 64), 64, 48), "px", "depth")
    assert shuffles(resized) == 0
    assert plan(resized).count("lambda n") <= 8


def test_count_reads_no_images(spark, tmp_path):
    table = FrameTable(spark, str(tmp_path / "t"), 500.0)
    table.upsert(views.loads(spark, SF_DIR), "a", order=F.col("o_orderkey"))
    assert "ReadSchema: struct<depth:double>" in plan(ranges.count_frames(table.read(), 1.0, 50.0))
    assert "PushedFilters: [IsNotNull(depth), GreaterThanOrEqual(depth,1.0)" in plan(table.read(1.0, 50.0))


def test_upsert_shuffles_once(spark):
    rows = views.loads(spark, SF_DIR)
    current = rows.selectExpr("*", "timestamp'2024-01-01' AS created_at", "timestamp'2024-01-01' AS updated_at")
    incoming = rows.withColumn("times_seen", F.lit(1))
    now = datetime(2024, 1, 1)
    assert shuffles(keyed.upsert_frames(current, incoming, now)) == 1
    assert shuffles(keyed.upsert_frames(current, incoming, now, range_tasks=3)) == 1


def test_last_wins_combines_before_the_shuffle_and_fetches_images_late(spark):
    df = keyed.last_wins(views.loads(spark, SF_DIR), F.col("o_orderkey"))
    df.collect()  # the adaptive plan is final once run
    text = plan(df)
    assert "SortAggregate" not in text and "max_by" not in text  # no aggregation holds an image
    assert "partial_max(_order" in text[text.index("Exchange hashpartitioning(depth") :]  # narrow, combined per task
    assert "WindowGroupLimit" in text  # at most one image per key and task is dealt out


def test_no_query_plans_a_cross_join(spark):
    for name in ("page_metadata", "profile_lines", "validate_load", "running_totals", "page_walk", "upsert_frames"):
        text = plan(registry.queries()[name](spark, SF_DIR))
        assert "CartesianProduct" not in text and "NestedLoop" not in text
