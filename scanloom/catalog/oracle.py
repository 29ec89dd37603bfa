"""The registered queries as SQL over the same tables, for DuckDB."""

from __future__ import annotations

NOW = "2024-06-01 00:00:00"
EARLIER = "2024-01-01 00:00:00"

# Raw pixels, one row each.
LINES = """lines AS (
  SELECT CAST(vec_id AS DOUBLE) AS depth, label, CAST(i - 1 AS INTEGER) AS x,
         (CAST(e AS DOUBLE) + 0.5) * 256 AS v
  FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)
)"""
GRAY = """gray AS (
  SELECT depth, label, x, CAST(trunc(least(greatest(v, 0), 255)) AS INTEGER) AS pixel FROM lines
)"""
# Gray level -> colour, straight lines between five stops.
PALETTE = """stops(lo, hi, r0, g0, b0, r1, g1, b1) AS (VALUES
  (0, 64, 0, 0, 139, 0, 139, 139), (64, 128, 0, 139, 139, 0, 200, 100),
  (128, 192, 0, 200, 100, 255, 215, 0), (192, 255, 255, 215, 0, 255, 69, 0)
), palette AS (
  SELECT CAST(i AS INTEGER) AS level,
         CAST((r0 * (hi - i) + r1 * (i - lo)) // (hi - lo) AS INTEGER) AS r,
         CAST((g0 * (hi - i) + g1 * (i - lo)) // (hi - lo) AS INTEGER) AS g,
         CAST((b0 * (hi - i) + b1 * (i - lo)) // (hi - lo) AS INTEGER) AS b
  FROM generate_series(0, 255) AS levels(i)
  JOIN stops ON i >= lo AND (i < hi OR (i = 255 AND hi = 255))
)"""

KERNELS = {
    "bilinear": (1, "greatest(0, 1 - abs(t))"),
    "bicubic": (
        2,
        "CASE WHEN abs(t) < 1 THEN 1.5 * abs(t)**3 - 2.5 * t * t + 1"
        " WHEN abs(t) < 2 THEN -0.5 * abs(t)**3 + 2.5 * t * t - 4 * abs(t) + 2 ELSE 0 END",
    ),
    "lanczos": (
        3,
        "CASE WHEN t = 0 THEN 1 WHEN abs(t) < 3"
        " THEN sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) ELSE 0 END",
    ),
}


def _taps(name: str, source: int, target: int, method: str = "bilinear") -> str:
    """CTE ``name(x, k, w)``: integer weight of source pixel k in output pixel x."""
    support, kernel = KERNELS[method]
    ratio = f"(CAST({source} AS DOUBLE) / {target})"
    stretch = f"greatest({ratio}, 1)"
    return f"""{name} AS (
  SELECT x, k, CAST(trunc(w / sum(w) OVER (PARTITION BY x) * 4194304 + sign(w) * 0.5) AS BIGINT) AS w FROM (
    SELECT x, k, CAST({kernel} AS DOUBLE) AS w FROM (
      SELECT x, k, (k - centre + 0.5) / {stretch} AS t
      FROM (SELECT x, (x + 0.5) * {ratio} AS centre FROM generate_series(0, {target - 1}) AS outs(x)),
           generate_series(0, {source - 1}) AS ins(k)
      WHERE k >= trunc(centre - {support} * {stretch} + 0.5) AND k < trunc(centre + {support} * {stretch} + 0.5)
    )
  )
)"""


def _resized(name: str, taps: str, rows: str = "gray", keys: str = "depth") -> str:
    """CTE ``name(keys, x, pixel)``: ``rows`` resized by a tap table."""
    return f"""{name} AS (
  SELECT {keys}, CAST({taps}.x AS INTEGER) AS x,
         CAST(least(greatest(floor((sum(pixel * w) + 2097152) / 4194304.0), 0), 255) AS INTEGER) AS pixel
  FROM {rows} JOIN {taps} ON {rows}.x = {taps}.k
  GROUP BY {keys}, {taps}.x
)"""


NEAREST = """steps AS (
  WITH RECURSIVE walk(x, p) AS (
    SELECT 0, CAST(64 AS DOUBLE) / 48 * 0.5
    UNION ALL SELECT x + 1, p + CAST(64 AS DOUBLE) / 48 FROM walk WHERE x < 47
  ) SELECT x, CAST(trunc(p) AS INTEGER) AS k FROM walk
), near AS (SELECT depth, steps.x, pixel FROM gray JOIN steps ON gray.x = steps.k)"""

RESIZED = f"{LINES}, {GRAY}, {_taps('taps', 64, 48)}, {_resized('small', 'taps')}"

LOADED = f"""loaded AS (
  SELECT CAST(o_custkey AS DOUBLE) AS depth, arg_max(o_orderpriority, o_orderkey) AS image_text,
         CAST(arg_max(length(o_orderpriority), o_orderkey) AS INTEGER) AS width, CAST(1 AS INTEGER) AS height,
         '{NOW}' AS created_at, CASE WHEN count(*) > 1 THEN '{NOW}' END AS updated_at, count(*) AS times_seen
  FROM orders GROUP BY o_custkey
)"""
LOADED_COLUMNS = "depth, image_text, width, height, created_at, updated_at"

NUMBERED_EVENTS = """numbered AS (
  SELECT (row_number() OVER (ORDER BY event_id) - 1) // 500 AS batch_no, value AS depth, event_type = 'error' AS bad
  FROM events
), batched AS (
  SELECT batch_no, count(*) AS rows, count(*) FILTER (bad) AS failed, min(depth) AS depth_min, max(depth) AS depth_max
  FROM numbered GROUP BY batch_no
)"""

PAGE = """hits AS (
  SELECT o_totalprice AS depth, o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000
  ORDER BY o_totalprice, o_orderkey LIMIT 101 OFFSET 20
), page AS (
  SELECT depth, o_orderkey, row_number() OVER (ORDER BY depth, o_orderkey) AS n, count(*) OVER () > 100 AS has_more
  FROM hits
)"""

# Position-weighted colour sums of the resized lines.
SUMS = f"""{RESIZED}, {PALETTE}, sums AS (
  SELECT depth, CAST(sum((r + 2 * g + 3 * b) * (x + 1)) AS BIGINT) AS colour_sum
  FROM small JOIN palette ON pixel = level GROUP BY depth
)"""
FRAME_SHAPE = "CAST(48 AS INTEGER) AS width, CAST(1 AS INTEGER) AS height"

SPOILED = """SELECT CASE WHEN label = 1 THEN 'bad_depth' WHEN label IN (2, 4, 5) THEN 'bad_pixel' END AS reject, *
  FROM embeddings"""

ORACLE: dict[str, str] = {
    "scan_lines": f"WITH {LINES} SELECT depth, x, v AS value FROM lines",
    "scan_lines_strict": f"""WITH {LINES}
        SELECT depth, x, CAST(least(greatest(trunc(v), 0), 255) AS INTEGER) AS pixel FROM lines""",
    "profile_lines": """
        SELECT count(*) AS num_rows, CAST(65 AS INTEGER) AS num_cols, 'depth_m' AS first_column,
               CAST(64 AS INTEGER) AS num_pixel_columns, 'double' AS depth_type, 'bigint' AS last_pixel_type,
               (SELECT string_agg(vec_id, ' ' ORDER BY vec_id)
                FROM (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 5)) AS sample_depths,
               count(*) * 65 * 8 / 1048576.0::DOUBLE AS memory_estimate_mb, true AS has_size
        FROM embeddings""",
    "check_width": """
        SELECT 'even' AS files, count(*) AS lines, false AS refused FROM embeddings WHERE label <> 3
        UNION ALL SELECT 'mixed', 0, count(*) > 0 FROM embeddings WHERE label = 3""",
    "batch_profile": f"WITH {NUMBERED_EVENTS} SELECT * FROM batched",
    "write_frames": f"WITH {LOADED} SELECT {LOADED_COLUMNS} FROM loaded",
    "export_images": f"""WITH {LINES}, {GRAY}, {PALETTE}
        SELECT depth, x, r, g, b FROM gray JOIN palette ON pixel = level""",
    "page_json": """
        SELECT CAST(o_orderkey AS DOUBLE) AS depth,
               '{"depth":' || CAST(CAST(o_orderkey AS DOUBLE) AS VARCHAR) || ',"width":' || length(o_orderpriority)
               || ',"height":1,"image_png_base64":"' || base64(encode(o_orderpriority)) || '"}' AS frame_json
        FROM orders""",
    "verify_images": f"""
        SELECT CAST(vec_id AS DOUBLE) AS depth, {FRAME_SHAPE},
               vec_id % 7 <> 0 AS has_data, vec_id % 7 <> 0 AS is_png,
               CAST(CASE WHEN vec_id % 7 <> 0 THEN 48 ELSE 0 END AS INTEGER) AS header_width,
               CAST(CASE WHEN vec_id % 7 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS header_height
        FROM embeddings""",
    "clamp_pixels": f"WITH {LINES}, {GRAY} SELECT depth, x, pixel FROM gray",
    "resize_lines": f"WITH {RESIZED} SELECT depth, x, pixel FROM small",
    "resize_lines_filter": f"""
        WITH {LINES}, {GRAY}, {NEAREST},
        {_taps('cubic_taps', 64, 48, 'bicubic')}, {_resized('cubic', 'cubic_taps')},
        {_taps('sinc_taps', 64, 48, 'lanczos')}, {_resized('sinc', 'sinc_taps')}
        SELECT depth, x, near.pixel AS nearest, cubic.pixel AS bicubic, sinc.pixel AS lanczos
        FROM near JOIN cubic USING (depth, x) JOIN sinc USING (depth, x)""",
    "colour_lines": f"""WITH {LINES}, {GRAY}, {PALETTE}
        SELECT depth, x, r, g, b FROM gray JOIN palette ON pixel = level""",
    "process_lines": f"""WITH {RESIZED}, {PALETTE}
        SELECT depth, x, r, g, b FROM small JOIN palette ON pixel = level""",
    "resize_images": f"""
        WITH {LINES}, {GRAY}, {PALETTE}, {_taps('taps', 8, 6)},
        square AS (SELECT depth, CAST(x // 8 AS INTEGER) AS y, x % 8 AS x, pixel FROM gray),
        {_resized('small', 'taps', 'square', 'depth, y')}
        SELECT depth, y, x, r, g, b FROM small JOIN palette ON pixel = level""",
    "depth_range": """
        SELECT o_totalprice AS depth, o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 200000""",
    "depth_lookup": f"WITH {LOADED} SELECT {LOADED_COLUMNS} FROM loaded WHERE depth = 100",
    "depth_page": """
        SELECT o_totalprice AS depth, o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100""",
    "deep_page": """
        SELECT o_totalprice AS depth, o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 12000""",
    "page_has_more": f"WITH {PAGE} SELECT depth, o_orderkey, has_more FROM page WHERE n <= 100",
    "page_metadata": f"""
        WITH {PAGE}
        SELECT count(*) FILTER (n <= 100) AS count, CAST(NULL AS BIGINT) AS total,
               min(depth) FILTER (n <= 100) AS depth_min, max(depth) FILTER (n <= 100) AS depth_max,
               CAST(100 AS INTEGER) AS "limit", CAST(20 AS INTEGER) AS "offset", count(*) > 100 AS has_more
        FROM page""",
    "page_walk": """
        SELECT depth, o_orderkey, row_no, (row_no - 1) // 100 AS page_no FROM (
          SELECT o_totalprice AS depth, o_orderkey,
                 row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_no
          FROM orders)""",
    "frame_metadata": """
        SELECT CAST(o_orderkey AS DOUBLE) AS depth, CAST(length(o_orderpriority) AS INTEGER) AS width,
               CAST(1 AS INTEGER) AS height, CAST(strlen(o_orderpriority) AS INTEGER) AS image_size_bytes,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at,
               CASE WHEN o_orderstatus = 'F'
                 THEN strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:%S') || '.250000' END AS updated_at
        FROM orders""",
    "count_frames": "SELECT count(*) AS frames FROM orders WHERE o_totalprice BETWEEN 150000 AND 300000",
    "depth_extent": "SELECT min(o_totalprice) AS depth_min, max(o_totalprice) AS depth_max FROM orders",
    "table_page": f"""WITH {LOADED}
        SELECT {LOADED_COLUMNS} FROM loaded WHERE depth BETWEEN 10 AND 140 ORDER BY depth LIMIT 30 OFFSET 60""",
    "store_metrics": """
        SELECT count(DISTINCT o_custkey) AS total_frames, CAST(min(o_custkey) AS DOUBLE) AS depth_min,
               CAST(max(o_custkey) AS DOUBLE) AS depth_max
        FROM orders""",
    "last_wins": f"WITH {LOADED} SELECT depth, image_text, width, height, times_seen FROM loaded",
    "upsert_frames": f"""
        SELECT CAST(o_custkey AS DOUBLE) AS depth,
               arg_max(o_orderpriority, (o_orderstatus <> 'F', o_orderkey)) AS image_text,
               CAST(length(arg_max(o_orderpriority, (o_orderstatus <> 'F', o_orderkey))) AS INTEGER) AS width,
               CAST(1 AS INTEGER) AS height,
               CASE WHEN bool_or(o_orderstatus = 'F') THEN '{EARLIER}' ELSE '{NOW}' END AS created_at,
               CASE WHEN bool_or(o_orderstatus <> 'F')
                 AND (bool_or(o_orderstatus = 'F') OR count(*) FILTER (o_orderstatus <> 'F') > 1)
                 THEN '{NOW}' END AS updated_at
        FROM orders GROUP BY o_custkey""",
    "upsert_table": f"""
        SELECT CAST(o_custkey AS DOUBLE) AS depth,
               arg_max(o_orderpriority, (o_orderstatus <> 'F', o_orderkey)) AS image_text,
               CAST(length(arg_max(o_orderpriority, (o_orderstatus <> 'F', o_orderkey))) AS INTEGER) AS width,
               CAST(1 AS INTEGER) AS height,
               CASE WHEN bool_or(o_orderstatus = 'F') THEN '{EARLIER}' ELSE '{NOW}' END AS created_at,
               CASE WHEN bool_or(o_orderstatus <> 'F')
                 AND (bool_or(o_orderstatus = 'F') OR count(*) FILTER (o_orderstatus <> 'F') > 1) THEN '{NOW}'
                 WHEN bool_and(o_orderstatus = 'F') AND count(*) > 1 THEN '{EARLIER}' END AS updated_at
        FROM orders GROUP BY o_custkey""",
    "delete_frame": """
        WITH held AS (SELECT DISTINCT o_custkey AS key FROM orders),
        debtors AS (SELECT c_custkey AS key FROM customer WHERE c_acctbal < 0)
        SELECT CAST(key AS DOUBLE) AS depth, 'kept' AS outcome FROM held WHERE key NOT IN (SELECT key FROM debtors)
        UNION ALL
        SELECT CAST(key AS DOUBLE), CASE WHEN key IN (SELECT key FROM held) THEN 'deleted' ELSE 'absent' END
        FROM debtors""",
    "reload_frames": f"""
        WITH {SUMS}, marked AS (
          SELECT CAST(vec_id AS DOUBLE) AS depth, label, colour_sum
          FROM embeddings JOIN sums ON sums.depth = vec_id
        )
        SELECT depth, {FRAME_SHAPE},
               CASE WHEN label IN (2, 3, 4) THEN '{EARLIER}' ELSE '{NOW}' END AS created_at,
               CASE WHEN label IN (2, 3, 4) THEN '{NOW}' END AS updated_at, colour_sum
        FROM marked
        UNION ALL
        SELECT depth + 0.5, width, height, '{EARLIER}', NULL, colour_sum
        FROM (SELECT *, {FRAME_SHAPE} FROM marked) WHERE label < 2""",
    "reload_frames_clear": f"""
        WITH {SUMS}
        SELECT depth, {FRAME_SHAPE}, '{NOW}' AS created_at, CAST(NULL AS VARCHAR) AS updated_at, colour_sum
        FROM sums""",
    "load_summary": """
        SELECT count(*) AS rows_read, count(*) FILTER (event_type <> 'error') AS rows_stored,
               count(*) FILTER (event_type = 'error') AS rows_failed,
               CAST(ceil(count(*) / 500) AS BIGINT) AS batches, CAST(500 AS INTEGER) AS batch_size,
               CAST(200 AS INTEGER) AS source_width, CAST(150 AS INTEGER) AS target_width
        FROM events""",
    "load_status": """
        SELECT CASE WHEN n = s THEN 'success' ELSE 'partial' END AS status,
               CASE WHEN n = s THEN format('Successfully ingested {} frames', s)
                    ELSE format('Processed {} rows but only stored {} frames (some rows failed)', n, s) END AS message,
               n AS rows_processed, s AS frames_stored
        FROM (SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS s FROM events)""",
    "quarantine_rows": f"""
        SELECT row_no, CASE WHEN label = 1 THEN 'deep' ELSE CAST(CAST(vec_id AS DOUBLE) AS VARCHAR) END AS depth_text,
               reject AS reason
        FROM (SELECT *, row_number() OVER (ORDER BY vec_id) AS row_no FROM ({SPOILED})) WHERE reject IS NOT NULL""",
    "running_totals": f"""
        WITH {NUMBERED_EVENTS}, totals AS (
          SELECT batch_no, CAST(sum(rows) OVER w AS BIGINT) AS total_rows,
                 CAST(sum(failed) OVER w AS BIGINT) AS total_failed, (SELECT count(*) FROM events) AS n
          FROM batched WINDOW w AS (ORDER BY batch_no ROWS UNBOUNDED PRECEDING)
        )
        SELECT batch_no, total_rows, total_rows - total_failed AS total_stored, total_failed,
               round(CAST(total_rows * 100 AS DOUBLE) / n, 1) AS percent_done
        FROM totals""",
    "validate_load": """
        SELECT n AS rows_read, n AS rows_stored, held AS table_count, depth_min, depth_max,
               held = n AS validation_passed, false AS rows_skipped
        FROM (SELECT count(*) AS n, count(DISTINCT o_custkey) AS held, CAST(min(o_custkey) AS DOUBLE) AS depth_min,
                     CAST(max(o_custkey) AS DOUBLE) AS depth_max FROM orders)
        UNION ALL
        SELECT held + bad, held, held, depth_min, depth_max, true, bad > 0
        FROM (SELECT count(DISTINCT o_custkey) AS held, count(*) FILTER (o_orderstatus = 'P') AS bad,
                     CAST(min(o_custkey) AS DOUBLE) AS depth_min, CAST(max(o_custkey) AS DOUBLE) AS depth_max
              FROM orders)""",
    "size_estimate": f"""
        WITH {LOADED}
        SELECT count(*) AS frames, count(*) * CAST(10240 AS DOUBLE) / 1048576 AS estimated_mb,
               CAST(sum(strlen(image_text)) AS BIGINT) AS image_bytes,
               CAST(100 AS DOUBLE) * (CAST(10240 AS DOUBLE) / 1048576) / 2 AS mb_per_second
        FROM loaded""",
    "line_gradients": f"""
        WITH {RESIZED}, steps AS (
          SELECT depth, pixel - lag(pixel) OVER (PARTITION BY depth ORDER BY x) AS step FROM small
        )
        SELECT depth, CAST(min(step) AS INTEGER) AS min_step, CAST(max(step) AS INTEGER) AS max_step,
               min(step) >= -1 AS rising
        FROM steps GROUP BY depth""",
    "uniform_lines": f"""
        WITH {LINES}, flat AS (
          SELECT depth, label, x,
                 CASE WHEN label = 0 THEN first_value(v) OVER (PARTITION BY depth ORDER BY x) ELSE v END AS v
          FROM lines
        ), {GRAY.replace('FROM lines', 'FROM flat')}, {_taps('taps', 64, 48)}, {_resized('small', 'taps')},
        before AS (SELECT depth, min(pixel) AS lo, max(pixel) AS hi FROM gray GROUP BY depth),
        after AS (SELECT depth, min(pixel) AS lo, max(pixel) AS hi FROM small GROUP BY depth)
        SELECT depth, before.lo = before.hi AS uniform_before, after.lo = after.hi AS uniform_after,
               before.lo <> before.hi OR (after.lo = after.hi AND before.lo = after.lo) AS kept
        FROM before JOIN after USING (depth)""",
    "stream_ingest": f"""
        WITH {LINES.replace('lines AS', 'whole AS')}, lines AS (
          SELECT depth, label, x, CASE WHEN label = 3 AND x = 6 THEN 0 ELSE v END AS v
          FROM whole WHERE label NOT IN (1, 2, 4, 5)
        ), {SUMS.replace(LINES + ', ', '')}
        SELECT depth, {FRAME_SHAPE}, '{NOW}' AS created_at, colour_sum FROM sums""",
    "stream_two_folders": f"WITH {SUMS} SELECT depth, {FRAME_SHAPE}, colour_sum FROM sums",
    "stream_batch_metrics": """
        SELECT count(*) AS rows, count(*) FILTER (label IN (1, 2, 4, 5)) AS failed,
               min(CASE WHEN label <> 1 THEN CAST(vec_id AS DOUBLE) END) AS depth_min,
               max(CASE WHEN label <> 1 THEN CAST(vec_id AS DOUBLE) END) AS depth_max
        FROM embeddings GROUP BY label""",
}
