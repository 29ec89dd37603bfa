"""scanloom: depth-keyed scan lines on Spark.

Wide CSV lines come in, are clamped, resized, coloured and packed as images by
Spark jobs, and are kept in a keyed Parquet table that answers range, page and
count queries.
"""
