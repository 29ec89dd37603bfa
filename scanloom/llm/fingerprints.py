"""Document fingerprints by a threshold-scaled sketch, with DataFrame functions only.

Method: a text's shingles are its five-word windows (words ``[^\\x20\\x09-\\x0D]+``; a text of fewer words is one
shingle of all of them, a text without words has none). A shingle's 64-bit hash is kept when it lies below a fixed
fraction of the hash space, ``1 / 2^SHIFT``; the fingerprint is the set of kept hashes, ascending, as 16 hex digits each
and comma-joined. Since the same hashes are kept for every text, fingerprints can be merged (the fingerprint of a union
is the union of the fingerprints) and compared across texts of any length: the share of kept hashes that two texts
have in common estimates their resemblance (Jaccard), and the share of one text's kept hashes found in the other's,
how much of it the other contains. A text whose shingles all lie above the threshold keeps its smallest hash alone, so
that only texts without words have empty fingerprints; two such fingerprints are alike (1) when equal, else not (0).

The edited text replaces a text's last ``floor(n_chars / 4)`` code points by the first as many of the next text in
``doc_id`` order (ties by the text's xxhash64, then by text; null ids last; after the last comes the first). The order
is found without one task holding all rows: texts are dealt out in ranges of (doc_id, hash), each range is ordered in
its own task, and the last row of each range takes the first row of the next range that holds rows.

Edge cases: a null text is ''; a null doc_id sorts last; repeated rows are fingerprinted each, the one before the other
in the order; an empty table gives no rows; extra columns are dropped; very long texts are read whole. Equal texts
have equal fingerprints and likeness 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


SPACES = r"[\x20\x09-\x0D]+"
SHINGLE = 5
#: A hash is kept when its highest SHIFT bits are 0: one in 2^SHIFT of a text's shingles.
SHIFT = 3
EDITED_SHARE = 4
#: Bytes of input per range of the order, at least.
RANGE_BYTES = 64 << 20


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with column ``name``: the kept hashes of column ``text``, ascending (an array of longs)."""
    words, hashes = f"{name}_words", f"{name}_hashes"
    window = ", ".join(f"{words}[i + {k}]" for k in range(SHINGLE))
    below = f"shiftrightunsigned(h, {64 - SHIFT}) = 0"
    return (
        df.withColumn(words, F.array_remove(F.split(text, SPACES), ""))
        .withColumn(hashes, F.expr(
            f"CASE WHEN size({words}) = 0 THEN CAST(array() AS array<bigint>)"
            f" WHEN size({words}) < {SHINGLE} THEN array(xxhash64(array_join({words}, ' ')))"
            f" ELSE transform(sequence(0, size({words}) - {SHINGLE}), i -> xxhash64({window})) END"
        ))
        .withColumn(name, F.expr(
            f"CASE WHEN exists({hashes}, h -> {below}) THEN array_sort(array_distinct(filter({hashes}, h -> {below})))"
            f" WHEN size({hashes}) = 0 THEN {hashes} ELSE array(array_min({hashes})) END"
        ))
        .drop(words, hashes)
    )


def _below(sketch_: Column) -> Column:
    return F.filter(sketch_, lambda h: F.shiftrightunsigned(h, 64 - SHIFT) == 0)


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two texts from their sketches, 0 to 1."""
    a_kept, b_kept = _below(a), _below(b)
    union = F.size(F.array_union(a_kept, b_kept))
    return F.when(union == 0, F.when(a == b, 1.0).otherwise(0.0)).otherwise(
        F.size(F.array_intersect(a_kept, b_kept)) / union
    )


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles found in the second, 0 to 1 (1 if the first has none kept)."""
    a_kept = _below(a)
    return F.when(F.size(a_kept) == 0, F.when(a == b, 1.0).otherwise(0.0)).otherwise(
        F.size(F.array_intersect(a_kept, _below(b))) / F.size(a_kept)
    )


def as_text(sketch_: Column) -> Column:
    return F.array_join(F.transform(sketch_, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def _ranges(df: DataFrame) -> int:
    """How many ranges: the session's shuffle partitions, more when the input's estimated size calls for it (a size
    Spark cannot estimate counts as none)."""
    estimated = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if estimated >= 1 << 62 else max(least, min(-(-estimated // RANGE_BYTES), (1 << 31) - 1))


def _with_next(rows: DataFrame) -> DataFrame:
    """Each row with ``next_text``, the text of the row after it, in ranges of rows ordered apart."""
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("text")]
    # Ranges by (doc_id, hash of the text): the sample that places them holds two numbers a row, never texts. Their
    # number is fixed, so adaptive execution leaves them as they are, and every use numbers them alike.
    ranged = rows.repartitionByRange(_ranges(rows), order[0], order[1]).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy(*order)
    ordered = ranged.select("*", F.lead("text").over(within).alias("next_text"))
    # The first row of each range, by a minimum that each task takes of its own rows before anything is dealt out.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "text")).alias("first")
    firsts = ranged.groupBy("part").agg(first)
    ranges = Window.orderBy("part")  # one row per range: one task is enough
    following = firsts.select(
        "part",
        F.coalesce(F.lead("first").over(ranges), F.first("first").over(ranges.rowsBetween(Window.unboundedPreceding, 0))).alias("following"),
    )
    return ordered.join(following, "part", "left").select(
        *[c for c in rows.columns if c != "h"],
        F.coalesce("next_text", "following.text").alias("next_text"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` and containments."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Sketches are made after the rows are ordered, of each text and of the next: the shuffles carry texts alone.
    paired = _with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")))
    paired = with_sketch(with_sketch(paired, "text", "sketch"), "next_text", "next_sketch")
    n = F.char_length("text")
    cut = F.floor(n / EDITED_SHARE).cast("int")
    edited = F.concat(F.substring("text", 1, n - cut), F.substring("next_text", 1, cut))
    out = with_sketch(
        paired.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited")),
        "edited", "edited_sketch",
    )
    return out.select(
        "doc_id", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("contained_next"),
    )


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
