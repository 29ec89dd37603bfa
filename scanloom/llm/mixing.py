"""Mixing sources to target weights by capped water-filling.

Every source has a weight; together the sources take as many words as there are. A source gives at most ``epochs``
times its own words: sources above that are clamped there and what they cannot give is shared among the rest by weight,
again and again until none is above. A source's target then is so many whole repetitions of all its documents plus a
part of one more. For that part its documents are put into a seeded order and taken until the target is reached; the
document at the cut gives just the words still wanting (documents with equal place share them). So every source meets
its target up to rounding, and reruns agree.

Only ``(source, size, place)`` is shuffled. The order is never made as a whole: words are summed per slice of places,
and only the slice with the cut is looked into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.store import stored

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 17
#: Hex digits of a place that name its slice.
SLICE_DIGITS = 3
_WHOLE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_place(seed: int = SEED) -> Column:
    """A document's place in the seeded order, from its id alone."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def sizes_of(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), seeded_place(seed).alias("place")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, weight, target)``; one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")  # over sources, not documents
    at = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), at + 1)
    sources = totals.withColumn("weight", weight.cast(_WHOLE)).withColumn("cap", (F.col("source_size") * epochs).cast(_WHOLE))
    sources = stored(sources.withColumn("clamped", F.lit(False)), "sources")
    while True:
        free = ~F.col("clamped")
        sums = sources.agg(
            F.sum("source_size").cast(_WHOLE).alias("all"),
            F.sum(F.when(F.col("clamped"), F.col("cap"))).cast(_WHOLE).alias("given"),
            F.sum(F.when(free, F.col("weight"))).cast(_WHOLE).alias("free"),
        ).first()
        rest, share = int((sums["all"] or 0) - (sums["given"] or 0)), int(sums["free"] or 0)
        wants = (F.col("weight") * F.lit(rest).cast(_WHOLE)).cast(_WHOLE)
        over = free & (wants > (F.col("cap") * F.lit(share).cast(_WHOLE)).cast(_WHOLE))
        if sources.where(over).isEmpty():
            break
        sources = stored(sources.withColumn("clamped", F.col("clamped") | over), "sources")
    target = F.when(F.col("clamped") | F.lit(share == 0), F.col("cap").cast("double"))
    target = target.otherwise(wants.cast("double") / F.lit(float(share or 1)))
    return sources.select("source", "source_size", F.col("weight").cast("int"), target.alias("target"))


def source_cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with ``whole`` repetitions, and the ``cut``: documents placed before it are taken once more in full,
    those at it share ``cut_words`` of their ``cut_size`` words."""
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", share)
    targets = targets.withColumn("part", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
    targets = stored(targets.withColumn("part", F.greatest(F.col("part"), F.lit(0).cast("long"))), "targets")
    key = F.col("source").eqNullSafe(F.col("of"))
    named = F.col("source").alias("of")
    slices = sizes.groupBy("source", F.substring("place", 1, SLICE_DIGITS).alias("slice")).agg(F.sum("size").alias("words"))
    per_source = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("words").over(per_source), F.lit(0)))
    reached = targets.select(named, "part").where("part > 0")
    here = slices.join(reached, key).where("before < part AND before + words >= part")
    here = stored(here.select("of", F.col("slice").alias("at"), "before", "part"), "slices")
    inside = sizes.join(here, key & (F.substring("place", 1, SLICE_DIGITS) == F.col("at")))
    places = inside.groupBy("of", "place", "before", "part").agg(F.sum("size").alias("cut_size"))
    up_to = Window.partitionBy("of").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("before", F.col("before") + F.coalesce(F.sum("cut_size").over(up_to), F.lit(0)))
    cut = places.where("before < part AND before + cut_size >= part").select(
        "of", F.col("place").alias("cut"), "cut_size", (F.col("part") - F.col("before")).alias("cut_words")
    )
    return stored(targets.join(cut, key, "left").drop("of", "part"), "cuts")


def taken_words() -> Column:
    """Words taken of a row that carries ``size``, ``place`` and its source's cut."""
    at_cut = F.expr("size * cut_words div cut_size")
    more = F.when(F.col("place") < F.col("cut"), F.col("size")).when(F.col("place") == F.col("cut"), at_cut).otherwise(0)
    return (F.col("size") * F.col("whole") + F.coalesce(more, F.lit(0))).cast("long")


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    return rows.join(cuts.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken.

    Null texts and texts without words have size 0 and give nothing; documents without source form a source of their
    own, the last. Repeated rows count each time. Sources without words have the target 0.
    """
    sizes = stored(sizes_of(docs, seed), "sizes")
    cuts = source_cuts(sizes, source_targets(sizes, weights, epochs))
    return _with_cuts(sizes, cuts).select("doc_id", "size", "source_size", "target", taken_words().alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, with the same columns.

    A document at a source's cut gives its last repetition's first words only.
    """
    sizes = stored(sizes_of(docs, seed), "sizes")
    cuts = source_cuts(sizes, source_targets(sizes, weights, epochs))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("source").cast("string"),
        F.col("text").cast("string"), word_count(F.col("text")).alias("size"), seeded_place(seed).alias("place"),
    )
    rows = _with_cuts(rows, cuts).withColumn("_taken", taken_words()).where("_taken > 0")
    whole, more = F.expr("_taken div size"), F.col("_taken") % F.col("size")
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    cut_text = F.when(more > 0, F.array_join(F.slice(words, F.lit(1), F.greatest(more, F.lit(1)).cast("int")), " "))
    texts = F.array_repeat(F.col("text"), whole.cast("int"))
    texts = F.when(more > 0, F.concat(texts, F.array(cut_text))).otherwise(texts)
    rows = rows.select("_row", F.explode(texts).alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text")}
    return rows.select(
        *[
            (new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"_row.`{c}`")).alias(c)
            for c in docs.columns
        ]
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


OP6_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17') AS place,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS source_size, 3 * CAST(sum(size) AS HUGEINT) AS cap,
         CAST(CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
              WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS HUGEINT) AS weight
  FROM sizes GROUP BY source
), filled AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM sources WINDOW before AS (ORDER BY cap / weight, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest, free FROM filled WHERE weight * rest <= cap * free ORDER BY cap / weight, encode(source) LIMIT 1
), targets AS (
  SELECT s.source, CAST(s.source_size AS BIGINT) AS source_size,
         CASE WHEN l.free IS NULL OR s.weight * l.rest > s.cap * l.free THEN CAST(s.cap AS DOUBLE)
              ELSE CAST(s.weight * l.rest AS DOUBLE) / CAST(l.free AS DOUBLE) END AS target
  FROM sources s LEFT JOIN level l ON true
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), places AS (
  SELECT source, place, sum(size) AS here,
         coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY place
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes GROUP BY source, place
)
SELECT s.doc_id, s.size, p.source_size, p.target,
       CAST(s.size * p.whole + CASE WHEN h.here = 0 THEN 0 ELSE
            (s.size * greatest(0, least(h.here, CAST(floor(p.target) AS BIGINT) - p.whole * p.source_size - h.before))) // h.here
            END AS BIGINT) AS taken
FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
JOIN places h ON s.source IS NOT DISTINCT FROM h.source AND s.place = h.place
"""
