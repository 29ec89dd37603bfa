"""Quality rules: divergence of a text from its language, with DataFrame functions only.

One pass over the texts gives each row its counts and two histograms: characters by class, and words by common word
(the listed ones, and all others as one). The histograms of a language's texts of at least ``LEAST_WORDS`` words,
summed over all rows, are its references. A text is compared with its own language's references by the Jensen-Shannon
distance (base 2, so between 0 and 1). Shorter texts, whose histograms say little, are not judged (the guard); for the
others the two distances together may reach ``LIMIT + SLACK / sqrt(words)``, as chance alone sets histograms of few
words apart. ``kept`` needs the base rule and this one to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.store import stored

# Frequent words of the languages known best; others are judged by how often these occur in them.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "as", "with", "on", "are", "by", "this", "be",
    "der", "die", "und", "das", "von", "den", "mit", "auf", "ist", "nicht", "ein", "zu", "im", "des",
    "le", "la", "les", "des", "et", "en", "un", "une", "du", "que", "pour", "dans", "par", "sur",
    "el", "los", "las", "y", "de", "se", "del", "al", "con", "su", "para", "lo",
)
WORDS = tuple(dict.fromkeys(COMMON_WORDS))
LEAST_WORDS = 30
LIMIT, SLACK = 0.30, 1.4
#: Windows of so many words are looked at for repetition.
WINDOW = 5


def _count(pattern: str) -> Column:
    """Characters of the text that match a class."""
    return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))


def _counted(docs: DataFrame) -> DataFrame:
    """Words, base counts and histograms per row. Columns used twice are made in a step of their own, so once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "*", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"), lines.alias("lines")
    )
    window = ", ".join(f"get(words, i + {k})" for k in range(WINDOW))
    hashes = F.expr(
        f"CASE WHEN size(words) >= {WINDOW} THEN transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64({window}))"
        " ELSE CAST(array() AS array<bigint>) END"
    )
    rows = rows.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length("text").alias("characters"), F.octet_length("text").alias("octets"),
        _count("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        _count("[0-9]+").alias("digits"), _count("[A-Z]+").alias("capitals"), _count("[.,;:!?'\"()-]+").alias("marks"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("hashes"),
        F.filter(F.transform("words", F.lower), lambda w: w.isin(*WORDS)).alias("common"),
    )
    # Where windows repeat: their places in order of hash, then the places that share a hash, in text order.
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = rows.withColumn(
        "placed", F.when(repeated, F.sort_array(F.expr("transform(hashes, (h, i) -> struct(h AS h, i AS i))")))
    ).drop("hashes")
    alike = "filter(placed, (p, k) -> p.h <=> get(placed, k - 1).h OR p.h <=> get(placed, k + 1).h)"
    rows = rows.withColumn("places", F.expr(f"sort_array(transform({alike}, p -> p.i))")).drop("placed")
    covered = (
        f"aggregate(places, struct(-{WINDOW} AS last, 0L AS n),"
        f" (a, p) -> struct(p AS last, a.n + least({WINDOW}, p - a.last) AS n), a -> a.n)"
    )
    total = F.size("common")
    by_word = [(total - F.size(F.array_remove("common", word))).cast("long") for word in WORDS]
    spaces = F.col("characters") - F.col("word_chars")
    foreign = F.col("octets") - F.col("characters")  # bytes beyond one a character
    kinds = [spaces, F.col("digits"), F.col("capitals"), F.col("marks"), F.col("n_symbols"), foreign]
    others = F.greatest(F.lit(0), F.col("characters") - sum(kinds[1:], start=kinds[0]))
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*[k.cast("long") for k in [*kinds, others]]).alias("by_class"),
        F.array(*by_word, F.col("n_words") - total).alias("by_word"),
    )


def _total(name: str) -> Column:
    return F.aggregate(name, F.lit(0.0), lambda a, v: a + v)


def _distance(one: str, other: str) -> Column:
    """Jensen-Shannon distance of two count arrays, each divided by its sum; null if either is empty.

    The sums are columns ``<name>_sum``: inside the lambda they would be added up anew for every element.
    """

    def part(p: Column, q: Column) -> Column:
        middle = (p + q) / 2
        own = F.when(p > 0, p * F.log2(p / middle)).otherwise(0.0)
        return own + F.when(q > 0, q * F.log2(q / middle)).otherwise(0.0)

    sums = [F.nullif(F.col(f"{name}_sum"), F.lit(0.0)) for name in (one, other)]
    shares = F.zip_with(one, other, lambda a, b: part(a / sums[0], b / sums[1]))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(shares, F.lit(0.0), lambda a, v: a + v) / 2))


def quality_rules(docs: DataFrame, least_words: int = LEAST_WORDS, limit: float = LIMIT, slack: float = SLACK) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, kept and both distances.

    Null texts are empty; rows without ``lang`` form a language of their own. Without a reference, or below the guard,
    a distance judges nothing.
    """
    counted = stored(_counted(docs), "counts")
    sums = [F.sum(F.col("by_class")[i]).cast("double").alias(f"c{i}") for i in range(7)]
    sums += [F.sum(F.col("by_word")[i]).cast("double").alias(f"w{i}") for i in range(len(WORDS) + 1)]
    references = counted.where(F.col("n_words") >= least_words).groupBy("lang").agg(*sums)
    references = references.select(
        F.col("lang").alias("of"),
        F.array(*[f"c{i}" for i in range(7)]).alias("class_reference"),
        F.array(*[f"w{i}" for i in range(len(WORDS) + 1)]).alias("word_reference"),
    )
    totals = {f"{name}_sum": _total(name) for name in ("class_reference", "word_reference")}
    references = stored(references.withColumns(totals), "references")
    rows = counted.join(references, F.col("lang").eqNullSafe(F.col("of")), "left").withColumns(
        {"by_class": F.col("by_class").cast("array<double>"), "by_word": F.col("by_word").cast("array<double>")}
    )
    rows = rows.withColumns({f"{name}_sum": _total(name) for name in ("by_class", "by_word")})
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        _distance("by_class", "class_reference").alias("class_distance"),
        _distance("by_word", "word_reference").alias("word_distance"),
    )
    short = F.col("n_words") < least_words
    allowed = F.lit(limit) + F.lit(slack) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    fits = short | F.coalesce(F.col("class_distance") + F.col("word_distance") <= allowed, F.lit(True))
    kept = ~F.col("base_failed") & fits
    return rows.select(*rows.columns[:7], kept.alias("kept"), "class_distance", "word_distance")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
