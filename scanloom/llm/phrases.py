"""Phrase collocation mining with stripes.

Method: the stripes pattern. Every prefix of one or two words keys a stripe, an associative counter of the words that
follow it inside a piece; the end of a piece is a null word. The stripes nest: the cell ``w1 -> w2`` of a one-word
stripe is the total of the two-word stripe ``w1 w2``, so a row ``(w1, w2, w3)`` per word position is a cell of both.
Every task adds up the stripes of its own texts, and the shuffle deals them out by their words, so that they are merged
elementwise (cells of equal words are added) and a hot prefix, whose stripe may be as long as the vocabulary, is spread
over all tasks.

Most cells occur once and never matter. Before stripes are made, one pass counts the pairs of neighbours by their 64-bit
hashes; a pair whose hash occurs fewer than 10 times does so itself and is neither a candidate nor a part of one. The
others' hashes mark a bitmap (see ``marks.py``) that every task is given: a position whose pair has no mark is left
out, and a next word whose pair has none counts as the end of the piece. Equal hashes and common bits let more pairs
through, never fewer, and everything below tests the counts themselves, so the result does not depend on either.

* extensions: a cell holds f(prefix + next), so cells of 10 or more are the candidates;
* prefix totals: the sum of a marked pair's stripe is f(pair), with all of its positions, the counts of the cuts; single
  words are counted over all positions, and their sum is n; as no part of a candidate is rarer than the candidate, only
  prefixes of 10 or more are looked up;
* subsumption maxima: the largest cell of a two-word stripe is the most frequent candidate that extends the prefix to
  the right; the largest three-word cell ending in a pair, the one that extends it to the left.

A candidate's score is ``floor(10^6 a^2 / (l r))`` at its lowest cut, in exact decimal arithmetic. The ranking keeps
the first ``MOST`` per language in two steps, by shards of phrases and then per language, so no task sees more than
shards times ``MOST`` rows of a language.

Edge cases: null text is empty and null lang is ``und``; only A-Z are lower-cased; pieces without words add nothing;
repeated rows count as often as they occur, and doc_id is never read, so null or repeated ids change nothing; extra
columns are dropped at once; long texts are read whole. A language without candidates has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.marks import marked, marks_of
from scanloom.llm.store import stored

# Fixed values of the contract.
PIECE_BREAKS = r"[.,;:!?\x0A-\x0D]"
WORD_BREAKS = r"[\x20\x09]+"
LEAST = 10
MOST = 2000
SCALE = 1_000_000
#: A shorter candidate goes when a longer one that holds it occurs at least this share of its count, in percent.
SUBSUMED_PERCENT = 50
#: Shards per language for the first ranking step.
SHARDS = 64
#: Stands between the pieces in a list of words; no word is one, as pieces are cut there.
CUT = "."

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tokens(docs: DataFrame) -> DataFrame:
    """lang and the words of each text, A-Z lower-cased, with ``CUT`` wherever a piece ends."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Only A-Z are lower-cased: for a text of ASCII alone that is what lower() does, and much faster than translate().
    text = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    cut = F.regexp_replace(text, PIECE_BREAKS, f" {CUT} ")
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.array_remove(F.split(cut, WORD_BREAKS), "").alias("ws"),
    )


def _positions(docs: DataFrame) -> DataFrame:
    """``lang, w1, w2, w3`` per word: it and the next two of its piece, null beyond the end."""
    shifted = [F.slice("ws", k, F.size("ws")) for k in (2, 3)]
    rows = _tokens(docs).select("lang", F.inline(F.arrays_zip("ws", *shifted))).toDF("lang", "w1", "w2", "w3")
    second = F.nullif("w2", F.lit(CUT))
    return rows.where(F.col("w1") != CUT).select(
        "lang", "w1", second.alias("w2"), F.when(second.isNotNull(), F.nullif("w3", F.lit(CUT))).alias("w3")
    )


def likely_pairs(docs: DataFrame) -> DataFrame:
    """Marks of all pairs of neighbours that may occur ``LEAST`` times."""
    pairs = _positions(docs).where(F.col("w2").isNotNull()).select(F.xxhash64("lang", "w1", "w2").alias("pair"))
    return marks_of(pairs.groupBy("pair").count().where(F.col("count") >= LEAST).select("pair"))


def stripe_cells(docs: DataFrame, likely: DataFrame | None = None) -> DataFrame:
    """Merged stripes: ``lang, w1, w2, w3, c``.

    The stripe of ``w1`` counts each next word ``w2``, and the stripe of ``w1 w2`` each next word ``w3``; a null
    ``w2`` or ``w3`` is the end of a piece. Nested like this, one row per word position holds both cells, and a
    stripe's total is the sum of its cells. With marks of ``likely`` pairs only their stripes are made, and a next word
    ``w3`` that makes no likely pair with ``w2`` counts as the end of the piece.
    """
    positions = _positions(docs)
    if likely is not None:
        first = marked(positions.where(F.col("w2").isNotNull()), likely, "first", "lang", "w1", "w2").where("first")
        both = marked(first, likely, "second", "lang", "w2", "w3")
        positions = both.select("lang", "w1", "w2", F.when(F.col("second"), F.col("w3")).alias("w3"))
    return positions.groupBy("lang", "w1", "w2", "w3").agg(F.count(F.lit(1)).alias("c"))


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = "DECIMAL(38,0)"
    return F.call_function("div", a.cast(wide) * a.cast(wide) * F.lit(SCALE).cast(wide), left.cast(wide) * right.cast(wide)).cast("long")


def _lowest_cut(*cuts: tuple[Column, Column]) -> list[Column]:
    """``l, r, score`` of the cut with the lowest score, the first of equal ones."""
    scored = [F.struct(_score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")) for k, (left, right) in enumerate(cuts)]
    best = F.least(*scored) if len(scored) > 1 else scored[0]
    return [best["l"].alias("l"), best["r"].alias("r"), best["score"].alias("score")]


def collocations(docs: DataFrame) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the contract; see the module's docstring."""
    stripes = stored(stripe_cells(docs, stored(likely_pairs(docs), "phrases-marks")), "phrases-stripes")
    singles = stored(
        _tokens(docs).select("lang", F.explode("ws").alias("w1")).where(F.col("w1") != CUT)
        .groupBy("lang", "w1").agg(F.count(F.lit(1)).alias("f")),
        "phrases-words",
    )
    pairs = stripes.groupBy("lang", "w1", "w2").agg(
        F.sum("c").alias("f"), F.max(F.when(F.col("w3").isNotNull(), F.col("c"))).alias("right_max")
    )  # the stripe totals of two-word prefixes, and their largest cells
    three_words = stripes.where(F.col("w3").isNotNull() & (F.col("c") >= LEAST))
    n = singles.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = singles.where(F.col("f") >= LEAST)  # every part of a candidate is at least as frequent as it
    one = lambda w, f: frequent.select("lang", F.col("w1").alias(w), F.col("f").alias(f))
    two = lambda u, v, f: pairs.where(F.col("f") >= LEAST).select("lang", F.col("w1").alias(u), F.col("w2").alias(v), F.col("f").alias(f))
    left_max = (
        three_words
        .groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("c").alias("left_max"))
    )
    doubles = (
        pairs.where(F.col("f") >= LEAST).join(left_max, ["lang", "w1", "w2"], "left")
        .where(~(F.coalesce(F.greatest("right_max", "left_max"), F.lit(0)) >= LEAST)
               | (100 * F.greatest("right_max", "left_max") < SUBSUMED_PERCENT * F.col("f")))
        .select("lang", "w1", "w2", F.col("f").alias("a"))
        .join(one("w1", "f1"), ["lang", "w1"]).join(one("w2", "f2"), ["lang", "w2"])
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", *_lowest_cut((F.col("f1"), F.col("f2"))))
    )
    triples = (
        three_words
        .select("lang", "w1", "w2", "w3", F.col("c").alias("a"))
        .join(one("w1", "f1"), ["lang", "w1"]).join(one("w3", "f3"), ["lang", "w3"])
        .join(two("w1", "w2", "f12"), ["lang", "w1", "w2"]).join(two("w2", "w3", "f23"), ["lang", "w2", "w3"])
        .select(
            "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
            *_lowest_cut((F.col("f1"), F.col("f23")), (F.col("f12"), F.col("f3"))),
        )
    )
    kept = doubles.unionByName(triples)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    shard = F.pmod(F.xxhash64("phrase"), F.lit(SHARDS))
    first = kept.withColumn("at", F.row_number().over(Window.partitionBy("lang", shard).orderBy(*order))).where(F.col("at") <= MOST)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= MOST)
    return ranked.join(n, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n").cast("long").alias("n"), "score"
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents, by language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
pos AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (
  SELECT lang, 1 AS k, ws[i] AS phrase, ws[i] AS w1, NULL AS w2, NULL AS w3 FROM pos
  UNION ALL
  SELECT lang, 2, ws[i] || ' ' || ws[i + 1], ws[i], ws[i + 1], NULL FROM pos WHERE i + 1 <= len(ws)
  UNION ALL
  SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2], ws[i], ws[i + 1], ws[i + 2] FROM pos WHERE i + 2 <= len(ws)
), f AS (
  SELECT lang, k, phrase, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3, count(*) AS f
  FROM g GROUP BY lang, k, phrase
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k >= 2 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.k AS size, c.f AS a, 1 AS cut, l.f AS l, r.f AS r
  FROM cand c JOIN f l ON l.lang = c.lang AND l.phrase = c.w1
  JOIN f r ON r.lang = c.lang AND r.phrase = CASE WHEN c.k = 2 THEN c.w2 ELSE c.w2 || ' ' || c.w3 END
  UNION ALL
  SELECT c.lang, c.phrase, c.k, c.f, 2, l.f, r.f
  FROM cand c JOIN f l ON l.lang = c.lang AND l.phrase = c.w1 || ' ' || c.w2
  JOIN f r ON r.lang = c.lang AND r.phrase = c.w3 WHERE c.k = 3
), scored AS (
  SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM scored) WHERE o = 1
), kept AS (
  SELECT b.* FROM best b JOIN cand c ON c.lang = b.lang AND c.phrase = b.phrase
  WHERE c.k = 3 OR NOT EXISTS (
    SELECT 1 FROM cand t WHERE t.lang = c.lang AND t.k = 3 AND 100 * t.f >= 50 * c.f
      AND ((t.w1 = c.w1 AND t.w2 = c.w2) OR (t.w2 = c.w1 AND t.w3 = c.w2))
  )
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, n.n AS n, score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
