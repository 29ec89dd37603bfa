"""Source divergence audit: how far each source's term frequencies lie from the other sources' and from its language's.

Method: single-pass in-memory indexing. Every task turns its texts into postings and adds them up in memory, keyed by
(lang, source, term); when the memory of the task fills, Spark's aggregation spills the block as a run sorted by key
and merges its runs again at the end, and the shuffle deals the merged blocks out by a hash of the key, so each hash
shard merges all runs of its keys into one frequency. These are the two aggregations below, one for occurrences and
one for documents per term; neither keeps a whole group anywhere, so a hot source, language or term costs as much as
its distinct keys.

Frequencies become smoothed parts per billion, ``p = 1 + floor(10^9 * (count + 2) / (N + 2V))``, in exact decimal
arithmetic. A term of the language absent from a group still has ``count = 0``. Comparing two groups term by term
(``f = floor((p - q)^2 / (p + q))``) over all V kept terms would cost V times the pairs; instead the value of a pair
starts at ``V * f(base_a, base_b)``, what two absent terms give, and is corrected by streaming the postings alone
(see ``_pair_part``): never the terms times the pairs, and no row per posting and other source leaves its task.

Edge cases: null text, lang and source are ''; a text without a term gives no posting, its group still takes part
(N = 0); a language without kept terms (V = 0) gives pair values of 0 and no term rows; a language of one source gives
no pair rows. Repeated rows count as often as they occur; ``doc_id`` is not read, so null or repeated ids change
nothing. Extra columns are dropped at once. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.store import stored

# Fixed values of the contract.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: What lies between terms: the complement of TERM's class; splitting there is what TERM matches, and ten times faster.
#: Its characters are listed one by one, as Java looks those up in a table, but tries ranges one after the other.
BREAK = "[" + "".join(rf"\x{c:02X}" for c in range(0x80) if not chr(c).isalpha()) + "]+"
LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
SMOOTH = 2
TERM_RANKS = 10

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``; both at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q).cast("long")


def _terms(docs: DataFrame) -> DataFrame:
    """lang, source and the terms of each text, A-Z lower-cased; an empty one may stand at either end."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Only A-Z are lower-cased: for a text of ASCII alone that is what lower() does, and much faster than translate().
    text = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.split(text, BREAK).alias("terms"),
    )


def audit(docs: DataFrame) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank`` of the contract; see the module's docstring.

    Postings, groups and the streamed corrections are written to the shared folder once, as all later steps read
    them more than once.
    """
    terms = _terms(docs)
    in_documents = stored(
        terms.select("lang", F.explode(F.array_distinct("terms")).alias("term")).where(F.col("term") != "")
        .groupBy("lang", "term").count()
        .where(F.col("count") >= LEAST_DOCUMENTS)
        .select("lang", "term"),
        "divergence-terms",
    )
    counted = stored(
        terms.select("lang", "source", F.explode("terms").alias("term")).where(F.col("term") != "")
        .groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("c"))
        .join(in_documents, ["lang", "term"], "left_semi"),
        "divergence-counts",
    )
    width = in_documents.groupBy("lang").agg(F.count(F.lit(1)).alias("V"))
    totals = counted.groupBy("lang", "source").agg(F.sum("c").alias("N"))
    groups = stored(
        terms.select("lang", "source").distinct()
        .join(totals, ["lang", "source"], "left").join(width, "lang", "left")
        .select("lang", "source", F.coalesce("N", F.lit(0)).alias("N"), F.coalesce("V", F.lit(0)).alias("V"))
        .withColumn("base", F.when(F.col("V") > 0, _exact_p(F.lit(0), F.col("N"), F.col("V")))),
        "divergence-groups",
    )
    postings = stored(
        counted.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "c", "base", _exact_p(F.col("c"), F.col("N"), F.col("V")).alias("p")
        ),
        "divergence-postings",
    )
    return _term_part(postings, groups).unionByName(_pair_part(postings, groups))


def _exact_p(count: Column, total: Column, kept: Column) -> Column:
    wide = "DECIMAL(38,0)"
    top = (count.cast(wide) + F.lit(SMOOTH).cast(wide)) * F.lit(SCALE).cast(wide)
    bottom = total.cast(wide) + kept.cast(wide) * F.lit(SMOOTH).cast(wide)
    return (F.call_function("div", top, bottom) + 1).cast("long")


def _ranked(rows: DataFrame, most: int | None) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    rows = rows.withColumn("rank", F.row_number().over(order))
    if most is not None:
        rows = rows.where(F.col("rank") <= most)  # a limit per group: Spark keeps only so many per task before dealing
    return rows.select("lang", "source", "part", "item", "value", F.col("rank").cast("int"))


def _term_part(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """Each kept term of a group against its language: only terms the group holds and holds more often."""
    per_lang = postings.groupBy("lang", "term").agg(F.sum("c").alias("lc"))
    lang_total = groups.groupBy("lang").agg(F.sum("N").alias("LN"), F.max("V").alias("LV"))
    lang_p = per_lang.join(lang_total, "lang").select(
        "lang", "term", _exact_p(F.col("lc"), F.col("LN"), F.col("LV")).alias("q")
    )
    rows = (
        postings.join(lang_p, ["lang", "term"])
        .where(F.col("p") > F.col("q"))
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    )
    return _ranked(rows, TERM_RANKS)


def _pair_part(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """Every ordered pair of sources of a language, from the base value and corrections streamed from the postings.

    With ``p'`` a group's p where it holds the term and its base elsewhere, the value of ``(a, b)`` is
    ``V f(base_a, base_b)`` plus, over terms held by ``a``, ``f(p_a, base_b) - f0`` (``one(a, b)``), the same over
    terms held by ``b``, and over terms held by both what this counts wrongly:
    ``f(p_a, p_b) - f(p_a, base_b) - f(base_a, p_b) + f0``. ``one`` needs only how often each p occurs in a group; the
    last part meets the postings of a term with each other, and both are added up in the task that makes them.
    """
    hist = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("base").alias("other_base"))
    one = (
        hist.join(other, "lang").where(F.col("source") != F.col("other"))
        .join(groups.select("lang", "source", "base"), ["lang", "source"])
        .groupBy("lang", "source", "other")
        .agg(F.sum(F.col("m") * (_distance(F.col("p"), F.col("other_base")) - _distance(F.col("base"), F.col("other_base")))).alias("one"))
    )
    mine = postings.select("lang", "term", "source", "p", "base")
    theirs = postings.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("base").alias("other_base"))
    both = (
        mine.join(theirs, ["lang", "term"]).where(F.col("source") != F.col("other"))
        .select(
            "lang", "source", "other",
            (_distance(F.col("p"), F.col("q")) - _distance(F.col("p"), F.col("other_base"))
             - _distance(F.col("base"), F.col("q")) + _distance(F.col("base"), F.col("other_base"))).alias("d"),
        )
        .groupBy("lang", "source", "other").agg(F.sum("d").alias("both"))
    )
    pairs = groups.alias("a").join(groups.alias("b"), "lang").where(F.col("a.source") != F.col("b.source")).select(
        "lang", F.col("a.source").alias("source"), F.col("b.source").alias("other"),
        (F.col("a.V") * F.coalesce(_distance(F.col("a.base"), F.col("b.base")), F.lit(0))).alias("start"),
    )
    one = stored(one, "divergence-one")
    back = one.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("one").alias("back"))
    rows = (
        pairs.join(one, ["lang", "source", "other"], "left").join(back, ["lang", "source", "other"], "left")
        .join(both, ["lang", "source", "other"], "left")
        .select(
            "lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"),
            (F.col("start") + F.coalesce("one", F.lit(0)) + F.coalesce("back", F.lit(0)) + F.coalesce("both", F.lit(0)))
            .cast("long").alias("value"),
        )
    )
    return _ranked(rows, None)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_EXTRACT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_EXTRACT} AS terms FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
df AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d)
  GROUP BY lang, term HAVING count(*) >= {LEAST_DOCUMENTS}
), v AS (SELECT lang, count(*)::BIGINT AS V FROM df GROUP BY lang),
occ AS (
  SELECT lang, source, term, count(*)::BIGINT AS c FROM (SELECT lang, source, unnest(terms) AS term FROM d)
  SEMI JOIN df USING (lang, term) GROUP BY lang, source, term
), dense AS (
  SELECT g.lang, g.source, df.term, coalesce(occ.c, 0) AS c FROM g JOIN df USING (lang)
  LEFT JOIN occ ON occ.lang = g.lang AND occ.source = g.source AND occ.term = df.term
), n AS (SELECT lang, source, sum(c)::HUGEINT AS N FROM dense GROUP BY lang, source),
gp AS (
  SELECT dense.lang, dense.source, term, c,
         1 + ({SCALE}::HUGEINT * (c + {SMOOTH})) // (n.N + {SMOOTH} * v.V) AS p
  FROM dense JOIN n USING (lang, source) JOIN v USING (lang)
), lp AS (
  SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(c) + {SMOOTH})) // (ln.N + {SMOOTH} * v.V) AS q
  FROM dense JOIN (SELECT lang, sum(N) AS N FROM n GROUP BY lang) ln USING (lang) JOIN v USING (lang)
  GROUP BY lang, term, ln.N, v.V
), terms AS (
  SELECT gp.lang, gp.source, 'term' AS part, gp.term AS item,
         CAST(((gp.p - lp.q) * (gp.p - lp.q)) // (gp.p + lp.q) AS BIGINT) AS value
  FROM gp JOIN lp USING (lang, term) WHERE gp.c > 0 AND gp.p > lp.q
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         CAST(coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM gp x JOIN gp y ON x.term = y.term
                        WHERE x.lang = a.lang AND y.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TERM_RANKS}
"""
