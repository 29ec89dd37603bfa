"""Exact top-k search by inner product over blocks with bounds.

Vectors become integers, floor(256 x). They are dealt evenly into runs; a run, in order of id, is cut into blocks, each
with the largest and smallest value of every term (component) in it. For a query a block's bound is the sum over terms of the larger of query times
maximum and query times minimum, so no vector of the block scores above it. Blocks are visited by falling bound and
scored through their forward index (the block's matrix) until the bound is below the k-th score found; blocks whose
bound equals it are still scored, as ties go to the smaller id.

Queries are dealt into batches; each batch meets each run once, as a unit of work of its own. A run gives k candidates
per query, and of those the k best are taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.store import in_python, runs_of, stored

K = 5
QUERY_EVERY = 50
BLOCK = 128
#: Vectors of a run, and queries of a batch.
RUN = 8192
BATCH = 1024


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, terms)``; vectors that are null, or hold a null or a non-finite component, are left out."""
    doubles = F.col("embedding").cast("array<double>")
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & sound)
    terms = F.transform(doubles, lambda x: F.floor(x * 256).cast("long"))
    return rows.select(F.col("vec_id").cast("long"), terms.alias("terms"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of terms side by side; shorter vectors end in zeros."""
    lists = column.combine_chunks()
    values, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), width), np.int64)
    if len(values):
        row = np.repeat(np.arange(len(lengths)), lengths)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        out[row, np.arange(len(values)) - np.repeat(first, lengths)] = values
    return out


def _products(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where that is exact too, which is faster."""
    most = float(np.abs(one).max(initial=0)) * float(np.abs(other).max(initial=0)) * one.shape[1]
    if most < 2.0**53:
        return (one.astype(np.float64) @ other.T.astype(np.float64)).astype(np.int64)
    return one @ other.T


def _best(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, terms: np.ndarray, k: int) -> Iterator[tuple]:
    """``(query_id, vec_id, score)`` of each query's k best of a run."""
    starts = np.arange(0, len(ids), BLOCK)
    most, least = np.maximum.reduceat(terms, starts), np.minimum.reduceat(terms, starts)
    bounds = _products(np.maximum(queries, 0), most) + _products(np.minimum(queries, 0), least)
    order = np.argsort(-bounds, axis=1, kind="stable")
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
    active, step = np.arange(len(query_ids)), 0
    while len(active) and step < len(starts):
        # Queries that want the same block next are scored together.
        wanted = order[active, step]
        for block in np.unique(wanted):
            who = active[wanted == block]
            part = slice(block * BLOCK, (block + 1) * BLOCK)
            scores = _products(queries[who], terms[part])
            for i, row in zip(who, scores):
                keep = ids[part] != query_ids[i]
                all_ids = np.concatenate([found[i][0], ids[part][keep]])
                all_scores = np.concatenate([found[i][1], row[keep]])
                best = np.lexsort((all_ids, -all_scores))[:k]
                found[i] = all_ids[best], all_scores[best]
        step += 1
        if step < len(starts):
            bound = bounds[active, order[active, step]]
            kth = np.array([found[i][1][-1] if len(found[i][1]) == k else np.iinfo(np.int64).min for i in active])
            active = active[bound >= kth]
    for query_id, (best_ids, best_scores) in zip(query_ids, found):
        for vec_id, score in zip(best_ids, best_scores):
            yield int(query_id), int(vec_id), int(score)


def _meetings(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, 2):
            asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            ids = table.column("vec_id").to_numpy()
            width = int(np.diff(table.column("terms").combine_chunks().offsets.to_numpy()).max(initial=0))
            terms = _matrix(table.column("terms"), width)
            own = np.flatnonzero(~asks)
            if not asks.any() or not len(own):
                continue
            own = own[np.argsort(ids[own], kind="stable")]
            rows = list(_best(terms[asks], ids[asks], ids[own], terms[own], k))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return work


def top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY) -> DataFrame:
    """Per query (ids divisible by ``query_every``) its k best other rows: query_id, rank, vec_id, score.

    Rows with the query's id are no candidates of it; a repeated candidate row counts once for each row. Vectors of
    different lengths are compared over the terms both have. Empty tables give no rows.
    """
    rows = stored(integer_vectors(vectors), "vectors")
    count, asked = rows.count(), rows.where(F.col("vec_id") % query_every == 0)
    runs, batches = max(1, math.ceil(count / RUN)), max(1, math.ceil(asked.count() / BATCH))
    zero = F.lit(0)
    dealt = rows.withColumn("run", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(runs)).cast("int"))
    candidates = dealt.select(
        "run", F.explode(F.sequence(zero, F.lit(batches - 1))).alias("batch"), F.lit(False).alias("asks"), "vec_id", "terms"
    )
    queries = asked.dropDuplicates(["vec_id", "terms"]).select(
        F.explode(F.sequence(zero, F.lit(runs - 1))).alias("run"),
        F.pmod(F.xxhash64("vec_id"), F.lit(batches)).cast("int").alias("batch"),
        F.lit(True).alias("asks"), "vec_id", "terms",
    )
    met = candidates.unionByName(queries).repartition("run", "batch").sortWithinPartitions("run", "batch")
    found = in_python(met, _meetings(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS terms
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.terms, c.terms), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
