"""Near duplicates by an inverted join over MinHash signatures.

A document's set holds its distinct shingles of five words (lower-cased in A-Z). Documents whose sets have a Jaccard
similarity of 0.75 or more are linked, and linked documents form components.

1. ``sketches`` reads the texts once: set size, a digest of the set and 64 MinHash values.
2. Equal sets become one class, stood for by its smallest id, so copies cost nothing further on.
3. Each class is posted under its (coordinate, value) pairs. Two sets at the threshold agree on 48 of 64 coordinates on
   average and on fewer than ``MATCHES`` = 30 about once in ten million such pairs. A class with fewer shared postings
   than that has no partner; of ``s`` shared postings only the ``s - MATCHES + 1`` rarest need to be merged (the prefix),
   and the longer lists are skipped: their agreement is counted on the signatures.
4. A posting list is cut into blocks of about ``BLOCK`` classes. Each block gives every class its best agreeing, more
   central neighbour. These links are confirmed on the full sets and joined into components.
5. Lists that still hold several components are merged in full. Those with the same largest component are taken as one,
   so that a pair is met once. Classes outside that component meet all others, block by block, with their full sets;
   every agreeing pair across components is confirmed there, unless links found before have joined its components. So no
   list is cut short, however long, and pairs without a link leave no row.

Documents without words have no set and are linked with nothing. Documents without id take no part (component null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.components import components
from scanloom.llm.store import in_python, runs_of, stored
from scanloom.llm.text import Words, mix, text_slices, words_of

SHINGLE = 5
COORDINATES = 64
MATCHES = 30
BLOCK = 256
#: Shingles on one side of a block whose full sets are compared.
BLOCK_SHINGLES = 1_000_000
_random = np.random.default_rng(20240501)
_MULTIPLIERS = (_random.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1))[:, None]
_FLIPS = _random.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)[:, None]
SKETCH = "doc_id long, n_shingles long, sum_digest long, xor_digest long, signature array<int>"


def shingle_sets(words: Words) -> Iterator[np.ndarray]:
    """The sorted 64-bit shingle hashes of each text of a slice."""
    own = words.hashes()
    count = max(len(own) - SHINGLE + 1, 0)
    windows = np.zeros(count, np.uint64)
    for k in range(SHINGLE):
        windows *= np.uint64(0x100000001B3)
        windows += own[k : k + count]
    windows = mix(windows)
    for first, last in zip(words.bounds[:-1], words.bounds[1:]):
        if last - first >= SHINGLE:
            yield np.unique(windows[first : last - SHINGLE + 1])
        elif last > first:
            whole = np.uint64(last - first)
            for value in own[first:last]:
                whole = mix(np.array([whole], np.uint64) * np.uint64(0x100000001B3) + value)[0]
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the fixed permutations."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(least, ((low[at : at + 4096] ^ _FLIPS) * _MULTIPLIERS).min(axis=1), out=least)
    return least.view(np.int32)


def _sign_lists(signs: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(
        np.arange(0, COORDINATES * len(signs) + 1, COORDINATES, dtype=np.int32), np.concatenate(signs)
    )


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for first, last, data, offsets in text_slices(texts):
            sizes, sums, xors, signs = [], [], [], []
            for shingles in shingle_sets(words_of(data, offsets, lower=True)):
                sizes.append(len(shingles))
                sums.append(shingles.sum(dtype=np.uint64))
                xors.append(np.bitwise_xor.reduce(mix(shingles + np.uint64(1))) if len(shingles) else np.uint64(0))
                signs.append(signature(shingles) if len(shingles) else np.zeros(COORDINATES, np.int32))
            as_long = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, last - first), pa.array(sizes, pa.int64()), as_long(sums), as_long(xors), _sign_lists(signs)],
                ["doc_id", "n_shingles", "sum_digest", "xor_digest", "signature"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """Set size, set digest and MinHash signature per row, from one pass over the texts."""
    return in_python(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _sketch_batches, SKETCH)


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in text_slices(batch.column(1)):
            sets = list(shingle_sets(words_of(data, offsets, lower=True)))
            signs = [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                    _sign_lists(signs),
                ],
                ["doc_id", "n", "shingles", "signature"],
            )


def _signs(table: pa.Table) -> np.ndarray:
    return table.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)


def _agreement(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many coordinates agree, for each row of ``one`` with each row of ``other``."""
    counts = np.zeros((len(one), len(other)), np.int16)
    for k in range(COORDINATES):
        counts += one[:, k, None] == other[None, :, k]
    return counts


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(a, b), np.maximum(a, b)
    return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])


def _best_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in runs_of(batches, 2):
        reps, signs = table.column("rep").to_numpy(), _signs(table)
        for first in range(0, len(reps), 2 * BLOCK):  # blocks are about BLOCK long; twice that is the most at once
            own, part = reps[first : first + 2 * BLOCK], signs[first : first + 2 * BLOCK]
            counts = _agreement(part, part)
            central = np.lexsort((own, -counts.sum(axis=1, dtype=np.int64)))
            counts = np.tril(counts[np.ix_(central, central)], -1)
            best = counts.argmax(axis=1)
            fits = counts[np.arange(len(own)), best] >= MATCHES
            if fits.any():
                yield _pair_batch(own[central][fits], own[central][best[fits]])


def _reaches(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.75 or more."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < 75 * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return 100 * shared >= 75 * (len(a) + len(b) - shared)


def _links_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in runs_of(batches, 3):
        stray = table.column("stray").to_numpy(zero_copy_only=False).astype(bool)
        reps, signs = table.column("rep").to_numpy(), _signs(table)
        labels = table.column("component").to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").combine_chunks()]
        joined: dict[int, int] = {}

        def root(label: int) -> int:
            while (above := joined.get(label, label)) != label:
                joined[label] = joined.get(above, above)
                label = above
            return label

        left, right = np.flatnonzero(stray), np.flatnonzero(~stray)
        found = []
        for i in range(0, len(left), BLOCK):
            for j in range(0, len(right), BLOCK):
                p, q = left[i : i + BLOCK], right[j : j + BLOCK]
                counts = _agreement(signs[p], signs[q])
                x, y = np.nonzero(counts >= MATCHES)
                for k in np.argsort(-counts[x, y], kind="stable"):
                    a, b = int(p[x[k]]), int(q[y[k]])
                    one, other = root(labels[a]), root(labels[b])
                    if one != other and _reaches(sets[a], sets[b]):
                        joined[one] = other
                        found.append((a, b))
        if found:
            a, b = np.array(found).T
            yield _pair_batch(reps[a], reps[b])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, other = batch.column(2), batch.column(3)
        keep = [
            _reaches(np.frombuffer(one[i].as_buffer(), np.uint64), np.frombuffer(other[i].as_buffer(), np.uint64))
            for i in range(batch.num_rows)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Full sets and signatures of the documents ``ids``."""
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, "doc_id", "left_semi")
    schema = "doc_id long, n long, shingles binary, signature array<int>"
    return stored(in_python(chosen, _set_batches, schema), "sets")


def _links(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "left", "right")
    return stored(in_python(both, _confirmed, "a long, b long").distinct(), "links")


def _postings(reps: DataFrame) -> DataFrame:
    """``(token, rep, n)`` of the prefix postings in lists of two or more; equal lists are kept once."""
    every = reps.select("rep", F.posexplode("signature").alias("coordinate", "value")).select(
        "rep", (F.col("coordinate").cast("long") * F.lit(1 << 32) + F.col("value")).alias("token")
    )
    lengths = every.groupBy("token").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    shared = every.join(lengths, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("length", "token"))).alias("lists"))
    prefix = (
        shared.where(F.size("lists") >= MATCHES)
        .select("rep", F.explode(F.expr(f"slice(lists, 1, size(lists) - {MATCHES - 1})")).alias("posting"))
        .select("rep", F.col("posting.token").alias("token"))
    )
    prefix = stored(prefix, "postings")
    members = prefix.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("of"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("also")
    )
    kept = members.where("n > 1").groupBy("n", "of", "also").agg(F.min("token").alias("token")).select("token", "n")
    return prefix.join(kept, "token")


def _blocks(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _pieces(count: str, per: int) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(F.col(count) / per)).cast("long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest linked id), kept (doc_id = component_id).

    Rows without id get a null component and stay; rows with the same id count as one document whose every text may
    link it. Other columns are not read.
    """
    sketch = stored(sketches(docs), "sketch")
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["n_shingles", "sum_digest", "xor_digest"]
    classes = full.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    members = stored(full.select("doc_id", *digest).join(classes, digest).select("doc_id", "rep"), "classes")
    # A class is known by its smallest id; with repeated ids an id may stand for several sets, each posted for itself.
    reps = stored(
        full.join(classes.select(*digest, "rep"), digest).where("doc_id = rep").select("rep", "signature", *digest).dropDuplicates(["rep", *digest]).select("rep", "signature"),
        "signatures",
    )
    postings = stored(_postings(reps).join(reps, "rep"), "lists")
    cut = postings.withColumn("block", F.pmod(F.xxhash64("rep", "token"), _pieces("n", BLOCK)))
    near = in_python(_blocks(cut.select("token", "block", "rep", "signature"), "token", "block"), _best_neighbours, "a long, b long")
    copies = members.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    sets = _full_sets(docs, postings.select(F.col("rep").alias("doc_id")).distinct())
    links = _links(sets, stored(near.where("a <> b").distinct(), "near"))
    labels = components(links)

    placed = postings.select("token", "rep").join(labels, F.col("rep") == F.col("node"), "left")
    placed = placed.select("token", "rep", F.coalesce("component", "rep").alias("component"))
    shares = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("held"))
    mains = shares.groupBy("token").agg(
        F.max_by("component", F.struct("held", "component")).alias("main"), F.count(F.lit(1)).alias("kinds")
    )
    mixed = placed.join(mains.where("kinds > 1").select("token", "main"), "token").select("main", "rep", "component").distinct()
    mixed = stored(mixed.join(sets.select(F.col("doc_id").alias("rep"), "n"), "rep"), "mixed")
    stray = F.col("component") != F.col("main")
    loads = mixed.groupBy("main").agg(F.sum("n").alias("all"), F.sum(F.when(stray, F.col("n"))).alias("strays"))
    mixed = mixed.join(loads, "main").withColumn("place", F.xxhash64("rep"))
    rows, columns = _pieces("strays", BLOCK_SHINGLES), _pieces("all", BLOCK_SHINGLES)
    zero = F.lit(0).cast("long")
    as_stray = mixed.where(stray).select(
        "main", F.pmod("place", rows).alias("row"), F.explode(F.sequence(zero, columns - 1)).alias("column"),
        F.lit(True).alias("stray"), "rep", "component",
    )
    as_member = mixed.select(
        "main", F.explode(F.sequence(zero, rows - 1)).alias("row"), F.pmod("place", columns).alias("column"),
        F.lit(False).alias("stray"), "rep", "component",
    )
    full_rows = as_stray.unionByName(as_member).join(sets.withColumnRenamed("doc_id", "rep").drop("n"), "rep")
    met = _blocks(full_rows.select("main", "row", "column", "stray", "rep", "component", "signature", "shingles"), "main", "row", "column")
    across = in_python(met, _links_across, "a long, b long").distinct()
    final = components(links.unionByName(across).unionByName(copies))
    rows_out = sketch.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return rows_out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of linked documents the one with the smallest id, of rows with one id the least.

    Rows without id stay. The columns are those of ``docs``.
    """
    gone = stored(near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    rows = docs.join(gone, "doc_id", "left_anti")
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return rows.select(*docs.columns)
    least = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return rows.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(least.select("row.*"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
