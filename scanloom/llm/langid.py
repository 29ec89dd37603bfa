"""Language identification with hyperdimensional profiles.

Each letter code has a random vector of +1 and -1. A letter trigram is the product of its letters' vectors, the first
permuted twice, the second once (binding). A text is the sum of its trigrams' vectors (bundling), a language the sum of
its texts. A text is given the language whose prototype has the highest cosine.

Both are linear in trigram counts, so learning is one pass that counts trigrams per language over all learning rows;
the counts (at most codes cubed per language) are bundled into prototypes once. Common parts of all languages are taken
off the prototypes, which sharpens the cosines.

Letters are lower-cased Unicode letters: a to z have codes of their own, others share codes by their code point.
Everything else is one boundary code; runs of it count once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.store import in_python

DIMENSIONS = 512
CODES = 48
SEED = 20240502
#: How many languages may be learned; their prototypes are held by every worker.
MOST_LANGUAGES = 1000
UNKNOWN = "und"
#: Characters looked at together.
SLICE_CHARACTERS = 1_000_000


@functools.cache
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CODES, DIMENSIONS))


@functools.cache
def trigram_vectors() -> np.ndarray:
    """The bound vector of each trigram; row ``(a * CODES + b) * CODES + c``."""
    letters = letter_vectors()
    twice, once = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    pairs = (twice[:, None, :] * once[None, :, :]).reshape(-1, 1, DIMENSIONS)
    return (pairs * letters[None, :, :]).reshape(-1, DIMENSIONS)


@functools.cache
def _code_table() -> np.ndarray:
    """Code of each code point below 0x3000; 0 is the boundary."""
    table = np.zeros(0x3000, np.uint8)
    for point in range(len(table)):
        if (letter := chr(point)).isalpha():
            table[point] = _code(letter)
    return table


def _code(letter: str) -> int:
    low = letter.lower()[0]
    return ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (CODES - 27)


def letter_codes(text: str) -> np.ndarray:
    """Codes of a text, with one boundary before, after and between runs of letters; empty without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table = _code_table()
    codes = table[np.minimum(points, len(table) - 1)]
    for at in np.flatnonzero(points >= len(table)):
        codes[at] = _code(chr(points[at])) if chr(points[at]).isalpha() else 0
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint8)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep] if codes.any() else codes[:0]


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a whole text, and how often each occurs."""
    codes = letter_codes(text).astype(np.int32)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = (codes[:-2] * CODES + codes[1:-1]) * CODES + codes[2:]
    return np.unique(grams, return_counts=True)


@dataclass
class Prototypes:
    """Languages in order, and their unit vectors."""

    languages: list[str]
    vectors: np.ndarray

    def similarities(self, text: str) -> np.ndarray | None:
        """Cosines with each language; ``None`` without letters."""
        grams, counts = trigram_counts(text)
        if not len(grams) or not self.languages:
            return None
        own = counts.astype(np.float32) @ trigram_vectors()[grams].astype(np.float32)
        return self.vectors @ own / max(float(np.linalg.norm(own)), 1e-9)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            grams, counts = trigram_counts(text or "")
            if len(grams):
                # Each text counts alike, whatever its length.
                total = totals.setdefault(lang, np.zeros(CODES**3))
                total[grams] += counts / np.sqrt(float((counts * counts).sum()))
    for lang, total in totals.items():
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(total[grams])], ["lang", "gram", "weight"]
        )


def learn(rows: DataFrame) -> Prototypes:
    """Prototypes from all rows ``(lang, text)`` whose language isn't null."""
    known = rows.where("lang IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counted = in_python(known, _count_batches, "lang string, gram long, weight double")
    totals = counted.groupBy("lang", "gram").agg(F.sum("weight").alias("weight"))
    profiles: dict[str, np.ndarray] = {}
    for row in totals.toLocalIterator():
        if row.lang not in profiles and len(profiles) == MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        # Rounded, so that the order of summing cannot show.
        profiles.setdefault(row.lang, np.zeros(CODES**3, np.float32))[row.gram] = round(row.weight, 4)
    languages = sorted(profiles)
    bundles = np.zeros((len(languages), DIMENSIONS), np.float64)
    for i, lang in enumerate(languages):
        for first in range(0, CODES**3, 8192):
            part = profiles[lang][first : first + 8192].astype(np.float64)
            bundles[i] += part @ trigram_vectors()[first : first + 8192]
    unit = bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
    if len(languages) > 1:
        unit -= unit.mean(axis=0)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    return Prototypes(languages, unit.astype(np.float32))


def _predict_batches(prototypes: Prototypes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for text in batch.column(2).to_pylist():
                found = prototypes.similarities(text or "")
                best = int(found.argmax()) if found is not None else -1
                names.append(prototypes.languages[best] if best >= 0 else UNKNOWN)
                scores.append(min(max(float(found[best]), 0.0), 1.0) if best >= 0 else 0.0)
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return work


def held_out(of: int = 4, rest: int = 2) -> Column:
    """Whether a row is kept from learning; a null id is as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == rest


def identify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score (the cosine, cut to 0..1).

    Rows that are held out teach nothing. ``und`` with score 0 is given to null texts, to texts without a letter, and
    to all if there is nothing to learn from. Ties go to the first language by name.
    """
    prototypes = learn(docs.where(~held_out()).select("lang", "text"))
    chosen = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return in_python(chosen, _predict_batches(prototypes), "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with ``lang`` set to it.

    Rejected are null texts, texts without a letter, and those whose cosine with every prototype is ``least`` or lower.
    """
    prototypes = learn(docs.where(~held_out()).select("lang", "text"))
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for text in batch.column(text_at).to_pylist():
                found = prototypes.similarities(text or "")
                fits = found is not None and float(found.max()) > least
                names.append(prototypes.languages[int(found.argmax())] if fits else None)
            named = pa.array(names, batch.schema.field(lang_at).type)
            yield batch.set_column(lang_at, batch.schema.field(lang_at), named).filter(named.is_valid())

    return in_python(docs, work, docs.schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
