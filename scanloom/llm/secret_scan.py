"""Secrets in texts: fixed patterns, and a battery of randomness tests on long unbroken tokens.

The patterns find assignments, access keys and long hexadecimal strings. Besides, what these leave of every run of
characters of the base64 and base64url alphabets is a candidate, each stretch of 20 or more by itself, if it holds a
letter and a digit, or letters of both cases (others are no likely draws from any of the alphabets below). Its encoding (hex, base32, alphanumeric, base64) is inferred from its characters; then three tests ask whether it can be a
uniform draw from that alphabet: chi-squared over its symbols, the number of runs above and below the alphabet's middle,
and the lag-1 serial correlation of symbol ranks.

A candidate is taken as random unless its tests reject that. All tests of a document are judged together by the
Benjamini-Yekutieli step-up rule (the tests of one token depend on each other), which bounds the share of truly random
tokens among the rejected. A token of ``n`` symbols uses the level ``LEVEL * (ENOUGH / n)`` and never less than
``LEVEL``: the tests are weak on short tokens, so these must look more random to count.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.store import in_python
from scanloom.llm.text import text_slices

# Patterns and kinds, in the order in which spans at one start are listed.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
LEAST = 20
LEVEL = 0.01
ENOUGH = 64
RANKS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alphanumeric": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
}
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"akia")
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
SPANS = "array<struct<kind: string, start: int, end: int>>"


def inferred_encoding(token: str) -> tuple[str, str]:
    """The narrowest alphabet that holds the token, and the token written in it."""
    if not set(token.lower()) - set(RANKS["hex"]) and token in (token.lower(), token.upper()):
        return "hex", token.lower()
    plain = token.replace("-", "+").replace("_", "/")
    for name in ("base32", "alphanumeric"):
        if not set(plain) - set(RANKS[name]):
            return name, plain
    return "base64", plain


def _both_sides(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str) -> tuple[float, float, float]:
    """p-values of the chi-squared, runs and serial-correlation tests of uniformity."""
    name, plain = inferred_encoding(token)
    symbols, n = len(RANKS[name]), len(plain)
    ranks = np.array([RANKS[name].index(c) for c in plain])
    counts = np.bincount(ranks, minlength=symbols)
    statistic = float((counts * counts).sum()) * symbols / n - n
    mean, spread = symbols - 1, 2 * (symbols - 1) * (n - 1) / n
    # Scaled chi-squared with the statistic's exact mean and variance, by the cube-root approximation.
    freedom = 2 * mean * mean / spread
    z = ((statistic / mean) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    high = ranks >= symbols / 2
    runs = 1 + int((high[1:] != high[:-1]).sum())
    runs_p = _both_sides((runs - 1 - (n - 1) / 2) / math.sqrt((n - 1) / 4))
    scaled = ranks - (symbols - 1) / 2
    variance = (symbols * symbols - 1) / 12
    serial_p = _both_sides(float((scaled[1:] * scaled[:-1]).sum()) / (variance * math.sqrt(n - 1)))
    return uniform, runs_p, serial_p


def random_tokens(tokens: list[str]) -> list[bool]:
    """Which of a document's candidates are not rejected as uniform draws."""
    if not tokens:
        return []
    found = [(p * min(1.0, len(t) / ENOUGH), i) for i, t in enumerate(tokens) for p in battery(t)]
    found.sort()
    tests = len(found)
    penalty = sum(1 / k for k in range(1, tests + 1))
    last = max((k for k, (p, _) in enumerate(found, 1) if p <= LEVEL * k / (tests * penalty)), default=0)
    rejected = {i for _, i in found[:last]}
    return [i not in rejected for i in range(len(tokens))]


def _remainders(first: int, last: int, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What the spans leave of ``first`` to ``last``, in stretches of LEAST or more."""
    left = []
    for start, end in sorted((s[1], s[2]) for s in spans if s[1] < last and first < s[2]):
        left.append((first, start))
        first = max(first, end)
    return [(a, b) for a, b in [*left, (first, last)] if b - a >= LEAST]


def _can_be_random(token: str) -> bool:
    lower, upper = (any(f(c) for c in token) for f in (str.islower, str.isupper))
    return lower and upper or (lower or upper) and any(c.isdigit() for c in token)


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    free = [x for m in CANDIDATE.finditer(text) for x in _remainders(*m.span(), spans) if _can_be_random(text[slice(*x)])]
    spans += [("random", *x) for x, kept in zip(free, random_tokens([text[slice(*x)] for x in free])) if kept]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that can hold a span: those with a keyword, or a run of LEAST characters of the candidates' alphabet."""
    marks = np.zeros(len(offsets) - 1, bool)
    lowered = data.tobytes().lower()
    places = []
    for word in _KEYWORDS:
        at = lowered.find(word)
        while at >= 0:
            places.append(at)
            at = lowered.find(word, at + len(word))
    breaks = np.concatenate([[-1], np.flatnonzero(~_RUN[data]), [len(data)]])
    long = np.diff(breaks) > LEAST
    places = np.concatenate([np.array(places, np.int64), breaks[:-1][long] + 1]).astype(np.int64)
    # A run may begin in one text and end in the next; then both are looked at.
    until = np.concatenate([places[: len(places) - long.sum()], breaks[1:][long] - 1])
    first = np.searchsorted(offsets, places, "right") - 1
    last = np.searchsorted(offsets, until, "right") - 1
    for a, b in zip(first, last):
        marks[a : b + 1] = True
    return marks


def _found(texts: pa.Array) -> Iterator[list[tuple[str, int, int]]]:
    for first, last, data, offsets in text_slices(texts):
        for i, look in enumerate(_suspects(data, offsets), first):
            yield spans_of(texts[i].as_py() or "") if look else []


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(_found(batch.column(1)))
        base = [[s for s in spans if s[0] != "random"] for spans in rows]
        counts = [pa.array([sum(s[0] == kind for s in spans) for spans in base], pa.int64()) for kind in KINDS[:3]]
        digests = pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, digests, pa.array([joined(spans) for spans in rows], pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def masked(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with each stretch of overlapping spans replaced by the mark."""
    parts, done = [], 0
    for _, start, end in spans:
        if start >= done:
            parts += [text[done:start], mark]
        done = max(done, end)
    return "".join(parts) + text[done:]


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of spans per row; null texts are empty and have none."""
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return in_python(chosen, _digest_batches, schema)


def mask_secrets(docs: DataFrame, mark: str = "[SECRET]", column: str = "text") -> DataFrame:
    """The same rows and columns, with every span of ``column`` replaced by ``mark``; null texts stay null."""
    at = docs.columns.index(column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            new = [
                masked(texts[i].as_py(), spans, mark) if spans else None for i, spans in enumerate(_found(texts))
            ]
            changed = pa.array([x is not None for x in new], pa.bool_())
            chosen = pa.compute.if_else(changed, pa.array(new, texts.type), texts)
            yield batch.set_column(at, batch.schema.field(at), chosen)

    return in_python(docs, work, docs.schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
