"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in NumPy.

A word (lower-cased in A-Z, punctuation separates) enters as the vector of its hash bucket beside the mean vectors of
the buckets of its byte n-grams of two lengths, edges marked. Windows of ``WINDOW`` words, each overlapping the next by half, are read in both
directions; attention pools the states of a window into one score. A text scores as its highest window, so all windows
of every text are read.

Learning uses a bounded sample: the ``PER_CLASS`` labelled rows of each class that come first by hash of their id, and
of each text at most ``WINDOWS_PER_TEXT`` windows, evenly spread. The bounds are parameters. A positive text has few
toxic windows, so after a first round on random windows the network learns from each text's highest one and a random one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.store import in_python, stored
from scanloom.llm.text import WORD_BREAKS, Words, text_slices, words_of

WINDOW, STRIDE = 32, 16
HIDDEN = 8
VECTOR = 12
WORD_BUCKETS = 1 << 13
#: Buckets by length of n-gram.
GRAMS = {3: 1 << 12, 6: 1 << 14}
PER_CLASS = 1500
WINDOWS_PER_TEXT = 32
#: Least numbers of rounds over the sample, and of steps.
ROUNDS = 10
STEPS = 400
STEP_WINDOWS = 128
#: Texts of the sample in which a word must occur to have a vector of its own.
LEAST_TEXTS = 5
RATE = 0.01
SEED = 20240503
#: Windows read together.
CHUNK = 2048

Params = dict[str, np.ndarray]


@dataclass
class Vocabulary:
    """Distinct words: hash buckets, and for each length the buckets of their n-grams, ``cuts[i]:cuts[i + 1]`` of word ``i``."""

    buckets: np.ndarray
    grams: dict[int, np.ndarray]
    cuts: np.ndarray

    def part(self, used: np.ndarray) -> Vocabulary:
        sizes = np.diff(self.cuts)[used]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.arange(cuts[-1]) - np.repeat(cuts[:-1], sizes) + np.repeat(self.cuts[used], sizes)
        return Vocabulary(self.buckets[used], {n: g[inside] for n, g in self.grams.items()}, cuts)


def vocabulary_of(words: Words) -> tuple[Vocabulary, np.ndarray]:
    """The distinct words of a slice, and which of them each word is."""
    hashes, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    starts, lengths = words.starts[at], words.ends[at] - words.starts[at]
    cuts = np.concatenate([[0], np.cumsum(lengths)])  # an n-gram begins at every byte
    within = np.arange(cuts[-1]) - np.repeat(cuts[:-1], lengths)
    place, left = within + np.repeat(starts, lengths), np.repeat(lengths, lengths) - within
    data = words.data.astype(np.int64)
    value, grams = (within == 0).astype(np.int64), {}
    for k in range(max(GRAMS)):
        value = value * 1_000_003 + np.where(left > k, data[np.minimum(place + k, len(data) - 1)], 2)
        if k + 1 in GRAMS:
            grams[k + 1] = (((value * 2654435761) & 0xFFFFFFFF) >> 12) % GRAMS[k + 1]
    return Vocabulary((hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), grams, cuts), which


def windows_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of every window, and the window number at which each text begins."""
    counts = np.diff(bounds)
    windows = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1), 0)
    first = np.concatenate([[0], np.cumsum(windows)])
    text = np.repeat(np.arange(len(counts)), windows)
    offset = (np.arange(first[-1]) - first[text]) * STRIDE
    return bounds[text] + offset, np.minimum(WINDOW, counts[text] - offset), first


def new_params(seed: int = SEED) -> Params:
    rng = np.random.default_rng(seed)
    shape = {
        "words": (WORD_BUCKETS, VECTOR), **{f"grams{n}": (buckets, VECTOR) for n, buckets in GRAMS.items()},
        "enter": ((1 + len(GRAMS)) * VECTOR, 6 * HIDDEN),
        "bias": (6 * HIDDEN,), "recur": (2, HIDDEN, 3 * HIDDEN), "attend": (2 * HIDDEN, HIDDEN), "focus": (HIDDEN,),
        "out": (2 * HIDDEN,), "shift": (1,),
    }
    scale = {**{f"grams{n}": 0.1 for n in GRAMS}, "enter": 0.3, "recur": 0.3, "attend": 0.3, "focus": 0.3, "out": 0.3}
    return {k: (rng.standard_normal(s) * scale.get(k, 0.0)).astype(np.float32) for k, s in shape.items()}


def _vectors(params: Params, vocabulary: Vocabulary) -> np.ndarray:
    sizes = np.diff(vocabulary.cuts)[:, None].astype(np.float32)
    means = [np.add.reduceat(params[f"grams{n}"][g], vocabulary.cuts[:-1], axis=0) / sizes for n, g in vocabulary.grams.items()]
    return np.concatenate([params["words"][vocabulary.buckets], *means], axis=1)


def _entries(params: Params, vectors: np.ndarray) -> np.ndarray:
    """What each distinct word brings to the gates of both directions."""
    return vectors @ params["enter"] + params["bias"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _read(params: Params, entries: np.ndarray, index: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logits of windows; ``index`` names the word at each place. ``keep`` gets what learning needs."""
    count, h = len(index), HIDDEN
    mask = np.arange(WINDOW)[None, :] < lengths[:, None]
    state = np.zeros((2, count, h), np.float32)
    states = np.empty((WINDOW, 2, count, h), np.float32)
    both = entries.reshape(-1, 2, 3 * h)
    for t in range(WINDOW):
        places = (t, WINDOW - 1 - t)
        gates = np.stack([both[index[:, p], d] for d, p in enumerate(places)])
        on = np.stack([mask[:, p] for p in places])[:, :, None]
        past = state @ params["recur"]
        rz = _sigmoid(gates[..., : 2 * h] + past[..., : 2 * h])
        reset, update = rz[..., :h], rz[..., h:]
        fresh = np.tanh(gates[..., 2 * h :] + reset * past[..., 2 * h :])
        new = np.where(on, fresh + update * (state - fresh), state)
        if keep is not None:
            keep.append((state, reset, update, fresh, past[..., 2 * h :], on))
        state = new
        for d, p in enumerate(places):
            states[p, d] = new[d]
    full = states.transpose(2, 0, 1, 3).reshape(count, WINDOW, 2 * h)
    inner = np.tanh(full @ params["attend"])
    weight = np.where(mask, inner @ params["focus"], -1e9)
    weight = np.exp(weight - weight.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    pooled = (weight[:, :, None] * full).sum(axis=1)
    if keep is not None:
        keep.append((full, inner, weight, pooled))
    return pooled @ params["out"] + params["shift"][0]


def _gradients(params: Params, vocabulary: Vocabulary, vectors: np.ndarray, index: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> Params:
    """Gradients of the mean cross-entropy of windows."""
    h, keep = HIDDEN, []
    logits = _read(params, _entries(params, vectors), index, lengths, keep)
    full, inner, weight, pooled = keep.pop()
    error = ((_sigmoid(logits) - target) / len(target)).astype(np.float32)
    grads = {"out": pooled.T @ error, "shift": np.array([error.sum()], np.float32)}
    d_pooled = error[:, None] * params["out"]
    d_weight = (full * d_pooled[:, None, :]).sum(axis=2)
    d_logit = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
    grads["focus"] = np.einsum("nt,nth->h", d_logit, inner)
    d_inner = d_logit[:, :, None] * params["focus"] * (1 - inner * inner)
    grads["attend"] = np.einsum("nti,nth->ih", full, d_inner)
    d_full = weight[:, :, None] * d_pooled[:, None, :] + d_inner @ params["attend"].T
    d_states = d_full.reshape(len(index), WINDOW, 2, h).transpose(1, 2, 0, 3)
    d_entries = np.zeros((len(vectors), 2, 3 * h), np.float32)
    grads["recur"] = np.zeros_like(params["recur"])
    d_state = np.zeros((2, len(index), h), np.float32)
    for t in range(WINDOW - 1, -1, -1):
        places = (t, WINDOW - 1 - t)
        state, reset, update, fresh, past_new, on = keep[t]
        d_new = d_state + np.stack([d_states[p, d] for d, p in enumerate(places)])
        d_on = np.where(on, d_new, 0)
        d_fresh = d_on * (1 - update) * (1 - fresh * fresh)
        d_update = d_on * (state - fresh) * update * (1 - update)
        d_reset = d_fresh * past_new * reset * (1 - reset)
        d_past = np.concatenate([d_reset, d_update, d_fresh * reset], axis=2)
        grads["recur"] += state.transpose(0, 2, 1) @ d_past
        d_state = np.where(on, d_on * update, d_new) + d_past @ params["recur"].transpose(0, 2, 1)
        d_gates = np.concatenate([d_reset, d_update, d_fresh], axis=2)
        for d, p in enumerate(places):
            np.add.at(d_entries[:, d], index[:, p], d_gates[d])
    d_entries = d_entries.reshape(len(vectors), -1)
    grads["enter"], grads["bias"] = vectors.T @ d_entries, d_entries.sum(axis=0)
    d_vectors = d_entries @ params["enter"].T
    grads["words"] = np.zeros_like(params["words"])
    np.add.at(grads["words"], vocabulary.buckets, d_vectors[:, :VECTOR])
    sizes = np.diff(vocabulary.cuts)
    for i, (n, gram) in enumerate(vocabulary.grams.items(), 1):
        shares = d_vectors[:, i * VECTOR : (i + 1) * VECTOR] / sizes[:, None]
        grads[f"grams{n}"] = np.zeros_like(params[f"grams{n}"])
        np.add.at(grads[f"grams{n}"], gram, np.repeat(shares, sizes, axis=0))
    return grads


def _places(starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Word numbers of windows, place by place; places beyond a window's end repeat some word and are masked."""
    return which[np.minimum(starts[:, None] + np.arange(WINDOW), len(which) - 1)]


def _logits(params: Params, entries: np.ndarray, which: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    parts = [
        _read(params, entries, _places(starts[i : i + CHUNK], which), lengths[i : i + CHUNK])
        for i in range(0, len(starts), CHUNK)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = SEED) -> Params:
    """Parameters learned from labelled texts."""
    rng, params = np.random.default_rng(seed), new_params(seed)
    content = pa.array(texts, pa.large_string())
    _, _, data, offsets = next(text_slices(content, 1 << 62))
    words = words_of(data, offsets, lower=True, breaks=WORD_BREAKS)
    if not len(words.starts):
        return params
    vocabulary, which = vocabulary_of(words)
    starts, lengths, first = windows_of(words.bounds)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    number, count = np.arange(len(starts)) - first[text], np.diff(first)[text]
    # At most WINDOWS_PER_TEXT of a text, evenly spread.
    spread = (number * WINDOWS_PER_TEXT) // np.maximum(count, 1)
    chosen = (count <= WINDOWS_PER_TEXT) | (number == 0) | (np.concatenate([[-1], spread[:-1]]) != spread)
    starts, lengths, text = starts[chosen], lengths[chosen], text[chosen]
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    full = np.flatnonzero(np.diff(first))
    target = np.array(labels, np.float32)
    held = np.unique(np.repeat(np.arange(len(texts)), np.diff(words.bounds)) * WORD_BUCKETS + vocabulary.buckets[which])
    known = (np.bincount(held % WORD_BUCKETS, minlength=WORD_BUCKETS) >= LEAST_TEXTS)[:, None]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    rounds = max(rounds, -(-STEPS * STEP_WINDOWS // max(1, 2 * len(full))))
    for turn in range(rounds):
        random = lambda: first[full] + (rng.random(len(full)) * np.diff(first)[full]).astype(np.int64)
        picked = [random(), random()]
        if turn:
            logits = _logits(params, _entries(params, _vectors(params, vocabulary)), which, starts, lengths)
            order = np.lexsort((logits, text))
            top = order[first[full + 1] - 1]
            # A clean text's random windows are clean; a toxic one's may not be toxic.
            picked = [top, np.where(target[full] > 0, top, random())]
        windows = rng.permutation(np.concatenate(picked))
        for at in range(0, len(windows), STEP_WINDOWS):
            part = windows[at : at + STEP_WINDOWS]
            index = _places(starts[part], which)
            used, local = np.unique(index, return_inverse=True)
            own = vocabulary.part(used)
            grads = _gradients(params, own, _vectors(params, own), local.reshape(index.shape), lengths[part], target[text[part]])
            grads["words"] *= known
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Learning itself, in one task: the sample is bounded."""
    rows = [tuple(row.values()) for batch in batches for row in batch.to_pylist()]
    if rows:
        rows.sort()
        params = train([row[2] for row in rows], [row[3] for row in rows])
        data = [params[k].astype(np.float32).tobytes() for k in params]
        yield pa.RecordBatch.from_arrays([pa.array(list(params)), pa.array(data, pa.binary())], ["name", "data"])


def _score_batches(params: Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, last, data, offsets in text_slices(batch.column(2)):
                words = words_of(data, offsets, lower=True, breaks=WORD_BREAKS)
                best = np.full(last - begin, -np.inf)
                if len(words.starts):
                    vocabulary, which = vocabulary_of(words)
                    starts, lengths, first = windows_of(words.bounds)
                    logits = _logits(params, _entries(params, _vectors(params, vocabulary)), which, starts, lengths)
                    full = np.flatnonzero(np.diff(first))
                    best[full] = np.maximum.reduceat(logits, first[full])
                scores = np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best, -30, 30))), 0.0)
                part = slice(begin, last)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part], batch.column(1)[part], pa.array(scores, pa.float64()),
                        pa.array((scores >= 0.5).astype(np.int32)),
                    ],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return work


def held_out(of: int = 5, rest: int = 0) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == rest


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    ``labels`` has doc_id and toxic; rows with a null in either teach nothing, nor do held-out ones. Null texts and
    texts without words score 0. Without labels the network stays as it was drawn.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    known = known.where(~held_out()).withColumn("order", F.xxhash64("doc_id"))
    classes = [known.where(F.col("toxic") == label).orderBy("order", "doc_id").limit(per_class) for label in (0, 1)]
    sample = stored(classes[0].unionByName(classes[1]), "sample")  # at most twice per_class ids
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(sample), "doc_id").select("order", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    found = in_python(stored(rows, "texts").coalesce(1), _train_batches, "name string, data binary").collect()
    params = new_params()
    for row in found:
        params[row["name"]] = np.frombuffer(row["data"], np.float32).reshape(params[row["name"]].shape)
    chosen = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return in_python(chosen, _score_batches(params), "doc_id long, held_out boolean, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
