"""Language-model scores by masked pseudo-likelihood.

Every word of a text is predicted from the two words before and the two after it, itself hidden, by a network trained
in NumPy; the log-probabilities, summed over the text, are its score.

Words (lower-cased in A-Z) are hashed into ``BUCKETS``, which stand for them from here on. The buckets with the highest
corpus counts are output classes of their own, all others share classes by hash. The network predicts the class by a
softmax, and the word within it by the turns of the class's Huffman tree of counts: each inner node has a vector and is a
logistic regression on the hidden layer that starts from the counts of its two sides. Counts are taken over all texts.
The hidden layer is a tanh over the sum of a vector per context place and class and, in its last ``WIDTH`` units, of the
context words' own vectors.

It learns from every word of all texts, where they lie: in each of ``ROUNDS`` passes every task goes on from the common
parameters over its own texts with other words, each word being hidden in one of the passes. The results are averaged by
words seen, for vectors of words and nodes by how often a task had them. A task sends its counts, its parameters and the
changes of the vectors it touched, so what is gathered grows with the input, while what workers are given does not.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.store import in_python
from scanloom.llm.text import Words, mix, text_slices, words_of

BUCKETS = 1 << 18
CLASSES, OWN = 128, 64
PLACES = (-2, -1, 1, 2)
HIDDEN = 24
#: Hidden units that words' own vectors enter, and that decide within classes.
WIDTH = 8
#: Rows of the table of vectors: words, the place beyond a text's ends, and from NODES on the trees' nodes.
NODES, ROWS = BUCKETS + 1, 2 * BUCKETS + 256
#: Rows are sent and averaged in groups.
GROUP, PART = 256, 1024
#: Each round learns from every ROUNDS-th word, so all together from every word.
ROUNDS = 2
STEP_WORDS = 1024
#: Of runs of equal keys so many rows are added up at once for all runs.
SHORT = 8
CHUNK = 2048
RATE = 0.004
WORD_RATE = 0.1
SEED = 20240504

_SHAPES = {"enter": (len(PLACES), CLASSES + 1, HIDDEN), "bias": (HIDDEN,), "out": (HIDDEN, CLASSES), "shift": (CLASSES,)}
Params = dict[str, np.ndarray]


def new_params() -> Params:
    rng = np.random.default_rng(SEED)
    return {k: (rng.standard_normal(s) * (0.2 if len(s) > 1 else 0)).astype(np.float32) for k, s in _SHAPES.items()}


def flat(params: Params) -> np.ndarray:
    return np.concatenate([params[k].reshape(-1) for k in _SHAPES])


def shaped(values: np.ndarray) -> Params:
    params, at = {}, 0
    for k, s in _SHAPES.items():
        size = int(np.prod(s))
        params[k] = values[at : at + size].reshape(s).astype(np.float32, copy=False)
        at += size
    return params


def _buckets(words: Words) -> np.ndarray:
    return (words.hashes() & np.uint64(BUCKETS - 1)).astype(np.int64)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, last, data, offsets in text_slices(texts):
        words = words_of(data, offsets, lower=True)
        yield first, last, _buckets(words) if len(words.starts) else np.zeros(0, np.int64), words.bounds


def contexts(buckets: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Buckets around the words ``at``; beyond a text's ends stands an extra one."""
    reach = max(map(abs, PLACES))
    # Texts are laid out with as many extra ones between them as the places reach.
    there = np.arange(len(buckets)) + np.repeat(reach * np.arange(1, len(bounds)), np.diff(bounds))
    spread = np.full(len(buckets) + reach * len(bounds), BUCKETS, np.int32)
    spread[there] = buckets
    there = there.take(at)
    return np.array([spread.take(there + place) for place in PLACES])


def _hidden(params: Params, context: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """``own`` are the sums of the context words' own vectors."""
    total = params["enter"][0].take(context[0], axis=0)
    for k in range(1, len(PLACES)):
        total += params["enter"][k].take(context[k], axis=0)
    total += params["bias"]
    if own is not None:
        total[:, -WIDTH:] += own
    return np.tanh(total, out=total)


def _with_one(hidden: np.ndarray) -> np.ndarray:
    """The hidden units and a last one that is always 1, whose weight is a shift."""
    given = np.ones((len(hidden), hidden.shape[1] + 1), hidden.dtype)
    given[:, :-1] = hidden
    return given


def _logits(params: Params, hidden: np.ndarray) -> np.ndarray:
    """Of units that are at most 1 in size, also given with the one that is always 1."""
    weights = np.concatenate([params["out"], params["shift"][None]])
    logits = (hidden if hidden.shape[1] > HIDDEN else _with_one(hidden)) @ weights
    if np.abs(weights).max() * len(weights) > 60:  # else none can be above
        np.minimum(logits, 60, out=logits)
    return logits


def gradients(
    params: Params,
    context: np.ndarray,
    target: np.ndarray,
    own: np.ndarray | None = None,
    within: Callable[[np.ndarray], np.ndarray] | None = None,
) -> Params:
    """Gradients of the mean negative log-probability of the hidden words' classes.

    ``within`` gives the gradient of what else is predicted from the last hidden units. "own" is that of ``own``.
    """
    hidden = _hidden(params, context, own)
    given = _with_one(hidden)
    share = _logits(params, given)
    np.exp(share, out=share)
    # Rows are divided by their sums after the products, which are far smaller.
    total = _row_sums(share)
    share[np.arange(len(target)), target] -= total
    scale = (1 / (total * len(target)))[:, None]
    inner = share @ params["out"].T
    inner *= scale
    if within is not None:
        inner[:, -WIDTH:] += within(hidden[:, -WIDTH:]) / len(target)
    inner *= 1 - hidden * hidden
    given *= scale
    out = given.T @ share
    enter = np.zeros_like(params["enter"])
    keys = context + enter.shape[1] * np.arange(len(context), dtype=np.int16)[:, None]
    order, first, found = _runs(keys.astype(np.int16).reshape(-1))
    enter.reshape(-1, HIDDEN)[found] = _run_sums(inner, np.concatenate([np.arange(len(target))] * len(context)).take(order), first)
    return {"enter": enter, "bias": inner.sum(axis=0), "out": out[:-1], "shift": out[-1], "own": inner[:, -WIDTH:]}


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the keys, where each key's run begins in it, and the keys of the runs."""
    if keys.dtype == np.int16:  # short integers are sorted by radix
        order = np.argsort(keys, kind="stable")
        found = keys[order]
    else:
        both = (keys.astype(np.int64) << 32) | np.arange(len(keys))
        both.sort()
        order, found = both & 0xFFFFFFFF, both >> 32
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return order, first, found[first]


def _run_sums(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` that stand in ``order`` from each of ``first`` up to the next; as wide as an even number."""
    pairs = np.complex64 if values.dtype == np.float32 else np.complex128  # two columns are added up at a time
    return np.add.reduceat(values.view(pairs).take(order, axis=0), first, axis=0).view(values.dtype)


def _short_run_sums(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The same where most runs are short: up to ``SHORT`` rows are added up for all runs at once, row after row."""
    count = np.diff(np.append(first, len(order)))
    sums = values.take(order.take(first), axis=0)
    more = np.flatnonzero(count > 1)
    more = more.take(np.argsort(-count.take(more), kind="stable"))
    count, begin, part = count.take(more), first.take(more), sums.take(more, axis=0)
    longer = np.searchsorted(-count, -np.arange(1, SHORT + 1)).tolist()
    for k, n in enumerate(longer[:-1], 1):
        if n:
            part[:n] += values.take(order.take(begin[:n] + k), axis=0)
    if n := longer[-1]:
        left = count[:n] - SHORT
        at = np.cumsum(left) - left
        part[:n] += _run_sums(values, order.take(np.repeat(begin[:n] + SHORT - at, left) + np.arange(left.sum())), at)
    sums[more] = part
    return sums


def _row_sums(values: np.ndarray) -> np.ndarray:
    return values @ np.ones(values.shape[1], values.dtype)


def _spread(values: np.ndarray, width: int) -> np.ndarray:
    """Each value ``width`` times in a row: short rows are slow to multiply by one value each."""
    return np.repeat(values, width).reshape(len(values), width)


@dataclass
class Levels:
    """Ways level by level: in ``order`` the longest way stands first, and the first ``reached[k]`` have a ``k``-th step."""

    order: np.ndarray
    reached: list[int]
    node: np.ndarray
    side: np.ndarray


@dataclass
class Trees:
    """Of each bucket the way from its leaf to its class's root: ``steps[starts[b]:starts[b + 1]]``.

    A step is twice the node, and one more on the node's right side. ``base`` is the log-odds of the left side by counts.
    """

    starts: np.ndarray
    steps: np.ndarray
    base: np.ndarray
    #: The place of each bucket by falling count, which stands for it in all tables: what is often used lies together.
    ranks: np.ndarray

    def ways(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and sides (1 or -1) on the ways of the buckets, one after the other, and each way's length."""
        first = self.starts.take(buckets)
        count = self.starts.take(buckets + 1) - first
        ends = np.cumsum(count)
        steps = self.steps.take(np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count))
        return steps >> 1, (1 - 2 * (steps & 1)).astype(np.float32), count

    def levels(self, buckets: np.ndarray) -> Levels:
        """The same ways in an order that lets whole levels be worked on without picking rows."""
        first = self.starts.take(buckets)
        count = self.starts.take(buckets + 1) - first
        order = np.argsort((-count).astype(np.int16), kind="stable")
        first, count = first.take(order), count.take(order)
        reached = (len(count) - np.searchsorted(count[::-1], np.arange(count[0]), "right")).tolist() if len(count) else []
        steps = self.steps.take(np.concatenate([np.zeros(0, np.int32), *(first[:n] + k for k, n in enumerate(reached))]))
        return Levels(order, reached, steps >> 1, (1 - 2 * (steps & 1)).astype(np.float32))


def trees_of(counts: np.ndarray, classes: np.ndarray, ranks: np.ndarray) -> Trees:
    """Huffman trees of the counted buckets of each class; counts and classes by rank."""
    parent, base, totals = np.full(2 * BUCKETS, -1, np.int64), np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.int64)
    side, nodes = np.zeros(2 * BUCKETS, np.int64), 0
    full = np.flatnonzero(counts)
    full = full[np.argsort(classes[full], kind="stable")]
    for members in np.split(full, np.flatnonzero(np.diff(classes[full])) + 1):
        heap = list(zip(counts[members].tolist(), members.tolist()))
        heapq.heapify(heap)
        while len(heap) > 1:
            low, left = heapq.heappop(heap)
            high, right = heap[0]
            parent[left] = parent[right] = nodes
            side[right] = 1
            base[nodes], totals[nodes] = np.log(low / high), low + high
            heapq.heapreplace(heap, (low + high, BUCKETS + nodes))
            nodes += 1
    leaves, at, ways = full, full, []
    while len(leaves):
        inner = parent[at] >= 0
        leaves, at = leaves[inner], at[inner]
        ways.append((leaves, parent[at] * 2 + side[at]))
        at = BUCKETS + parent[at]
    leaf, steps = (np.concatenate(x) if ways else np.zeros(0, np.int64) for x in (list(zip(*ways)) or [(), ()]))
    starts = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=BUCKETS))])
    order = np.argsort(-totals, kind="stable")  # nodes by falling count, too
    place = np.empty(BUCKETS, np.int64)
    place[order] = np.arange(BUCKETS)
    steps = (2 * place[steps >> 1] + (steps & 1))[np.argsort(leaf, kind="stable")]
    return Trees(starts.astype(np.int32), steps.astype(np.int32), base[order], ranks)


def _odds(rows: np.ndarray, trees: Trees, hidden: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each step on the buckets' ways, one way after the other, the log-odds of the side taken; way lengths."""
    node, side, count = trees.ways(buckets)
    given = _with_one(hidden).take(np.repeat(np.arange(len(hidden)), count), axis=0)
    given *= rows.take(NODES + node, axis=0)
    return side * (_row_sums(given) + trees.base.take(node)), count


def within_gradients(
    rows: np.ndarray, trees: Trees, hidden: np.ndarray, buckets: np.ndarray, gathered: tuple[Levels, np.ndarray] | None = None
) -> tuple[np.ndarray, ...]:
    """Gradients of the summed negative log-probability within classes: of ``hidden``, and of the nodes on the ways.

    ``gathered`` are the buckets' ways, if known, and the places of their nodes in ``rows``. Of wider rows only the vector
    and the shift are read, and the nodes' gradients are as wide, with zeros.
    """
    levels, places = gathered or (trees.levels(buckets), None)
    own = rows.take(NODES + levels.node if places is None else places, axis=0)
    given = np.zeros((len(hidden), rows.shape[1]), hidden.dtype)
    given[:, :WIDTH], given[:, WIDTH] = hidden.take(levels.order, axis=0), 1
    given = np.concatenate([given[:0], *(given[:n] for n in levels.reached)])
    odds = levels.side * (_row_sums(given * own) + trees.base.take(levels.node))
    slope = _spread(-levels.side / (1 + np.exp(np.minimum(odds, 60))), rows.shape[1])
    own *= slope
    given *= slope
    sums, at = np.zeros((len(hidden), rows.shape[1]), hidden.dtype), 0
    for n in levels.reached:
        sums[:n] += own[at : at + n]
        at += n
    back = np.empty_like(hidden)
    back[levels.order] = sums[:, :WIDTH]
    return back, levels.node, given


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, buckets, _ in _slices(batch.column(0)):
            counts += np.bincount(buckets, minlength=BUCKETS)
    full = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["bucket", "count"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Corpus counts by bucket, over all texts; at most ``BUCKETS`` rows come to the driver."""
    counted = in_python(texts, _count_batches, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))
    counts = np.zeros(BUCKETS, np.int64)
    for row in counted.collect():
        counts[row["bucket"]] = row["count"]
    return counts


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, Trees]:
    """The class of each rank, with one for the place beyond a text's ends, and the trees of words within classes."""
    spread = mix(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(1)) % np.uint64(CLASSES - OWN)
    order, ranks = np.lexsort((np.arange(BUCKETS), -counts)), np.empty(BUCKETS, np.int32)
    ranks[order] = np.arange(BUCKETS)
    classes = np.concatenate([OWN + spread.astype(np.int64)[order], [CLASSES]])
    classes[:OWN] = np.arange(OWN)
    return classes.astype(np.int16), trees_of(counts[order], classes[:-1], ranks)


def new_rows() -> np.ndarray:
    """Vectors of words and nodes, and the nodes' shifts; with zeros the counts alone decide within classes."""
    return np.zeros((ROWS, WIDTH + 1), np.float32)


def _sums(rows: np.ndarray, around: np.ndarray) -> np.ndarray:
    total = rows.take(around[0], axis=0)
    for k in range(1, len(PLACES)):
        total += rows.take(around[k], axis=0)
    return total[:, :WIDTH]


class _Words:
    """The vectors of a task, learned at a rate that falls with a row's past gradients.

    A row of ``state`` also holds these gradients' squares.
    """

    def __init__(self, rows: np.ndarray, trees: Trees):
        self.given, self.trees = rows, trees
        self.state = np.zeros((ROWS, WIDTH + 2), np.float32)
        self.state[:, :-1] = rows
        self.whole = self.state.view(f"V{self.state.strides[0]}").reshape(-1)  # faster to set than rows of numbers
        self.around, self.targets = np.zeros(NODES, np.int64), np.zeros(BUCKETS, np.int64)

    def see(self, around: np.ndarray, targets: np.ndarray) -> None:
        """Counts the words of steps."""
        self.around += np.bincount(around.reshape(-1), minlength=NODES)
        self.targets += np.bincount(targets, minlength=BUCKETS)

    def gather(self, around: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[Levels, np.ndarray]]:
        """The rows that a step needs, the places of the words around in them, and the ways to the targets with their places."""
        levels = self.trees.levels(targets)
        self.order, self.first, self.found = _runs(np.concatenate([around.reshape(-1), NODES + levels.node]))
        places = np.empty(len(self.order), np.int64)
        places[self.order] = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.order))))
        self.rows = self.state.take(self.found, axis=0)
        return self.rows, places[: around.size].reshape(around.shape), (levels, places[around.size :])

    def step(self, own: np.ndarray, nodes: np.ndarray) -> None:
        """Gradients of the gathered words around, equal for all places, and of the nodes on the ways."""
        grads = np.zeros((len(own) + len(nodes), WIDTH + 2), np.float32)
        grads[: len(own), :WIDTH] = own
        grads[len(own) :] = nodes
        rows = np.concatenate([np.arange(len(own))] * len(PLACES) + [np.arange(len(own), len(grads))])
        sums = _short_run_sums(grads, rows.take(self.order), self.first)
        squares = _row_sums(sums * sums) / WIDTH
        sums *= _spread(-WORD_RATE / np.sqrt(1 + self.rows[:, -1] + squares), WIDTH + 2)
        sums[:, -1] = squares
        sums += self.rows
        self.whole[self.found] = sums.view(self.whole.dtype).reshape(-1)

    def seen(self) -> np.ndarray:
        """How often each row was seen."""
        words = np.flatnonzero(self.targets)
        node, _, count = self.trees.ways(words)
        nodes = np.bincount(node, np.repeat(self.targets[words], count), ROWS - NODES)
        return np.concatenate([self.around, nodes.astype(np.int64)])

    def changes(self) -> Iterator[tuple[int, bytes]]:
        """By group: places, how often seen, and changes in half precision, whose weighted sums are exact."""
        seen = self.seen()
        for group in range(ROWS // GROUP):
            part = slice(group * GROUP, (group + 1) * GROUP)
            at = np.flatnonzero(seen[part])
            if len(at):
                change = (self.state[part][at, :-1] - self.given[part][at]).astype(np.float16)
                yield group, at.astype(np.uint8).tobytes() + seen[part][at].astype(np.int32).tobytes() + change.tobytes()


def _param_parts(params: Params, seen: int) -> Iterator[tuple[int, bytes]]:
    """The parameters in parts of PART, numbered -1, -2 and so on, each after the number of words seen."""
    values = flat(params)
    for k, i in enumerate(range(0, len(values), PART), 1):
        yield -k, np.int64(seen).tobytes() + values[i : i + PART].astype(np.float32).tobytes()


def _mean_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the parts, weighted by what was seen."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key < 0:
                values, seen = np.frombuffer(part, np.float32, offset=8)[None].astype(np.float64), np.frombuffer(part, np.int64, 1)
                at, size = np.zeros(1, np.int64), 1
            else:
                n = len(part) // (5 + 2 * (WIDTH + 1))
                at, seen, size = np.frombuffer(part, np.uint8, n), np.frombuffer(part, np.int32, n, n), GROUP
                values = np.frombuffer(part, np.float16, offset=5 * n).reshape(n, WIDTH + 1).astype(np.float64)
            total = sums.setdefault(key, np.zeros((size, values.shape[1] + 1)))
            total[at, :-1] += values * seen[:, None]
            total[at, -1] += seen
    # Rounded, so that the order of summing cannot show.
    means = [np.round(t[:, :-1] / np.maximum(t[:, -1:], 1), 6).astype(np.float32).tobytes() for t in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(means, pa.binary())], ["part", "mean"])


def _learn_batches(
    values: np.ndarray, classes: np.ndarray, turn: int, rows: np.ndarray | None = None, trees: Trees | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Without ``rows`` and ``trees``: new ones, and nothing is learned within classes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, seen, step = values.astype(np.float32), 0, 0
        params = shaped(learned)  # parts of what is learned, not copies
        words = _Words(new_rows() if rows is None else rows, trees or trees_of(np.zeros(BUCKETS, np.int64), classes, np.arange(BUCKETS)))
        m, v = np.zeros_like(learned), np.zeros_like(learned)
        for batch in batches:
            for _, _, buckets, bounds in _slices(batch.column(0)):
                buckets = words.trees.ranks.take(buckets)
                # Other words in each round, in shuffled order.
                at = np.arange(turn, len(buckets), ROUNDS)
                at = np.random.default_rng(len(buckets) + turn).permutation(at)
                all_around, targets = contexts(buckets, bounds, at), buckets.take(at)
                words.see(all_around, targets)
                context, target = classes.take(all_around), classes.take(targets).astype(np.int64)
                for i in range(0, len(at), STEP_WORDS):
                    part, found = slice(i, i + STEP_WORDS), []
                    own_rows, places, ways = words.gather(all_around[:, part], targets[part])

                    def within(hidden: np.ndarray) -> np.ndarray:
                        back, _, nodes = within_gradients(own_rows, words.trees, hidden, targets[part], ways)
                        found.append(nodes)
                        return back

                    grads = gradients(params, context[:, part], target[part], _sums(own_rows, places), within)
                    words.step(grads.pop("own") * len(places[0]), *found)
                    step += 1
                    g = flat(grads)
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    learned -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
                seen += len(at)
        if seen:
            keys, parts = zip(*_param_parts(params, seen), *words.changes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(parts, pa.binary())], ["part", "sent"])

    return work

def learn(texts: DataFrame, classes: np.ndarray, trees: Trees) -> tuple[Params, np.ndarray]:
    values, rows = flat(new_params()), new_rows()
    for turn in range(ROUNDS):
        sent = in_python(texts, _learn_batches(values, classes, turn, rows, trees), "part int, sent binary")
        means = in_python(sent.repartition("part"), _mean_batches, "part int, mean binary")
        rows = rows.copy()
        for part, mean in means.collect():  # as many rows as the tables have parts
            mean = np.frombuffer(mean, np.float32)
            if part < 0:
                values[(-part - 1) * PART :][: len(mean)] = mean
            else:
                rows[part * GROUP : (part + 1) * GROUP] += mean.reshape(GROUP, WIDTH + 1)
    return shaped(values), rows


def _score_batches(
    params: Params, rows: np.ndarray, classes: np.ndarray, trees: Trees
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buckets, bounds in _slices(batch.column(1)):
                buckets, scores = trees.ranks.take(buckets), np.zeros(len(buckets) + 1)
                all_around = contexts(buckets, bounds, np.arange(len(buckets)))
                for i in range(0, len(buckets), CHUNK):
                    around, targets = all_around[:, i : i + CHUNK], buckets[i : i + CHUNK]
                    hidden = _hidden(params, classes.take(around), _sums(rows, around))
                    logits = _logits(params, hidden)
                    score = logits[np.arange(len(targets)), classes.take(targets)]
                    score -= np.log(_row_sums(np.exp(logits, out=logits)))
                    odds, count = _odds(rows, trees, hidden[:, -WIDTH:], targets)
                    turns = np.concatenate([[0], np.cumsum(-np.log1p(np.exp(np.minimum(-odds, 60))), dtype=np.float64)])
                    ends = np.cumsum(count)
                    scores[i + 1 : i + 1 + CHUNK] = score + (turns[ends] - turns[ends - count])
                sums = np.cumsum(scores)
                count, total = np.diff(bounds), sums[bounds[1:]] - sums[bounds[:-1]]
                mean = pa.array(np.round(total / np.maximum(count, 1), 4), mask=count == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(count, pa.int64()), pa.array(np.round(total, 3)), mean],
                    ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"],
                )

    return work


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, log_likelihood and its mean per word.

    Null texts and texts without words have 0 words, a log-likelihood of 0 and a null mean.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = rows.select("text")
    classes, trees = classes_of(bucket_counts(texts))
    params, vectors = learn(texts, classes, trees)
    schema = "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double"
    return in_python(rows, _score_batches(params, vectors, classes, trees), schema)


def op1_pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
