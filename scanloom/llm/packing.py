"""Packing token ids into sequences of at most ``CAPACITY``.

A document is cut into as many full sequences as it fills; what remains is packed with other remainders. For that the
remainders are dealt out evenly into groups of about ``GROUP``, and each group is divided into near-equal windows by
Karmarkar-Karp multiway differencing: the two partial partitions with the largest imbalances are merged so that the
large windows of one meet the small ones of the other, until one partition is left. A group starts with as few windows
as can hold it; while some window is above the capacity, the number of windows rises.

Tokenizing dominates. A space followed by a non-space always starts a new pre-token, so a text falls into units that
are encoded independently of each other; ids of units are kept in a table of bounded size. Texts with other runs of
white space are encoded whole. Ids equal those of the tokenizer on the whole text.
"""

from __future__ import annotations

import base64
import heapq
import math
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.store import in_python, runs_of, stored

CAPACITY = 2048
GROUP = 256
END_ID = 1
#: Units whose ids a worker keeps; beyond it starts anew.
KEPT_UNITS = 600_000
SLICE_DOCS = 256
#: First character after the Latin letters.
FIRST_OTHER = "\u0250"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long"


def default_tokenizer() -> tuple[str, str]:
    """Paths of the tokenizer and of the ranks of the same vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class UnitEncoder:
    """Ids of texts as little-endian bytes, four an id.

    New units are encoded many at a time from the vocabulary's ranks, one string for all, and cut apart by byte lengths.
    Units with characters beyond the Latin letters go through the tokenizer itself, so that no difference between
    versions of the Unicode tables can show.
    """

    def __init__(self, path: str, ranks_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._ranked = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self._lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self._lengths[rank] = len(piece)
        self._units: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, parts: list[str]) -> None:
        latin = [part for part in parts if part.isascii() or max(part) < FIRST_OTHER]
        if len(latin) < len(parts):
            others = list(set(parts).difference(latin))
            self._units.update(zip(others, self._encoded([" " + part for part in others])))
        if latin:
            text = " " + " ".join(latin)
            ids = np.array(self._ranked.encode_ordinary(text), "<u4")
            ends = np.cumsum(self._lengths[ids])
            last = np.cumsum([1 + len(part.encode()) for part in latin])
            cuts = [0, *(4 * (np.searchsorted(ends, last) + 1)).tolist()]
            code = ids.tobytes()
            self._units.update((part, code[i:j]) for part, i, j in zip(latin, cuts, cuts[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [text.split(" ") for text in texts]
        units = self._units
        if len(units) > KEPT_UNITS:
            units.clear()
        codes, new, whole = [], set(), set()
        for i, parts in enumerate(cut):
            codes.append(found := list(map(units.get, parts)))
            found[0] = b""
            if parts[0][-1:].isspace():
                whole.add(i)
            if None in found:
                missing = [part for part, code in zip(parts, found) if code is None]
                # A part that is empty or borders on other white space isn't a unit of its own.
                if not all(missing) or any(part[0].isspace() or part[-1].isspace() for part in missing):
                    whole.add(i)
                else:
                    new.update(missing)
        self._learn(list(new))
        heads = self._encoded([texts[i] if i in whole else cut[i][0] for i in range(len(texts))])
        get, result = units.__getitem__, []
        for i, (head, found) in enumerate(zip(heads, codes)):
            if i not in whole:
                if None in found:
                    found[1:] = map(get, cut[i][1:])
                head += b"".join(found)
            result.append(head)
        return result


_encoders: dict[tuple[str, str], UnitEncoder] = {}


def _piece_batches(paths: tuple[str, str], capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = end_id.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _encoders:
            _encoders[paths] = UnitEncoder(*paths)
        encoder = _encoders[paths]
        place = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for first in range(0, batch.num_rows, SLICE_DOCS):
                part = [t or "" for t in texts.slice(first, SLICE_DOCS).to_pylist()]
                rows: list[tuple] = []
                for doc_id, code in zip(ids[first : first + SLICE_DOCS], encoder.encode(part)):
                    code += end
                    tokens = len(code) // 4
                    for start in range(0, tokens, capacity):
                        piece = code[4 * start : 4 * (start + capacity)]
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), tokens, place))
                        place += 1
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"])

    return work


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, tokenizer: tuple[str, str] | None = None, end_id: int = END_ID) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, each document ended by ``end_id``; ``place`` numbers them."""
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_python(chosen, _piece_batches(tokenizer or default_tokenizer(), capacity, end_id), PIECES)


def _differenced(sizes: list[int], windows: int) -> list[tuple[int, object]]:
    """Windows as ``(sum, members)``, by largest differencing; members are nested pairs of item numbers."""
    heap = []
    for i, size in enumerate(sizes):  # a partial partition lists its windows that aren't empty, largest first
        heap.append((-size if windows > 1 else 0, i, [(size, i)]))
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        one, other = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = len(one) + len(other) - windows
        if both <= 0:
            merged = one + other
        else:  # the smallest of one against the largest of the other, and so on
            apart = len(one) - both
            merged = one[:apart] + other[: len(other) - both]
            low, small = one[apart:], other[len(other) - both :]
            merged += [(a[0] + b[0], (a[1], b[1])) for a, b in zip(low, reversed(small))]
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, made, merged))
        made += 1
    return heap[0][2]


def _members(nested: object) -> list[int]:
    found, left = [], [nested]
    while left:
        at = left.pop()
        if isinstance(at, tuple):
            left += at
        else:
            found.append(at)
    return sorted(found)


def near_equal_windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Item numbers by window, no window above the capacity; every size is between 1 and the capacity."""
    windows = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        found = _differenced(sizes, windows)
        if found[0][0] <= capacity:
            return [_members(nested) for _, nested in found]
        windows += max(1, int(windows * (found[0][0] / capacity - 1) / 4))


def _window_batches(capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, 1):
            table = table.sort_by("place")
            group, lengths = table.column("group")[0].as_py(), table.column("length").to_pylist()
            numbers, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for number, members in enumerate(near_equal_windows(lengths, capacity)):
                offset = 0
                for item in members:
                    numbers[item], offsets[item] = (group << 24 | number) * 2 + 1, offset
                    offset += lengths[item]
            yield pa.RecordBatch.from_arrays(
                [*(table.column(c).combine_chunks() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(numbers), pa.array(offsets)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return work


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; repeated rows are packed each for itself. Full pieces have even sequence
    ids, windows of remainders odd ones. An empty table gives no rows.
    """
    pieces = stored(pieces_of(docs, capacity, tokenizer), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = pieces.where(F.col("length") == capacity).select(
        *columns, (F.col("place") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, math.ceil(rest.count() / GROUP))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("long"))
    dealt = dealt.select("group", *columns, "place").repartition("group").sortWithinPartitions("group")
    schema = ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"])
    return full.unionByName(in_python(dealt, _window_batches(capacity), schema))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
