"""Token counts of texts under a unigram vocabulary, by dynamic programming shared over a trie of pre-tokens.

A pre-token is a word with a mark for the space before it. Its tokens are the segmentation into vocabulary pieces with
the highest sum of scores. Pieces score the logarithm of a Zipf share by their place in the vocabulary file, which is
never trained here; a character that no piece covers falls back to its UTF-8 bytes, each of the lowest score.

The distinct pre-tokens of a slice of texts are visited as in a depth-first walk of their trie (that is, sorted): the
forward scores of a prefix are computed once, when its node is entered, and held for all pre-tokens below it; a
pre-token's count is stored at its terminal node. A text's count is the sum over its pre-tokens. Nothing is shuffled,
and memory follows the slice.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.store import in_python
from scanloom.llm.text import text_slices, words_of

SPACE_MARK = "▁"
#: Bytes of text whose pre-tokens share a trie.
TRIE_BYTES = 4_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(2)
def piece_scores(path: str) -> tuple[dict[str, float], float, int]:
    """Scores by piece, the score of a fallback byte, and the length of the longest piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    total = math.log(sum(1 / (i + 1) for i in range(size)))
    pieces = {}
    for i in range(size):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = -math.log(i + 1) - total
    return pieces, -math.log(size + 1) - total, max(map(len, pieces), default=1)


def terminal_counts(pretokens: Sequence[str], pieces: dict[str, float], byte_score: float, longest: int) -> list[int]:
    """Token counts of sorted, distinct pre-tokens.

    At equal scores the segmentation with fewer tokens is taken.
    """
    best, tokens = [0.0], [0]  # for each prefix of the path from the root to the current node
    before, counts, find = "", [], pieces.get
    for word in pretokens:
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            fallback = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, count = best[end - 1] + fallback * byte_score, tokens[end - 1] + fallback
            for start in range(max(0, end - longest), end):
                score = find(word[start:end])
                if score is not None:
                    score += best[start]
                    if score > top or (score == top and tokens[start] + 1 < count):
                        top, count = score, tokens[start] + 1
            best.append(top)
            tokens.append(count)
        before = word
        counts.append(tokens[len(word)])
    return counts


def _count_batches(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, byte_score, longest = piece_scores(path)
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1), TRIE_BYTES):
                words = words_of(data, offsets)
                _, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
                content = data.tobytes()
                spans = zip(words.starts[at].tolist(), words.ends[at].tolist())
                texts = [SPACE_MARK + content[a:b].decode("utf-8", "replace") for a, b in spans]
                order = sorted(range(len(texts)), key=texts.__getitem__)
                counts = np.zeros(len(texts), np.int64)
                counts[order] = terminal_counts([texts[i] for i in order], pieces, byte_score, longest)
                sums = np.concatenate([[0], np.cumsum(counts[which])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(np.diff(words.bounds), pa.int64()),
                        pa.array(np.diff(sums[words.bounds]), pa.int64()),
                    ],
                    ["doc_id", "n_pretokens", "n_tokens"],
                )

    return work


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_pretokens, n_tokens; null texts and texts without words count 0."""
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_python(chosen, _count_batches(vocabulary or default_vocabulary()), "doc_id long, n_pretokens long, n_tokens long")


def op2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
