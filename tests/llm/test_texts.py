"""Secrets, languages, token counts and packing against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from text_cases import ODD, docs_of, documents  # noqa: F401

from scanloom.llm import counts, langid, packing, secret_scan
from scanloom.llm.text import text_slices, words_of


def test_words_are_those_of_the_pattern():
    texts = [t or "" for _, t in ODD] + ["a\x1cb c\x85d", "x" * 10]
    seen = []
    for _, _, data, offsets in text_slices(pa.array(texts), 1000):
        words = words_of(data, offsets)
        spans = [data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends)]
        seen += [spans[a:b] for a, b in zip(words.bounds, words.bounds[1:])]
    assert seen == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


def test_equal_words_have_equal_hashes():
    (_, _, data, offsets), = text_slices(pa.array(["ab abc ab", "xab ab ABC"]))
    words = words_of(data, offsets, lower=True)
    h = words.hashes()
    assert h[0] == h[2] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 3


# Secrets


def base_spans(text):
    """The fixed patterns, straight from their description."""
    word = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    assign = [m for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    access = [m for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    hexes = [m for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    spans = [(k, *m.span()) for k, ms in (("assign", assign), ("access", access), ("hex", hexes)) for m in ms]
    return sorted(spans, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


SECRETS = [
    "é password = 'abcdefgh12' x", "PassWd:short x", "toKen=" + "a" * 8, "ſecret=abcdefgh1", "toKen=abcdefgh1",
    "AKIA" + "Z9" * 6, "AKIA123", "f" * 32 + "g" + "0" * 31, "api_key:12345678 apikey\"=\"x.y/z+=-12",
    "secret", "x password=" + "0123456789abcdef" * 3,
]


def test_base_spans(spark, documents):
    docs = docs_of(spark, [(k, t) for k, t in enumerate(SECRETS)] + [(100 + k, t) for k, (_, t) in enumerate(ODD)])
    docs = docs.select("doc_id", "text").unionByName(documents.select((documents.doc_id + 1000).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = secret_scan.secret_report(docs).collect()
    assert len(rows) == len(texts)
    for row in rows:
        spans = base_spans(texts[row.doc_id])
        kinds = Counter(s[0] for s in spans)
        assert (row.n_assign, row.n_access, row.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert row.base_sha256 == hashlib.sha256(secret_scan.joined(spans).encode()).hexdigest()
        kept = [s for s in row.spans.split(",") if s and not s.startswith("random")]
        assert ",".join(kept) == secret_scan.joined(spans)


def test_random_tokens_are_found_and_words_are_not():
    rng = np.random.default_rng(3)
    draw = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    found = lambda token: any(s[0] == "random" for s in secret_scan.spans_of(f"see {token} there"))
    for name, alphabet in secret_scan.RANKS.items():
        for n in (24, 40, 80):
            tokens = [t for t in (draw(alphabet, n) for _ in range(100)) if re.search("[0-9]", t) and re.search("[A-Za-z]", t)]
            missed = sum(not secret_scan.spans_of(t) for t in tokens)
            assert missed <= 3 + len(tokens) // 20, (name, n, missed)
    for token in ("Donaudampfschiffahrtsgesellschaft", "aaaaaaaaaaaaaaaaaaaaaaaa1", "ab12" * 12, "version_1_0_0_release_notes_2_0_0"):
        assert not found(token)


def test_what_patterns_leave_of_a_token_is_tested():
    rng = np.random.default_rng(5)
    draw = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    key, texts = "AKIA" + "Z9" * 8, {}
    for _ in range(50):
        part = draw(secret_scan.RANKS["alphanumeric"], 40)
        texts[f"see {key}/{part} there"] = part
        texts[f"see {part}/token=abcdefgh there"] = part
        texts[f"see {key}/{part}/token=abcdefgh there"] = part
        part = draw(letters, 32)
        texts[f"see {part} there"] = part
    covered = 0
    for text, part in texts.items():
        spans, at = secret_scan.spans_of(text), text.index(part)
        covered += any(kind == "random" and start <= at and at + len(part) <= end for kind, start, end in spans)
        assert [s for s in spans if s[0] != "random"] == base_spans(text)
        ends = [0] + [x for s in spans for x in s[1:]]
        assert ends == sorted(ends)
    assert covered >= 0.9 * len(texts)
    assert not [s for s in secret_scan.spans_of(f"see {key}/short/token=abcdefgh there") if s[0] == "random"]


def test_masking_keeps_everything_else(spark):
    docs = docs_of(spark, [(1, "x password=abcdefgh1 y"), (2, None), (3, "clean"), (4, "")])
    masked = secret_scan.mask_secrets(docs)
    assert masked.columns == docs.columns
    assert {r.doc_id: r.text for r in masked.collect()} == {1: "x [SECRET] y", 2: None, 3: "clean", 4: ""}
    assert secret_scan.mask_secrets(docs.where("false")).count() == 0 and secret_scan.secret_report(docs.where("false")).count() == 0


# Languages


def test_held_out_accuracy(spark, documents):
    rows = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_odd_texts_and_what_is_learned(spark):
    rows = [(k, t, None) for k, t in ODD] + [(20 + k, "the end of the day", "en") for k in range(8)]
    rows += [(40 + k, "das ende der woche", "de") for k in range(8)] + [(60, "12 34 !", "en"), (61, "der woche", None)]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert all(got[k] == "und" for k in (1, 2, 3, 60)) and got[61] == "de" and got[20] == "en"
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns
    assert {1, 2, 3, 60}.isdisjoint(r.doc_id for r in kept.collect())
    assert {r.lang_pred for r in langid.identify(docs.where("lang IS NULL")).collect()} == {"und"}
    assert langid.identify(docs.where("false")).count() == 0


def test_binding_depends_on_order():
    vectors, n = langid.trigram_vectors(), langid.CODES
    abc, cba = vectors[(1 * n + 2) * n + 3], vectors[(3 * n + 2) * n + 1]
    letters = langid.letter_vectors()
    assert np.array_equal(abc, np.roll(letters[1], 2) * np.roll(letters[2], 1) * letters[3])
    assert abs(int(abc.astype(int) @ cba)) < langid.DIMENSIONS / 4


# Token counts


def best_count(word, pieces, byte_score):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[-1][0] + size * byte_score, -(best[-1][1] + size))]
        options += [(best[s][0] + pieces[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in pieces]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts_equal_a_plain_search(spark, documents):
    pieces, byte_score, _ = counts.piece_scores(counts.default_vocabulary())
    docs = documents.select("doc_id", "text").limit(40).unionByName(docs_of(spark, [r for r in ODD if r[0] != 8]).select("doc_id", "text"))
    docs = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()
    texts = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs.collect()}
    known = {w: best_count("▁" + w, pieces, byte_score) for ws in texts.values() for w in set(ws)}
    rows = counts.token_counts(docs).collect()
    assert {r.doc_id: (r.n_pretokens, r.n_tokens) for r in rows} == {
        k: (len(ws), sum(known[w] for w in ws)) for k, ws in texts.items()
    }
    assert counts.token_counts(docs.where("false")).count() == 0


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(packing.default_tokenizer()[0])
    found.encode_special_tokens = True
    return found


def test_packing_round_trip(spark, documents, tokenizer):
    docs = docs_of(spark, [(k, t) for k, t in ODD if k != 7]).select("doc_id", "text")
    docs = docs.unionByName(documents.select((documents.doc_id + 1000).alias("doc_id"), "text")).cache()
    rows = packing.packed(docs).collect()
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc_id, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc_id])
            part = np.array(ids[doc_id][at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids[doc_id])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    assert sum(map(len, ids.values())) >= 0.9 * packing.CAPACITY * len(by_sequence)
    assert packing.packed(docs.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_windows_hold_every_item_once(seed):
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in rng.integers(1, 2048, 100 * seed + 1)]
    windows = packing.near_equal_windows(sizes)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) <= packing.CAPACITY and len(windows) <= 1.2 * sum(sizes) / packing.CAPACITY + 2
