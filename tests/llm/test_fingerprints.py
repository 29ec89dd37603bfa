"""Fingerprints against a plain Python version of the sketch, the order and the edit."""

import hashlib
import re

import xxhash
from text_cases import ODD, docs_of

from scanloom.llm import fingerprints as fp


def spark_hash(*strings):
    """Spark's xxhash64 of string columns: seed 42, each column's hash the seed of the next."""
    seed = 42
    for s in strings:
        seed = xxhash.xxh64_intdigest(s.encode(), seed)
    return seed  # unsigned


def plain_sketch(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return []
    hashes = [spark_hash(" ".join(words))] if len(words) < 5 else [spark_hash(*words[i : i + 5]) for i in range(len(words) - 4)]
    kept = sorted({h for h in hashes if h >> 61 == 0})
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    return kept or [min(signed) % (1 << 64)]


def plain_like(a, b):
    sa, sb = {h for h in a if h >> 61 == 0}, {h for h in b if h >> 61 == 0}
    return (1.0 if a == b else 0.0) if not sa | sb else len(sa & sb) / len(sa | sb)


def plain(rows):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(((k is None, k or 0, signed(spark_hash(t or "")), (t or "").encode(), t or ""), k) for k, t in rows)
    out = []
    for i, ((*_, text), k) in enumerate(order):
        following = order[(i + 1) % len(order)][0][-1]
        n = len(text)
        edited = text[: n - n // 4] + following[: n // 4]
        a, e, nx = plain_sketch(text), plain_sketch(edited), plain_sketch(following)
        as_text = lambda s: ",".join(f"{h:016x}" for h in s)
        out.append((k, n, hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(e), plain_like(a, e), plain_like(a, nx)))
    return sorted(out, key=repr)


def test_fingerprints_equal_plain_version(spark):
    rows = ODD + [(20 + k, " ".join(f"w{(k * j) % 31}" for j in range(3 + 9 * k))) for k in range(40)] + [(3, "tie b"), (3, "tie a")]
    got = fp.fingerprints(docs_of(spark, rows)).collect()
    found = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got), key=repr)
    assert found == plain(rows)
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[5] == same[6] and same[5] != ""
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_one_row_and_empty_table(spark):
    one = fp.fingerprints(docs_of(spark, [(1, "a b c d e f g h")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0  # the next of the only text is itself
    assert fp.fingerprints(docs_of(spark, [(1, "x")]).where("false")).count() == 0
