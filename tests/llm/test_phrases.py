"""Phrase collocations against a plain Python version."""

import re
from collections import Counter

from text_cases import ODD, docs_of

from scanloom.llm.phrases import collocations, likely_pairs, stripe_cells


def plain(rows, most=2000):
    out = {}
    by_lang = {}
    for _, text, lang, _ in rows:
        text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        f = by_lang.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for size in (1, 2, 3):
                f.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, f in by_lang.items():
        n = sum(c for k, c in f.items() if len(k) == 1)
        cands = {k: c for k, c in f.items() if len(k) > 1 and c >= 10}
        rows_ = []
        for k, a in cands.items():
            if any(len(o) > len(k) and any(o[i : i + len(k)] == k for i in range(len(o) - len(k) + 1)) and 100 * c >= 50 * a for o, c in cands.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[k[:j]] * f[k[j:]]), j, f[k[:j]], f[k[j:]]) for j in range(1, len(k)))
            rows_.append((-score, -a, " ".join(k).encode(), " ".join(k), a, l, r, score))
        for rank, row in enumerate(sorted(rows_)[:most], 1):
            out[lang, row[3]] = (rank, row[4], row[5], row[6], n, row[7])
    return out


def test_collocations_equal_plain_version(spark):
    rows = [(k, f"New York city. New York! big apple; Ab cd ef ab cd\tef x{k % 3} y\nNEW york", ["en", None][k % 2], "s") for k in range(24)]
    rows += [(k, "the cat sat. the cat ran. a dog", "de", None) for k in range(30)] + [(k, t, "en", None) for k, t in ODD]
    rows += [(1, "ties tie. ties tie. " * 6 + "tie ties. " * 6, "fr", None)] * 2
    got = {(r.lang, r.phrase): (r.rank, r.a, r.l, r.r, r.n, r.score) for r in collocations(docs_of(spark, rows)).collect()}
    assert got == plain(rows)
    assert ("en", "ab cd ef") in got and ("en", "ab cd") not in got  # held by the longer phrase


def test_stripes_add_up_and_empty_input(spark):
    docs = docs_of(spark, [(1, "a b a b. a", "en"), (1, "a b a b. a", "en")])
    cells = {(r.w1, r.w2, r.w3): r.c for r in stripe_cells(docs).collect()}
    assert cells == {("a", "b", "a"): 2, ("b", "a", "b"): 2, ("a", "b", None): 2, ("b", None, None): 2, ("a", None, None): 2}
    assert collocations(docs.where("false")).count() == 0


def test_only_stripes_that_can_hold_a_candidate_are_made(spark):
    rows = [(k, f"big red dog. {' '.join(f'u{k}x{j}' for j in range(200))} big red", "en", "s") for k in range(20)]
    rows += [(k, "big red dog", None, "s") for k in range(9)] + [(None, None, "en", None), (1, "...", "en", "s")]
    docs = docs_of(spark, rows)
    cells = {(r.lang, r.w1, r.w2, r.w3): r.c for r in stripe_cells(docs, likely_pairs(docs)).collect()}
    assert cells == {("en", "big", "red", "dog"): 20, ("en", "big", "red", None): 20, ("en", "red", "dog", None): 20}
    assert stripe_cells(docs).count() > 4000
    got = {(r.lang, r.phrase): (r.rank, r.a, r.l, r.r, r.n, r.score) for r in collocations(docs).collect()}
    assert got == plain(rows)


def test_pairs_beyond_the_marks_of_others_change_nothing(spark, monkeypatch):
    from scanloom.llm import marks

    monkeypatch.setattr(marks, "BITS", marks.ROW_BITS + 6)  # one row of marks, full of common bits
    rows = [(k, " ".join(f"w{(k * j * j + j) % 41}" for j in range(300)) + " Q? r", ["en", "de"][k % 2], "s") for k in range(30)]
    got = {(r.lang, r.phrase): (r.rank, r.a, r.l, r.r, r.n, r.score) for r in collocations(docs_of(spark, rows)).collect()}
    assert got == plain(rows)
