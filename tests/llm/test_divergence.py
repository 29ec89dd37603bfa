"""Source divergence audit against a plain Python version."""

import re
from collections import Counter

from text_cases import ODD, docs_of

from scanloom.llm.divergence import BREAK, _terms, audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows):
    """The contract, term by term over all kept terms: (lang, source, part, item) -> (value, rank)."""
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))) for _, text, lang, source in rows]
    out = {}
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= 10)
        V = len(kept)
        counts = {}
        for _, source, terms in mine:
            counts.setdefault(source, Counter()).update(terms)
        def ppb(c):
            N = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (N + 2 * V) for t in kept}
        p = {s: ppb(c) for s, c in counts.items()}
        q = ppb(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s), key=lambda x: (x[0], x[1].encode()))
            for rank, (value, o) in enumerate(pair, 1):
                out[lang, s, "pair", o] = (-value, rank)
            terms = sorted(((-f(p[s][t], q[t]), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))
            for rank, (value, t) in enumerate(terms[:10], 1):
                out[lang, s, "term", t] = (-value, rank)
    return out


def test_audit_equals_plain_version(spark):
    rows = [(k, " ".join(f"W{(k * j) % 17} mot{j % 5}" for j in range(k % 23)) + " ÉTÉ été", ["en", "de", None][k % 3], ["a", "b", None, "", "c"][k % 5]) for k in range(150)]
    rows += [(None, "x1y2z", "en", "solo"), (3, None, "fr", "only"), (4, "12 34", "fr", "other"), *[(k, t, "en", "a") for k, t in ODD]]
    got = {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in audit(docs_of(spark, rows)).collect()}
    assert got == plain(rows)
    assert all(v[1] <= 10 for k, v in got.items() if k[2] == "term")
    assert {k[1] for k in got if k[0] == "fr"} == {"only", "other"}  # no kept term there: pairs of value 0
    assert {v[0] for k, v in got.items() if k[0] == "fr"} == {0}


def test_repeated_rows_count_twice_and_empty_input(spark):
    rows = [(1, "alpha beta " * 3, "en", "s"), (1, "alpha beta " * 3, "en", "s")] * 6 + [(2, "beta gamma", "en", "t")] * 10
    got = audit(docs_of(spark, rows))
    assert {(r.source, r.part, r.item): r.value for r in got.collect()} == {
        (k[1], k[2], k[3]): v[0] for k, v in plain(rows).items()
    }
    assert audit(docs_of(spark, rows).where("false")).count() == 0


def test_breaks_are_listed_and_leave_the_terms(spark):
    assert "-" not in BREAK  # ranges are tried one after the other, listed characters looked up
    assert all(bool(re.fullmatch(BREAK, chr(c))) != bool(TERM.fullmatch(chr(c))) for c in range(0x300))
    texts = ["", " ", "1a2", "ab-cd_EF", "été, \U0001f600x\x7f\x80y", *map(chr, range(0x100))]
    got = _terms(docs_of(spark, [(k, t) for k, t in enumerate(texts)])).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert [[t for t in r.terms if t] for r in got] == [TERM.findall(t.translate(lower)) for t in texts]
