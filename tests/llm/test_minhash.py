import random
import re
from collections import Counter

from text_cases import ODD, docs_of, documents  # noqa: F401

from scanloom.llm.components import components
from scanloom.llm.minhash import near_duplicates, without_near_duplicates


def shingles(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(texts):
    """{id: (set size, smallest linked id)} from all pairs that share a shingle."""
    sets, holders = {k: shingles(t) for k, t in texts.items()}, {}
    for k, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(k)
    above = {k: k for k in texts}

    def root(k):
        while above[k] != k:
            k = above[k]
        return k

    for k, own in sets.items():
        for j, shared in Counter(j for s in own for j in holders[s] if j < k).items():
            if 100 * shared >= 75 * (len(own) + len(sets[j]) - shared):
                a, b = sorted((root(k), root(j)))
                above[b] = a
    return {k: (len(sets[k]), root(k)) for k in texts}


def found(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_equals_brute_force(spark, documents):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    result = near_duplicates(documents)
    assert found(result) == brute(texts)
    assert result.where("kept <> (doc_id = component_id)").count() == 0


def test_a_large_group_of_copies_of_different_closeness(spark):
    """Copies with up to half of their words changed: some linked, some only near, all in the same lists."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for k in range(500):
        words = [w if draw.random() > k / 2500 else f"x{draw.randrange(10**6)}" for w in base]
        texts[k] = " ".join(words)
    expected = brute(texts)
    assert 20 < Counter(c for _, c in expected.values()).most_common(1)[0][1] < 480
    assert found(near_duplicates(docs_of(spark, texts.items()))) == expected


def test_odd_rows(spark):
    docs = docs_of(spark, ODD)
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(ODD)
    (nameless,) = [r for r in rows if r.doc_id is None]
    assert (nameless.component_id, nameless.kept) == (None, True)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[9] == (1, 9, True)
    assert got[6] == (3, 5, False) and got[7] == (1, 7, True)
    left = without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_empty(spark):
    docs = docs_of(spark, ODD).where("false")
    assert near_duplicates(docs).collect() == [] and without_near_duplicates(docs).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(k, 3) for k in range(4, 60)] + [(9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 3 for k in range(3, 60)}}
