"""Mixing, quality rules, search, scoring, toxicity and the pipeline."""

import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from text_cases import ODD, SF_DIR, docs_of, documents  # noqa: F401

import corpus_pipeline
from compare import difference
from scanloom.llm import mixing, pseudo, quality, topk, toxicity
from scanloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    assert difference(QUERIES[name](spark, SF_DIR).toPandas(), connection.execute(ORACLE[name]).df()) is None


# Mixing


def test_mixture_of_odd_rows(spark):
    rows = [(k, t, None, s) for (k, t), s in zip(ODD, ["b", "a", None, "b", "", "a", "a", "c", "c", "c", "d", "e"])]
    docs = docs_of(spark, rows)
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, mixing.mixture(docs).collect())) == sorted(map(str, got))
    by_source = {r.source: r for r in mixing.source_targets(mixing.sizes_of(docs)).collect()}
    total = sum(r["size"] for r in got)
    assert sum(r.target for r in by_source.values()) == pytest.approx(total)
    assert all(r.target <= 3 * r.source_size for r in by_source.values())
    assert [by_source[s].weight for s in ("", "a", "b", "c", "d", "e", None)] == [5, 2, 1, 5, 2, 1, 5]
    assert all(r.taken <= 3 * r["size"] for r in got)
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert sum(words(r.text) for r in mix.collect()) == sum(r.taken for r in got)
    assert {(r.size, r.place, r.cut) for r in mix.collect()} == {(7, "p", "c")}
    empty = docs.where("false")
    assert mixing.mixture(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_every_source_meets_its_target(spark):
    rows = [(k, "w " * (1 + k % 13), None, f"s{k % 3}" if k % 2 else "s0") for k in range(400)]
    got = mixing.mixture(docs_of(spark, rows)).collect()
    taken, targets = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        targets[r.source_size] = r.target
    assert all(abs(taken[s] - targets[s]) < 1 for s in targets)


# Quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_and_rules(spark, documents):
    odd = docs_of(spark, ODD + [(11, "a b c d e f a b c d e\nx\nx\n \nx"), (12, "1 2 3 4 5 " * 9)]).select("doc_id", "text", "lang")
    docs = odd.where("doc_id IS NOT NULL").unionByName(documents.select((documents.doc_id + 1000).alias("doc_id"), "text", "lang"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.quality_rules(docs).collect():
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert found == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed) and (r.kept or r.base_failed or r.n_words >= quality.LEAST_WORDS)
    assert quality.quality_rules(odd.where("false")).count() == 0


def test_symbol_junk_goes_and_plain_text_stays(spark):
    plain = "the day of the end is in the house and it was as the sun on the sea, that is by the shore. "
    rows = [(k, plain * 3, "en") for k in range(20)] + [(50, "zq### kx$$$ vv%%% jj&&& " * 1 + " ".join(f"q{k}***" for k in range(90)), "en")]
    got = {r.doc_id: r for r in quality.quality_rules(docs_of(spark, [(k, t + f" {k}", lang) for k, t, lang in rows])).collect()}
    assert not got[50].kept and not got[50].base_failed
    assert got[0].class_distance < 0.2 < got[50].class_distance


# Search


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [-1.5, 0.25]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0])]
    rows += [(5, [float("inf"), 1.0]), (6, []), (7, [1.0, 2.0]), (None, [1.0, 1.0]), (8, [0.001, -0.001]), (9, [3.0]), (1, [1.0, 2.0])]
    vectors = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, run int")
    sound = [(k, [int(np.floor(256 * x)) for x in v]) for k, v in rows if k in (0, 50, 1, 6, 7, 8, 9)]
    expected = []
    for q, v in sound:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), k) for k, w in sound if k != q)[:5]
            expected += [(q, i, k, -s) for i, (s, k) in enumerate(scores, 1)]
    assert sorted(tuple(r) for r in topk.top_k(vectors).collect()) == sorted(expected)
    assert topk.top_k(vectors.where("false")).count() == 0


def test_pruning_changes_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    terms = rng.integers(-40, 40, (2000, 8)) + np.repeat(rng.integers(-60, 60, (20, 8)), 100, axis=0)
    ids, queries = np.arange(2000), rng.integers(-50, 50, (30, 8))
    got = list(topk._best(queries, np.arange(5000, 5030), ids, terms, 5))
    scores = queries @ terms.T
    expected = [(5000 + q, int(k), int(scores[q, k])) for q in range(30) for k in np.lexsort((ids, -scores[q]))[:5]]
    assert got == expected


# Scoring and toxicity


def test_scores_of_odd_rows_and_of_order(spark, documents):
    docs = docs_of(spark, ODD).select("doc_id", "text").unionByName(documents.select((documents.doc_id + 1000).alias("doc_id"), "text"))
    first, again = (pseudo.pseudo_likelihood(docs).collect() for _ in range(2))
    assert sorted(map(str, first)) == sorted(map(str, again))
    got = {r.doc_id: r for r in first}
    assert (got[1].n_words, got[1].log_likelihood, got[1].mean_log_likelihood) == (0, 0.0, None)
    assert all(r.log_likelihood < 0 for r in first if r.n_words) and got[5].log_likelihood == got[6].log_likelihood
    assert pseudo.pseudo_likelihood(docs.where("false")).count() == 0


def test_network_gradients():
    rng = np.random.default_rng(1)
    params = {k: v.astype(np.float64) for k, v in pseudo.new_params().items()}
    context, target = rng.integers(0, pseudo.CLASSES + 1, (4, 50)), rng.integers(0, pseudo.CLASSES, 50)
    grads = pseudo.gradients(params, context, target)

    def loss():
        logits = pseudo._logits(params, pseudo._hidden(params, context))
        return -np.mean(logits[np.arange(50), target] - np.log(np.exp(logits).sum(1)))

    for name, values in params.items():
        flat, at = values.reshape(-1), int(np.abs(grads[name]).argmax())
        kept = flat[at]
        flat[at] = kept + 1e-4
        up = loss()
        flat[at] = kept - 1e-4
        down = loss()
        flat[at] = kept
        assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-4, rel=1e-3)


def test_every_word_is_hidden_once(monkeypatch):
    """Over the rounds each word of each text is a target exactly once, in copies with an even number of words, too."""
    texts = ["one two three four"] * 5 + ["", "alone", "a b c"]
    places, contexts = Counter(), pseudo.contexts
    monkeypatch.setattr(pseudo, "contexts", lambda own, bounds, at: places.update(at.tolist()) or contexts(own, bounds, at))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    classes, _ = pseudo.classes_of(np.ones(pseudo.BUCKETS, np.int64))
    for turn in range(pseudo.ROUNDS):
        assert len(list(pseudo._learn_batches(pseudo.flat(pseudo.new_params()), classes, turn)(iter([batch])))) == 1
    assert places == Counter(range(24))


def test_rare_words_are_told_apart(spark):
    """A word that follows its partner is likelier than one of the same class and count; held-out texts beat the counts."""
    pairs = [(f"left{k}", f"right{k}") for k in range(400)]

    def texts(seed, times):
        order = np.random.default_rng(seed).permutation(np.tile(np.arange(len(pairs)), times)).reshape(-1, 20)
        return [" ".join(w for k in row for w in pairs[k]) for row in order.tolist()]

    docs = spark.createDataFrame([(t,) for t in texts(1, 200)], "text string").coalesce(1)
    counts = pseudo.bucket_counts(docs)
    classes, trees = pseudo.classes_of(counts)
    score = pseudo._score_batches(*pseudo.learn(docs, classes, trees), classes, trees)

    def scores(given):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(given))), pa.array(given)], ["doc_id", "text"])
        return [r for b in score(iter([batch])) for r in b.to_pylist()]

    held = scores(texts(2, 10))
    mean = sum(r["log_likelihood"] for r in held) / sum(r["n_words"] for r in held)
    assert mean > np.log(1 / 800) + 0.5
    place = {w: int(trees.ranks[next(pseudo._slices(pa.array([w])))[2][0]]) for _, w in pairs}
    rare = [p for p in pairs if place[p[1]] >= pseudo.OWN]
    swaps = [(a, b, c) for i, (a, b) in enumerate(rare) for _, c in rare[i + 1 :] if classes[place[b]] == classes[place[c]]]
    right, wrong = (scores([f"{a} {w[k]}" for a, *w in swaps]) for k in (0, 1))
    better = [x["log_likelihood"] > y["log_likelihood"] for x, y in zip(right, wrong)]
    assert len(swaps) > 100 and np.mean(better) > 0.9


def test_runs_are_summed_whole():
    """Runs shorter and longer than those added up at once, against sums one by one."""
    rng = np.random.default_rng(4)
    keys = np.concatenate([np.full(300, 7), np.repeat(np.arange(20, 40), np.arange(1, 21)), rng.integers(100, 900, 500)])
    keys, values = rng.permutation(keys), rng.standard_normal((len(keys), 10)).astype(np.float32)
    plain = np.zeros((900, 10))
    np.add.at(plain, keys, values)
    order, first, found = pseudo._runs(keys)
    assert found.tolist() == np.unique(keys).tolist()
    for sums in (pseudo._short_run_sums, pseudo._run_sums):
        assert sums(values, order, first) == pytest.approx(plain[found], abs=1e-4)


def test_a_step_takes_each_row_once():
    """Of words and nodes that a step needs many times one row is taken, changed by the sum of all gradients and put back."""
    rng = np.random.default_rng(5)
    counts = np.zeros(pseudo.BUCKETS, np.int64)
    counts[:3000] = rng.integers(1, 50, 3000)
    classes, trees = pseudo.classes_of(counts)
    given = (rng.standard_normal((pseudo.ROWS, pseudo.WIDTH + 1)) / 4).astype(np.float32)
    given[: pseudo.NODES, -1] = 0
    words = pseudo._Words(given, trees)
    around, targets = trees.ranks[rng.integers(0, 3000, (4, 200))], trees.ranks[rng.integers(0, 3000, 200) // 7]
    node, side, count = trees.ways(targets)
    rows, places, ways = words.gather(around, targets)
    keys = np.concatenate([around.reshape(-1), pseudo.NODES + node])
    assert len(rows) == len(np.unique(keys)) < len(keys)
    assert (rows[places][..., :-1] == given[around]).all()

    hidden, own = np.tanh(rng.standard_normal((2, 200, pseudo.WIDTH))).astype(np.float32)
    back, _, nodes = pseudo.within_gradients(rows, trees, hidden, targets, ways)
    words.step(own, nodes)
    word = np.repeat(np.arange(200), count)
    inputs = np.concatenate([hidden, np.ones((200, 1))], axis=1)[word]
    vectors = given[pseudo.NODES + node].astype(float)
    slope = (-side / (1 + np.exp(side * ((inputs * vectors).sum(axis=1) + trees.base[node]))))[:, None]
    expected = np.zeros((200, pseudo.WIDTH))
    np.add.at(expected, word, slope * vectors[:, :-1])
    assert back == pytest.approx(expected, abs=1e-4)
    sums = np.zeros(given.shape)
    np.add.at(sums[:, :-1], around.reshape(-1), np.tile(own, (4, 1)))
    np.add.at(sums, pseudo.NODES + node, slope * inputs)
    squares = (sums**2).sum(axis=1) / pseudo.WIDTH
    plain = given - pseudo.WORD_RATE * sums / np.sqrt(1 + squares)[:, None]
    assert np.allclose(words.state[:, :-1], plain, atol=1e-4) and np.allclose(words.state[:, -1], squares, rtol=1e-3)
    words.see(around, targets)
    assert (words.seen() == np.bincount(keys, minlength=pseudo.ROWS)).all()


def test_gradients_within_classes():
    rng = np.random.default_rng(3)
    counts = np.zeros(pseudo.BUCKETS, np.int64)
    counts[:3000] = rng.integers(1, 50, 3000)
    _, trees = pseudo.classes_of(counts)
    rows = pseudo.new_rows().astype(np.float64)
    # Without vectors a word has its share of its class's count.
    classes = pseudo.classes_of(counts)[0]
    words, at = np.arange(3000), trees.ranks[:3000]
    odds, *_, count = pseudo._odds(rows, trees, np.zeros((3000, pseudo.WIDTH)), at)
    ends = np.cumsum(count)
    turns = np.concatenate([[0], np.cumsum(-np.logaddexp(0, -odds))])
    share = counts[words] / np.bincount(classes[at], counts[:3000])[classes[at]]
    assert turns[ends] - turns[ends - count] == pytest.approx(np.log(share), abs=1e-3)
    rows[pseudo.NODES :] = rng.standard_normal(rows[pseudo.NODES :].shape)
    hidden, target = rng.standard_normal((40, pseudo.WIDTH)), at[rng.integers(0, 3000, 40)]
    back, node, nodes = pseudo.within_gradients(rows, trees, hidden, target)
    loss = lambda: np.logaddexp(0, -pseudo._odds(rows, trees, hidden, target)[0]).sum()
    summed = np.zeros_like(rows)
    np.add.at(summed, pseudo.NODES + node, nodes)
    for values, grads in ((hidden, back), (rows, summed)):
        flat, i = values.reshape(-1), int(np.abs(grads).argmax())
        kept, sides = flat[i], []
        for change in (1e-2, -1e-2):
            flat[i] = kept + change
            sides.append(loss())
        flat[i] = kept
        assert grads.reshape(-1)[i] == pytest.approx((sides[0] - sides[1]) / 2e-2, rel=1e-2)


def test_windows_cover_every_word():
    starts, lengths, first = toxicity.windows_of(np.array([0, 0, 1, 33, 200]))
    covered = {k for s, n in zip(starts, lengths) for k in range(s, s + n)}
    assert covered == set(range(200)) and list(np.diff(first)) == [0, 1, 1, 10] and lengths.max() == toxicity.WINDOW


def test_toxicity_learns_words_and_prefixes(spark):
    rng = np.random.default_rng(2)
    plain = lambda: [f"{a}{b}" for a, b in zip(rng.choice(["on", "er", "th", "in"], 60), rng.choice(["ed", "ly", "es"], 60))]
    rows, labels = [], []
    for k in range(400):
        words, bad = plain(), k % 3 == 0
        if bad:
            words[int(rng.integers(60))] = "clown" if k % 2 else f"badpre{rng.integers(10**6)}"
            words[int(rng.integers(60))] = "idiot"
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad), "x"))
    docs = docs_of(spark, rows + [(1000 + k, t) for k, (_, t) in enumerate(ODD)])
    table = spark.createDataFrame([*labels, (None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, order string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, table).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [(got[k].predicted, bad) for k, bad, _ in labels if got[k].held_out]
    assert sum(p == b for p, b in held) >= 0.9 * len(held)
    assert all(got[1000 + k].score == 0 for k in (1, 2, 3)) and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.toxicity(docs.where("false"), table).count() == 0


# Pipeline


def test_pipeline_on_odd_rows(spark):
    rows = [(k, t, "en", f"s{k or 0}") for k, t in ODD]
    docs = docs_of(spark, rows + [(50 + k, "the day is over and out at last", "en", "s") for k in range(9)])
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.where("false")):
            result = stage(spark, given, SF_DIR)
            if name != "packing":
                assert result.columns == docs.columns
            if given is not docs:
                assert result.count() == 0
    assert {"sequence_id", "offset"} <= set(result.columns)


def test_pipeline_keeps_what_it_should(spark, documents):
    docs = documents
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF_DIR).cache()
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    letters = {r.doc_id for r in documents.collect() if any(c.isalpha() for c in r.text or "")}
    assert kept["language"].keys() == letters
    assert kept["near_duplicates"].keys() == kept["secrets"].keys() < letters
    assert not any("password=" in t for t in kept["secrets"].values())
    assert kept["mixing"].keys() <= kept["secrets"].keys()
