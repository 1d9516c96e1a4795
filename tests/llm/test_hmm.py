import itertools
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import hmm
from cloakframe.llm.queries import QUERIES


def toy(seed=0, states=3, symbols=5):
    rng = np.random.default_rng(seed)
    return hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T)


def paths(row, model):
    """Every state path of a sequence, with its probability."""
    for path in itertools.product(range(len(model.start)), repeat=len(row)):
        p = model.start[path[0]] * model.emit[row[0], path[0]]
        for t in range(1, len(row)):
            p *= model.move[path[t - 1], path[t]] * model.emit[row[t], path[t]]
        yield path, p


def test_forward_and_counts_against_all_paths():
    model, rng = toy(), np.random.default_rng(1)
    rows = [rng.integers(0, 5, n) for n in (1, 4, 2, 6, 6, 3)]
    got = np.zeros(len(rows))
    for part, steps, alive in hmm.packs(rows, 12):
        got[part] = hmm.forward(steps, alive, model)[0]
    counts = hmm.Counts(5, 3)
    counts.add(rows, model, 12)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for i, row in enumerate(rows):
        every = list(paths(row, model))
        total = sum(p for _, p in every)
        assert math.isclose(got[i], math.log(total), rel_tol=1e-9)
        for path, p in every:
            start[path[0]] += p / total
            for t, s in enumerate(path):
                emit[row[t], s] += p / total
                if t:
                    move[path[t - 1], s] += p / total
    assert np.allclose(counts.start, start) and np.allclose(counts.move, move) and np.allclose(counts.emit, emit)


def test_packs_hold_symbols_without_padding():
    """One long text takes no room from the short ones, so steps, and the time of a step, are shared by all."""
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 5, n) for n in (1000, *[3] * 300, 40)]
    packs = list(hmm.packs(rows, 2000))
    assert [len(part) for part, *_ in packs] == [302]
    (part, steps, alive), sizes = packs[0], [len(r) for r in rows]
    assert steps.size == sum(sizes) and len(alive) == 1000
    begins = np.cumsum(alive) - alive
    assert all((steps[begins[: sizes[i]] + b] == rows[i]).all() for b, i in enumerate(part))


def test_long_texts_of_unlikely_words_neither_vanish_nor_overflow():
    """Sums scaled in every few steps are those of a recursion that is scaled in each."""
    model, rng = toy(6), np.random.default_rng(7)
    model.emit *= 1e-14
    model.move = np.where(np.eye(3) > 0, 1 - 2e-11, 1e-11)
    row = rng.integers(0, 5, 3001)
    total, a = 0.0, None
    for s in row:
        a = (model.start if a is None else a @ model.move) * model.emit[s]
        total += math.log(a.sum())
        a = a / a.sum()
    (_, steps, alive), = hmm.packs([row], 10)
    assert math.isclose(hmm.forward(steps, alive, model)[0][0], total, rel_tol=1e-12)
    counts = hmm.Counts(5, 3)
    counts.add([row], model, 10)
    assert math.isclose(counts.emit.sum(), 3001, rel_tol=1e-9) and math.isclose(counts.move.sum(), 3000, rel_tol=1e-9)


def test_places_of_words_met_together():
    hashes = hmm.word_hashes([b"c", b"a", b"b"])
    places = hmm.Places(hashes)
    for ws, want, apart in (([b"x", b"a", b"y", b"x", b"c"], [-1, 1, -2, -1, 0], [b"x", b"y"]), ([b"b", b"y", b"a"], [2, -1, 1], [b"y"]), ([], [], [])):
        at, h = places.of(ws)
        assert at.tolist() == want and h.tolist() == hmm.word_hashes(apart).tolist()
    assert set(places) == {b"a", b"b", b"c"}


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(2)
    rows = [np.r_[rng.integers(0, 3, 30) + 3 * (i % 2), 7] for i in range(40)]
    model, shares = toy(3, 2, 8), np.ones(8) / 8
    rules = hmm.HmmRules(states=2, prior=0.001)
    last = -np.inf
    for _ in range(8):
        now = sum(hmm.forward(s, a, model)[0].sum() for _, s, a in hmm.packs(rows, 500))
        assert now > last - 1.0  # the prior moves it a little
        last = now
        counts = hmm.Counts(8, 2)
        counts.add(rows, model, 500)
        model = counts.model(shares, rules)


def words(text):
    return (text or "").encode().lower().split()


def base(rows, learn):
    train = Counter()
    for i, t in rows:
        if learn(i):
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    return {i: (len(words(t)) + 1, sum(train[w] > 0 for w in [*words(t), None]), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in [*words(t), None])) for i, t in rows}


@pytest.mark.parametrize("own,chunk", [(1 << 16, 500_000), (3, 10), (0, 3)])
def test_small_tables(spark, own, chunk):
    rows = [(1, "the cat The dog"), (2, None), (3, ""), (4, "the unseen cat"), (5, "w " * 20_000), (6, "a b c d e f g h the the dog")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    rules = hmm.HmmRules(states=2, own_words=own, own_count=1, chunk_tokens=chunk, corpus_rounds=1)
    out = hmm.score(docs, hmm.learn(docs.where("doc_id <> 4"), rules=rules), rules=rules).collect()
    want = base(rows, lambda i: i != 4)
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9)
        assert r.score < 0
    assert hmm.score(docs.limit(0), hmm.learn(docs, rules=rules), rules=rules).count() == 0
    nothing = hmm.score(docs, hmm.learn(docs.limit(0), rules=rules), rules=rules).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in nothing)


def test_words_of_a_length_sum_to_one(spark):
    """One-word texts over the whole vocabulary and one unknown word have probabilities that sum with the others to 1."""
    docs = spark.createDataFrame([(1, "a a a b b c"), (2, "a d")], "doc_id long, text string")
    rules = hmm.HmmRules(states=2, own_words=2, own_count=1, corpus_rounds=1)
    learned = hmm.learn(docs, rules=rules)
    model, vocabulary, _ = learned
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "c", "d", "unknown"])], "doc_id long, text string")
    got = sum(10**r.score for r in hmm.score(texts, learned, rules=rules).collect())
    rare = vocabulary.rare
    one = model.start * (1 - model.emit[rare + 1])  # any word first
    assert math.isclose(got, float(one @ model.move @ model.emit[rare + 1]), rel_tol=1e-6)  # emissions of words apart have 32 bits


def test_query_beats_the_base_on_held_out_texts(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    learn = lambda i: crc32(str(i).encode()) % 7 != 2
    want = base(rows, learn)
    got = {r.doc_id: r for r in QUERIES["op6_hmm_score"](spark, sf_dir).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learn(i), *want[i][:3])
        assert math.isclose(r.base_score, want[i][3], rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_joined_emissions_are_those_of_the_broadcast_table(spark):
    """All words of own_count tokens learn state emissions, however few of them are broadcast."""
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(f"{'ab'[i % 2]}{rng.integers(0, 30)}" for _ in range(40)) + f" once{i}") for i in range(60)]
    docs = spark.createDataFrame([*texts, (99, None)], "doc_id long, text string").repartition(3)
    scores = []
    for own in (1000, 40, 20):
        rules = hmm.HmmRules(states=2, own_words=own, prior=1.0)
        rows = hmm.score(docs, hmm.learn(docs, rules=rules), rules=rules).collect()
        scores.append({r.doc_id: (r.n_known, r.base_score, r.score) for r in rows})
    for other in scores[1:]:
        assert other.keys() == scores[0].keys()
        for i, r in other.items():
            # Words apart are tied until the last round, so the rounds may settle a little apart.
            assert r[0] == scores[0][i][0] and math.isclose(r[1], scores[0][i][1], rel_tol=1e-9)
            assert r[2] > r[1] and math.isclose(r[2], scores[0][i][2], rel_tol=0.05) or i == 99


def test_copies_stay_within_the_sample(spark, monkeypatch):
    texts = spark.createDataFrame([(f"text number {i} of some",) for i in range(200)], "text string")
    copied = texts.orderBy(F.xxhash64("text")).first().text
    docs = texts.union(spark.createDataFrame([(copied,)] * 100, "text string"))
    met, first_model = [], hmm.first_model
    monkeypatch.setattr(hmm, "first_model", lambda rows, *rest: met.append(len(rows)) or first_model(rows, *rest))
    hmm.learn(docs, rules=hmm.HmmRules(states=2, sample=20, corpus_rounds=1))
    assert met == [20]
