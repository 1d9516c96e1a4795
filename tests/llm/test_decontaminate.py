import random
import re

import numpy as np
import pytest

from cloakframe.llm import decontaminate as d
from cloakframe.llm.queries import QUERIES

RULES = d.AlignmentRules()


def slow_score(item, text):
    """Smith-Waterman cell by cell over the whole texts."""
    a, b = d.tokens(item), d.tokens(text)
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, *row)
    return best / (2 * len(a))


WORDS = [f"w{i}x" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def corpus():
    rng = random.Random(5)
    items = [(i, prose(rng, 30)) for i in range(8)] + [(8, "too short"), (9, None), (10, ""), (11, prose(rng, 150))]
    items.append((12, items[0][1]))
    docs = [(i, prose(rng, 80)) for i in range(40)]
    for i in range(8):
        docs.append((100 + i, f"{prose(rng, 50)} {items[i][1].upper()}! {prose(rng, 50)}"))
        docs.append((200 + i, f"{prose(rng, 50)}\n{edited(rng, items[i][1], 0.15)}"))
    docs += [(300 + i, items[3][1]) for i in range(60)]
    docs += [(400, None), (401, ""), (None, items[1][1]), (402, items[2][1]), (402, items[2][1]), (403, "same " * 20_000)]
    return items, docs


@pytest.mark.parametrize("limit", [500_000, 0])
def test_against_all_pairs(spark, limit):
    items, docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = d.contaminated(frame, bench, rules=d.AlignmentRules(broadcast_words=limit)).collect()
    got = {(r.doc, r.item): r.score for r in rows}
    assert len(got) == len(rows)
    want = {}
    for i, t in docs:
        for j, q in items:
            if j == 8 and t and "too short" in t:
                want[i, j] = 1.0
            if q and 8 <= len(q.split()) <= 64 and t and len(t) < 5000 and (s := slow_score(q, t)) >= 0.5:
                want[i, j] = s
    assert {k for k in got if k[1] != 11} == set(want)
    for k, s in want.items():
        assert abs(got[k] - s) < 1e-9


@pytest.mark.parametrize("limit", [500_000, 0])
def test_many_copies_of_an_edited_item(spark, limit):
    """Every fifth word is changed, so few seeds are left; other documents hold some of the other seeds by chance."""
    rng = random.Random(11)
    items = [(i, prose(rng, 30)) for i in range(4)]
    docs = [(i, prose(rng, 40)) for i in range(200)]
    want = {}
    for i, copies in ((0, 3), (1, 12), (2, 2000)):
        ws = items[i][1].split()
        copy = " ".join("changed" if k % 5 == 4 else w for k, w in enumerate(ws))
        assert (score := slow_score(items[i][1], copy)) >= 0.5
        want |= {(10_000 * (i + 1) + k, i): score for k in range(copies)}
        docs += [(10_000 * (i + 1) + k, f"{prose(rng, 5)} {copy} {prose(rng, 5)}") for k in range(copies)]
        docs += [(9000 + 100 * i + k, f"{prose(rng, 5)} {' '.join(ws[k : k + 4])} {prose(rng, 5)}") for k in range(1, 27) if k % 5]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc, r.item): r.score for r in d.contaminated(frame, bench, rules=d.AlignmentRules(broadcast_words=limit)).collect()}
    assert set(got) == set(want)
    assert all(got[k] >= s - 1e-9 for k, s in want.items())


@pytest.mark.parametrize("limit", [500_000, 0])
def test_short_items_match_verbatim(spark, limit):
    bench = spark.createDataFrame([(1, "Five words are in this"), (2, "yes"), (3, "one two three four"), (4, "yes"), (5, "")], "item_id string, text string")
    rows = [(1, "so five WORDS are, in this text"), (2, "five words were in this"), (3, "Yes!"), (4, "yes and no"), (5, "one two three"), (6, "x one two three four five words are in this"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc, r.item, r.score, r.end_word) for r in d.contaminated(docs, bench, rules=d.AlignmentRules(broadcast_words=limit)).collect()}
    assert got == {(1, "1", 1.0, 6), (3, "2", 1.0, 1), (3, "4", 1.0, 1), (6, "3", 1.0, 5), (6, "1", 1.0, 10)}


def test_long_item_by_segment(spark):
    items, docs = corpus()
    long = items[11][1]
    part = " ".join(long.split()[70:140])
    frame = spark.createDataFrame([(1, part), (2, "nothing here")], "doc_id long, text string")
    rows = d.contaminated(frame, spark.createDataFrame([(11, long)], "item_id long, text string")).collect()
    assert [(r.doc, r.item) for r in rows] == [(1, 11)]


def test_empty_and_clashes(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs, none).count() == 0
    assert d.drop_contaminated(docs, none).collect() == docs.collect()
    assert d.contaminated(docs.limit(0), spark.createDataFrame([(1, "q " * 20)], "item_id long, text string")).count() == 0


def test_alignment_batches():
    rng = np.random.default_rng(0)
    segs, bodies = rng.integers(0, 6, (20, 12)).astype(np.int32), rng.integers(0, 6, (20, 40)).astype(np.int32)
    best, _ = d.smith_waterman(segs, bodies, RULES)
    for s, b, got in zip(segs, bodies, best, strict=True):
        assert got == round(24 * slow_score(" ".join(map(str, s)), " ".join(map(str, b))))


def test_query_finds_verbatim_passages(spark, sf_dir):
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for i, q in items if q in norm(r.text)}
    got = {(r.doc_id, r.item_id): r.score for r in QUERIES["op1_decontaminate"](spark, sf_dir).collect()}
    assert want and want <= set(got)
    assert {k for k, s in got.items() if s == 1.0} == want
