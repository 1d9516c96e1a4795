from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from cloakframe.llm import langid
from cloakframe.llm.langid import Classifier, ProfileRules
from cloakframe.llm.queries import QUERIES


def slow_grams(text, lengths=(1, 2, 3)):
    line = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    line = f" {' '.join(line.split())} "
    return Counter(line[i : i + n] for n in lengths for i in range(len(line) - n + 1) if line[i : i + n] != " ")


def test_gram_counts():
    for text in ("", None, "  42 ", "Ab ab, ÄB!", "x" * 30, "日本 語 abc"):
        want = sorted(slow_grams(text).values()) if any(c.isalpha() for c in text or "") else []
        assert sorted(langid.grams(text, (1, 2, 3))[1].tolist()) == want


def test_out_of_place_distance():
    rules = ProfileRules(profile=5, document=4)
    code = lambda s: langid.grams(s, (1,))[0]
    a, b, c, d = (code(x)[0] for x in "abcd")
    profiles = {"x": np.array([a, b, c]), "y": np.array([c, d])}
    name, score = Classifier(profiles, ProfileRules(lengths=(1,), profile=5, document=4)).predict("aaa bb c")
    assert name == "x" and score == 1.0
    # d c: ranks 0 and 1 in the text, 1 and 0 in y; d is missing from x and c is one away
    assert Classifier(profiles, ProfileRules(lengths=(1,), profile=5, document=4)).predict("ddd c") == ("y", 1 - 2 / 10)
    assert rules.document == 4


def test_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (4, "a word", None), (4, "a word", "en"), (None, "w " * 30_000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn(docs)
    out = langid.identify(docs.withColumnRenamed("lang", "score"), profiles).collect()
    assert len(out) == len(rows)
    assert [r.lang_pred for r in out if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.learn(docs.limit(0)) == {}
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op2_language_id"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_a_language_of_copies_has_a_profile(spark):
    texts = spark.createDataFrame([(f"some words {i}",) for i in range(50)], "text string")
    copied = texts.orderBy(F.xxhash64("text").desc()).first().text
    docs = spark.createDataFrame([("aa", copied)] * 50 + [("bb", f"other text {'xyz'[i % 3] * i}") for i in range(50)], "lang string, text string")
    profiles = langid.learn(docs, rules=ProfileRules(sample=10))
    assert set(profiles) == {"aa", "bb"} and len(profiles["aa"])


def test_many_languages_and_one_text_of_most_rows(spark):
    """Ranks grow with the profiles; a language of one text, repeated in nine rows of ten, is learned all the same."""
    words = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}{'oe'[k % 2]}" for k in range(12))
    rows = [(words(i), f"l{i:03}") for i in range(200)]
    docs = spark.createDataFrame(rows + [(words(7), "l007")] * 1800, "text string, lang string").repartition(4)
    profiles = langid.learn(docs, rules=langid.ProfileRules(sample=3))
    assert len(profiles) == 200
    made = langid.Classifier(profiles, langid.ProfileRules())
    assert len(made.rank) == len(made.lang) == sum(map(len, profiles.values()))
    assert [made.predict(t)[0] for t, _ in rows] == [name for _, name in rows]
