"""All operators and stages over tables whose other columns have the operators' own names, with nulls and repeated rows, and over none."""

import pytest

import corpus_pipeline
from cloakframe.llm import decontaminate, hmm, htmltext, langid, linededup, mixing, quality, secrets, simhash

NAMES = (
    "m base_failed doc_failed host_rate host_ok kept _host n_lines n_dropped _doc _doomed doc hi lo doomed shard first fp component root salt held rows "
    "n_tokens topic weight prob sampled _s _l _source _lang _topic tokens n_known train_tokens base_score score _chunk _docs _sizes _at _apart row _id _of "
    "lang_pred secrets n_chars_ item end_word _found _gone label node a b k block _aside0_ _aside9_ words plain value url"
).split()
ROWS = [
    (1, "a line that two documents hold\nand some words more of it", "s", "en", 9),
    (1, "a line that two documents hold\nand some words more of it", "s", "en", 9),
    (2, "a line that two documents hold\nother words of the second text", "s", None, None),
    (3, None, None, "en", 9),
    (4, "", "t", "de", 9),
    (None, "no id but a line that two documents hold", "t", "de", 9),
    (5, "<p>some page of words</p> password = hunter22hunter", "u", "en", 9),
]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def table(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for i, name in enumerate(NAMES):
        from pyspark.sql import functions as F

        docs = docs.withColumn(name, F.lit(None).cast("string") if i % 5 == 0 else F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return docs


RULES = hmm.HmmRules(states=2, corpus_rounds=1, sample_rounds=1)
OPERATORS = {
    "quality": (quality.judge, "m base_failed doc_failed host_rate host_ok kept"),
    "lines": (linededup.dedup_lines, "n_lines n_dropped text"),
    "hmm": (lambda d: hmm.score(d, hmm.learn(d, rules=RULES), rules=RULES), "n_tokens n_known train_tokens base_score score text"),
    "mixing": (mixing.mix, "n_tokens topic weight prob sampled"),
    "langid": (lambda d: langid.identify(d, langid.learn(d)), "lang_pred score"),
    "secrets": (lambda d: secrets.find_secrets(d, secrets.train(d, rules=secrets.SecretRules(generated=50))), "secrets"),
    "simhash": (simhash.keep_one, ""),
    "html": (lambda d: htmltext.extract(d.withColumnRenamed("text", "html"), rules=htmltext.LabellerRules(pages=5, passes=1)).withColumnRenamed("html", "text_"), "text n_chars"),
}


def values(rows, names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators(spark, name):
    operator, replaced = OPERATORS[name]
    docs = table(spark, ROWS)
    stay = [c for c in docs.columns if c not in replaced.split() and c != "text"]
    made = operator(docs)
    assert len(set(made.columns)) == len(made.columns) and set(stay) <= set(made.columns)
    got, want = values(made.collect(), stay), values(docs.collect(), stay)
    if name == "simhash":
        assert set(got) <= set(want) and got
    else:
        assert got == want
    assert operator(table(spark, ROWS).limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, sf_dir, name, stage):
    docs = table(spark, ROWS * 3 + [(10 + i, f"{' '.join(f'word{i}x{k}' for k in range(40))}\nand a last line {i}", "s", "en", 9) for i in range(30)])
    made = stage(spark, docs, sf_dir)
    stay = [c for c in docs.columns if name != "line_dedup" or c not in ("text", "n_chars")]
    extra = made.columns[len(docs.columns) :]
    assert made.columns[: len(docs.columns)] == docs.columns
    assert extra == (["n_tokens_", "topic_", "weight_", "prob_"] if name == "mixture" else [])
    got, want = values(made.collect(), stay), values(docs.collect(), stay)
    assert got and set(got) <= set(want)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_contaminated(spark):
    docs = table(spark, ROWS)
    bench = spark.createDataFrame([(1, "no benchmark text of these documents is here"), (2, None), (3, "other words of the second text")], "item_id long, text string")
    made = decontaminate.drop_contaminated(docs, bench)
    assert made.columns == docs.columns and values(made.collect(), docs.columns) == values(docs.where("doc_id is null or doc_id <> 2").collect(), docs.columns)
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
