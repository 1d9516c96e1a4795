import numpy as np
import pandas as pd
import pytest

from cloakframe.llm import mixing
from cloakframe.llm.mixing import AXES, MixRules
from cloakframe.llm.queries import QUERIES


def cells(rng, n=60):
    table = pd.DataFrame({"source": rng.choice(list("abcd"), n), "lang": rng.choice(list("xyz"), n), "topic": rng.choice(list("123"), n), "tokens": rng.integers(1, 500, n)})
    return table.groupby(list(AXES), as_index=False)["tokens"].sum()


def slow_rake(table, shares, rounds=400):
    weights = np.ones(len(table))
    total = table["tokens"].sum()
    for _ in range(rounds):
        for axis in AXES:
            for value, share in shares[axis].items():
                mine = (table[axis] == value).to_numpy()
                weights[mine] *= share * total / (weights[mine] * table["tokens"][mine]).sum()
    return weights


def test_rake_matches_brute_force_and_margins():
    table = cells(np.random.default_rng(1))
    shares = {"source": dict(zip("abcd", (0.1, 0.2, 0.3, 0.4), strict=True)), "lang": dict(zip("xyz", (0.5, 0.3, 0.2), strict=True)), "topic": dict(zip("123", (0.3, 0.3, 0.4), strict=True))}
    weight, miss = mixing.rake(table, shares, MixRules())
    assert miss < 1e-8
    assert np.allclose(weight, slow_rake(table, shares), rtol=1e-6)
    for axis in AXES:
        got = (weight * table["tokens"]).groupby(table[axis]).sum() / table["tokens"].sum()
        assert np.allclose([got[v] for v in shares[axis]], list(shares[axis].values()))


@pytest.mark.parametrize("share", [0.05, 0.5, 0.97])
def test_rate(share):
    rng = np.random.default_rng(2)
    tokens, weight = rng.integers(1, 99, 40).astype(float), rng.random(40) * 3
    rate = mixing.rate_for(tokens, weight, share * tokens.sum())
    assert np.isclose((tokens * np.minimum(1, rate * weight)).sum(), share * tokens.sum())


def test_scale_path_is_the_same(spark):
    table = cells(np.random.default_rng(3), 25)
    frame = spark.createDataFrame(table)
    near = mixing.calibrate(frame, MixRules(rounds=2)).toPandas().set_index(list(AXES)).sort_index()
    far = mixing.calibrate(frame, MixRules(rounds=2, driver_cells=0)).toPandas().set_index(list(AXES)).sort_index()
    assert np.allclose(near, far, rtol=1e-6)


def test_edge_cases(spark):
    rows = [(1, "alpha alpha beta", "s", "en", 7), (2, None, None, None, 7), (3, "", "s", None, 7), (4, "a b c", None, "en", 7), (4, "a b c", None, "en", 7), (None, "gamma " * 20_000, "t", "de", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight int")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert (by[1].n_tokens, by[2].n_tokens, by[None].n_tokens) == (3, 0, 20_000)
    assert by[2].topic == by[3].topic == "none" and "none" not in (by[1].topic, by[4].topic)
    assert all(0 <= r.prob <= 1 and r.weight >= 0 for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_query_meets_margins(spark, sf_dir):
    got = QUERIES["op4_mixing"](spark, sf_dir).toPandas()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    total = got["n_tokens"].sum()
    assert abs((got["prob"] * got["n_tokens"]).sum() / total - 0.5) < 1e-6
    weighted = (got["weight"] * got["n_tokens"]).groupby(got["lang"]).sum() / total
    plain = got.groupby("lang")["n_tokens"].sum() ** 0.7
    assert np.allclose(weighted.sort_index(), (plain / plain.sum()).sort_index(), atol=1e-4)
    assert 0.3 < (got["sampled"] * got["n_tokens"]).sum() / total < 0.7


def test_unmet_margins_are_told(spark):
    """One source has all of one language, so both margins can't be met at once."""
    rows = [(i, f"word{i % 3} text {i}", "st"[i % 2], "xy"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    rules = MixRules(targets={"source": {"s": 0.9, "t": 0.1}, "lang": {"x": 0.1, "y": 0.9}}, rounds=20)
    with pytest.warns(UserWarning, match="margins can't all be met"):
        mixed = mixing.mix(docs, rules=rules).collect()
    frame = spark.createDataFrame(mixed)
    told = {(r.axis, r.value): (r.target, r.reached) for r in mixing.margins(frame, rules=rules).collect()}
    assert told["source", "s"][0] == 0.9 and abs(told["source", "s"][1] - 0.9) > 0.01 or abs(told["lang", "x"][1] - 0.1) > 0.01
    assert abs(sum(reached for (axis, _), (_, reached) in told.items() if axis == "source") - 1) < 1e-9


def test_topics_are_clusters(spark):
    """Texts of two vocabularies fall into two topics, whatever their copies."""
    rows = [(i, " ".join(f"{'ab'[i % 2]}{(i * 7 + k) % 40}word" for k in range(30)), "s", "x") for i in range(60)]
    docs = spark.createDataFrame(rows + [(1000 + i, rows[0][1], "s", "x") for i in range(300)], "doc_id long, text string, source string, lang string")
    topics = {r.doc_id: r.topic for r in mixing.mix(docs, rules=MixRules(topics=2)).collect()}
    assert len({topics[i] for i in range(0, 60, 2)}) == 1 and len({topics[i] for i in range(1, 60, 2)}) == 1 and topics[0] != topics[1]
    assert {topics[i] for i in range(1000, 1300)} == {topics[0]}


def test_topics_are_learned_from_all_documents(spark):
    """Texts that no sample of the 2,000 lowest hashes has are a topic of their own."""
    from pyspark.sql import functions as F

    common = spark.range(2500).select("id", F.concat_ws(" ", *[F.concat(F.lit("a"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(30)), F.lit("word")) for k in range(12)], F.concat(F.lit("a"), F.pmod("id", F.lit(50)))).alias("text"))
    bound = common.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(2000).agg(F.max("h")).first()[0]
    rare = spark.range(10_000, 10_200).select("id", F.concat_ws(" ", *[F.concat(F.lit("b"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(20))) for k in range(12)]).alias("text")).where(F.xxhash64("text") > bound).limit(8)
    docs = common.unionByName(rare).select(F.col("id").alias("doc_id"), "text", F.lit("s").alias("source"), F.lit("x").alias("lang"))
    topics = {r.doc_id: r.topic for r in mixing.mix(docs, rules=MixRules(topics=2)).collect()}
    assert len({t for i, t in topics.items() if i >= 10_000}) == 1 and len({t for i, t in topics.items() if i < 10_000}) == 1 and len(set(topics.values())) == 2
