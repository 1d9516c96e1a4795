import random
import re
import string
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cloakframe.llm import secrets
from cloakframe.llm.queries import QUERIES


def slow_base(text):
    text = text or ""
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) + "?" * (k[-1] == "_") for k in ("password", "passwd", "secret", "token"))
    key += "|[aA][pP][iI]_?[kK][eE][yY]"
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


CASES = [
    None,
    "",
    "password=short",
    "PassWord = 'longenough1'",
    "é😀 api_key: abcdefgh, apikey=abcdefg, API_KEY=ABCDEFGH",
    "AKIAABC AKIA" + "B" * 12 + " xAKIA" + "9" * 20 + "a",
    "a" * 31 + " " + "0" * 32 + "g" + "f" * 40,
    "token = token = abcdefghij",
    "paſſword=abcdefghij toKen=abcdefghij toKen=abcdefghij",
    "secret=" + "deadbeef" * 8,
    "token:" + "x" * 100_000,
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_fixed_rules(i):
    assert secrets.base_spans(CASES[i] or "") == slow_base(CASES[i])


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return secrets.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_held_out_strings(table):
    rng = random.Random(99)
    alphabets = (string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits)
    made = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 40))) for _ in range(500)]
    assert sum(secrets.ratio(x, table) > 12 for x in made) >= 0.97 * len(made)
    plain = ["internationalization", "get_user_name_by_index", "ThisIsAnOrdinaryClassName", "some/path/to/a/file", "MAX_BUFFER_SIZE_LIMIT", "Geschwindigkeitsbegrenzung", "----------------------"]
    assert [x for x in plain if secrets.ratio(x, table) > 12] == []


def test_edge_cases(spark, table):
    rows = [(i, t, "x") for i, t in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string").repartition(3)
    out = {r.doc_id: r.secrets for r in secrets.find_secrets(docs, table).collect()}
    assert len(out) == len(CASES)
    for i, t in enumerate(CASES):
        assert [(s.start, s.end, s.kind) for s in out[i] if s.kind != "markov"] == [(s, e, secrets.KINDS[k]) for s, k, e in slow_base(t)]
    assert secrets.find_secrets(docs.limit(0), table).count() == 0
    assert secrets.train(docs.limit(0)).shape == table.shape


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_secret_scan"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    added = 0
    for r in rows:
        base = slow_base(texts[r.doc_id])
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[1] == k for b in base) for k in range(3))
        added += r.spans.count("markov")
    assert added <= 0.02 * len(rows)


def test_copies_count_once_in_the_sample(spark):
    texts = spark.createDataFrame([(f"zebra_{i} quartz jumping vexed",) for i in range(50)], "text string")
    copied = texts.orderBy(F.xxhash64("text").desc()).first().text
    rules = secrets.SecretRules(sample=10)
    one, many = (secrets.train(spark.createDataFrame([(copied,)] * n, "text string"), rules=rules) for n in (1, 50))
    assert (one == many).all()
