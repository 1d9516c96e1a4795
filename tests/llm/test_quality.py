import math
from collections import Counter

import pytest

from cloakframe.llm import quality
from cloakframe.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"


def slow(text):
    text = text or ""
    words = [w for w in text.translate(dict.fromkeys(map(ord, WHITE), " ")).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None,
    "",
    " \t\x0b\x0c\r\n\n",
    "one two three four five six seven eight",
    "a b c d e f g h a b c d e f g h",
    "a a a a a a a a a",
    "x y " * 15_000,
    "é😀 word x\n" * 3,
    "same\nsame\n same\n\n\nsame",
    "### | $$ <>&% * " * 4,
    " ".join(f"w{i}" for i in range(30)),
    " ".join(f"w{i}" for i in range(30)),
    " ".join(f"w{i % 25}" for i in range(60)),
]


def slow_verdicts(rows):
    """rows (id, host, text): base_failed and kept."""
    out, hosts = [], {}
    for i, host, text in rows:
        n, _, symbols, dup, repeat = slow(text)
        lines = sum(bool(x.strip(WHITE)) for x in (text or "").split("\n"))
        base = n < 20 or 100 * repeat > 30 * n
        failed = base or 100 * symbols > 10 * n or 100 * dup > 50 * lines
        hosts.setdefault(host, []).append(failed)
        out.append((i, host, base, failed))
    rates = [sum(f) / len(f) for f in hosts.values()]
    mean = sum(rates) / len(rates)
    var = sum((r - mean) ** 2 for r in rates) / len(rates)
    weight = 1000.0 if var <= 0 else max(1.0, min(1000.0, mean * (1 - mean) / var - 1))
    rate = {h: (sum(f) + mean * weight) / (len(f) + weight) for h, f in hosts.items()}
    return {i: (base, not failed and rate[host] <= 0.5, rate[host]) for i, host, base, failed in out}


def test_measurements_and_verdicts(spark):
    rows = [(i, ("h1", "h2", None)[i % 3], t) for i, t in enumerate(TEXTS)] + [(100 + i, "good", " ".join(f"g{i}x{j}" for j in range(40))) for i in range(30)]
    docs = spark.createDataFrame([(*r, 5, True) for r in rows], "doc_id long, source string, text string, m int, kept boolean").repartition(3)
    want = slow_verdicts(rows)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(rows)
    for i, _, text in rows:
        m = got[i].m
        assert (m.words.n, m.word_chars, m.n_symbols, m.lines.dup, m.words.repeat) == slow(text), i
        assert (got[i].base_failed, got[i].kept) == want[i][:2]
        assert math.isclose(got[i].host_rate, want[i][2])
    assert all(got[100 + i].kept for i in range(30))


def test_bad_host_goes_and_empty(spark):
    fine = " ".join(f"w{j}" for j in range(30))
    rows = [(i, "bad", "short") for i in range(50)] + [(99, "bad", fine)] + [(200 + i, "ok", fine) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert kept == set(range(200, 250))
    assert quality.judge(docs.limit(0)).count() == 0


def test_native_plan(spark, sf_dir):
    plan = QUERIES["op9_quality_rules"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op3_line_dedup", "op5_chat_format", "op9_quality_rules"])
def test_same_as_sql(spark, sf_dir, name):
    from oracle import compare, connect

    from cloakframe.llm.queries import ORACLES

    compare(spark, connect(sf_dir), sf_dir, name, QUERIES[name], ORACLES[name])
