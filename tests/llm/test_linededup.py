from hashlib import sha256

import numpy as np
import pytest

from cloakframe.llm import linededup
from cloakframe.llm.cuckoo import CuckooFilter
from cloakframe.llm.linededup import LineIndex, dedup_lines

SPACE = " \t\n\x0b\x0c\r"


def lower(s):
    return s.encode().lower().decode()


def brute(rows, min_chars=10):
    """rows: (id, text); the kept text of each row."""
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = lower(x.strip(SPACE))
            if len(k) >= min_chars and i is not None:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(k := lower(x.strip(SPACE))) < min_chars or len(holders[k]) < 2 or min(holders[k]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


ROWS = [
    (1, "one shared line here\nonly in document one\n\nshort"),
    (2, "One Shared LINE here \t\nown text of two\nshort"),
    (3, None),
    (4, ""),
    (5, "ünïcode sharéd\none shared line here\none shared line here"),
    (6, "Ünïcode sharéd\nünïcode sharéd "),
    (None, "one shared line here"),
    (7, "x" * 50_000 + "\n" + "y y " * 10_000),
    (8, "x" * 50_000 + "\n\n\n"),
    (8, "x" * 50_000),
]


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot,shard_refs", [(linededup.HOT, linededup.SHARD_REFS), (0.0, 3), (0.9, 1)])
def test_matches_brute_force(spark, monkeypatch, tmp_path, hot, shard_refs):
    monkeypatch.setattr(linededup, "HOT", hot)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    assert got(dedup_lines(docs)) == brute(ROWS)
    index = LineIndex(spark, str(tmp_path / "few"), shard_refs=shard_refs)
    index.insert(docs)
    assert got(index.dedup(docs)) == brute(ROWS)


def test_a_line_of_all_documents_and_ids_as_strings(spark):
    rows = [(f"id{i:03}", f"the same line everywhere\nline {i // 2} of a few\nown line {i} here") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    assert got(dedup_lines(docs)) == brute(rows)


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(none).count() == 0
    own = ("doc", "hi", "lo", "doomed", "shard", "first", "_doc", "_doomed", "_aside3_")
    extra = spark.createDataFrame([(1, "a long enough line", 9, *own)], ["doc_id", "text", "n_lines", *own])
    out = dedup_lines(extra)
    assert out.columns == ["doc_id", "text", *own, "n_lines", "n_dropped"]
    assert tuple(out.first()) == (1, "a long enough line", *own, 1, 0)


def test_query_on_documents(spark, sf_dir):
    from cloakframe.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, d, sha256(t.encode()).hexdigest()) for i, t, n, d in brute(rows)}
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op3_line_dedup"](spark, sf_dir).collect()}
    assert found == want


def tables(index):
    return [sorted(map(tuple, df.collect())) for df in (index.postings(), index.refs())]


def ids(*values):
    return lambda spark: spark.createDataFrame([(v,) for v in values], "doc long")


def test_index_is_reversible_and_opens_again(spark, tmp_path):
    rows = [r for r in ROWS if r[0] not in (None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "one")
    one = LineIndex(spark, path, shard_refs=2)
    one.insert(docs.where("doc_id <= 4"))
    before = tables(one)
    one.insert(docs)  # adds those of 5 and over only
    assert one.meta["shards"] > 1 and got(one.dedup(docs)) == brute(rows)
    again = LineIndex(spark.newSession(), path)  # as after its driver was lost
    assert (again.version, again.meta) == (one.version, one.meta)
    again.delete(ids(5, 6, 7, 77)(spark))
    assert tables(again) == before
    again.delete(ids(1)(spark))
    rest = [r for r in rows if r[0] in (2, 3, 4)]
    assert got(again.dedup(docs.where("doc_id in (2, 3, 4)"))) == brute(rest)
    again.insert(docs)
    assert tables(again)[1] == tables(one := LineIndex(spark, path))[1] and got(one.dedup(docs)) == brute(rows)
    again.delete(docs.selectExpr("doc_id AS doc"))
    assert tables(again) == [[], []]


def test_a_change_that_was_lost_leaves_the_last_version(spark, tmp_path):
    docs = spark.createDataFrame([r for r in ROWS if r[0] in (1, 2, 5)], "doc_id long, text string")
    path = str(tmp_path / "one")
    one = LineIndex(spark, path)
    one.insert(docs.where("doc_id < 5"))
    before = tables(one)
    one.commit = lambda change: None  # all is written but the last file
    one.insert(docs)
    again = LineIndex(spark, path)
    assert tables(again) == before
    again.insert(docs)
    assert got(again.dedup(docs)) == brute([tuple(r) for r in docs.collect()])


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    made = CuckooFilter.build(keys)
    assert made.contains(keys).all()
    others = rng.integers(-(2**63), 2**63 - 1, 50_000)
    assert made.contains(others).mean() < 0.001
    made = CuckooFilter.from_bytes(made.to_bytes())
    made.delete(keys[:2500])
    assert made.contains(keys[2500:]).all()
    assert made.contains(keys[:2500]).mean() < 0.01
    assert made.add(keys[:2500]) and made.contains(keys).all()
