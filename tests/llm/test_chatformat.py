from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cloakframe.llm import chatformat as c
from cloakframe.llm.queries import CONTROL, QUERIES

NASTY = ["", "\\", "<|", "<\\|", "\\n", "a\nb", "<|im_end|>\n", "<|im_start|>user\n", "\\<|", "<", "|>", CONTROL, "é😀", "x" * 100_000]
SCHEMA = "conv_id long, seq long, kind string, turn long, role string, text string"


def test_escapes_round_trip():
    for text in NASTY:
        assert c.unescape(c.escape(text)) == text and "<|" not in c.escape(text)
        assert c.unescape(c.escape_role(text)) == text and "\n" not in c.escape_role(text)


def test_fold(spark):
    log = [
        (1, 1, "message", 0, "user", "hi"),
        (1, 2, "message", 1, "assistant", "He"),
        (1, 3, "delta", 1, None, "llo"),
        (1, 5, "regenerate", 1, None, "Bye"),
        (1, 6, "delta", 1, None, " now"),
        (1, 4, "delta", 1, None, " there"),
        (1, 7, "edit", 0, None, "hi!"),
        (1, 8, "message", 2, "user", "gone"),
        (1, 9, "delete", 2, None, None),
        (1, 10, None, 3, "assistant", None),
        (2, 1, "delta", None, None, "no turn"),
        (2, 2, "delta", None, None, ", no role"),
        (None, 1, "message", 0, "user", None),
    ]
    events = spark.createDataFrame(log, SCHEMA).repartition(4)
    got = {(r.conv, r.turn): (r.role, r.text) for r in c.fold_events(events).collect()}
    assert got == {(1, 0): ("user", "hi!"), (1, 1): ("assistant", "Bye now"), (1, 3): ("assistant", ""), (2, None): ("", "no turn, no role"), (None, 0): ("user", "")}
    with pytest.raises(Exception, match="unknown event kind"):
        c.fold_events(spark.createDataFrame([(1, 1, "odd", 0, "user", "x")], SCHEMA)).collect()


def test_render_round_trip(spark):
    rows = [(1, 1, "message", i, role, text) for i, (role, text) in enumerate([(r, t) for r in ("user", "assistant", "a\nb<|\\") for t in NASTY])]
    out = c.format_events(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 1 and out[0].n_turns == len(rows)
    assert c.read_back(out[0].formatted) == [(r[4], r[5]) for r in rows]
    spans = [c.unescape(out[0].formatted[s.start : s.end]) for s in out[0].loss]
    assert spans == NASTY
    assert out[0].formatted.count(c.START) == len(rows)
    assert c.format_events(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_turns_stay(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    assert c.format_events(c.turns_as_events(turns)).first().n_turns == 3


def test_the_log_needs_its_sequence(spark):
    texts = [*NASTY, "abcdefgh", None]
    turns = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    log = c.turns_as_events(turns)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds == {"message": len(texts), "delta": 3 * len(texts), "edit": (len(texts) + 1) // 2, "regenerate": len(texts) // 2}
    folded = lambda events: [x[1] for x in c.read_back(c.format_events(events).first().formatted)]
    want = [t or "" for t in texts]
    assert folded(log) == want and folded(log.repartition(5)) == want
    assert folded(log.withColumn("seq", F.lit(0))) != want and folded(log.withColumn("seq", -F.col("seq"))) != want


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)]
    want = {}
    for conv, _, role, text in sorted(rows):
        n, said, loss = want.get(conv, (0, "", ""))
        want[conv] = n + 1, f"{said}{role}\n{text or ''}\n", loss + (text or "") * (role == "assistant")
    got = {r.conv_id: r for r in QUERIES["op5_chat_format"](spark, sf_dir).collect()}
    assert set(got) == set(want)
    for conv, (n, said, loss) in want.items():
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= len(said) + 22 * n
