"""Secret scans: fixed rules, and character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cloakframe.llm.common import drawn_texts, text_bytes

#: Fixed rules, in their order: name, pattern, least length, and the group that has it.
RULES = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 8, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 16, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 32, 0),
)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "markov")
#: Runs that a model can judge, and the longer class that holds all hex runs too.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
ALPHABET = string.ascii_letters + string.digits + "+/_-="
INDEX = {c: i + 1 for i, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET) + 1


@dataclass(frozen=True)
class SecretRules:
    #: Distinct texts to learn from, at most; chosen by their hashes.
    sample: int = 2000
    #: Generated random strings and identifiers, beside those of the sample.
    generated: int = 4000
    smoothing: float = 0.5
    #: Least log-likelihood ratio, in nats, in favour of a random string.
    threshold: float = 12.0
    seed: int = 7


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed rules' matches, in order."""
    found = []
    low = text_bytes(text).lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in RULES[0][1].finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in RULES[1][1].finditer(text) if len(m[0]) >= 16]
    for run in RUN.finditer(text):  # a hex run of 32 is part of such a run
        if run.end() - run.start() >= 32:
            found += [(m.start(), 2, m.end()) for m in RULES[2][1].finditer(text, run.start(), run.end()) if len(m[0]) >= 32]
    return sorted(found)


def steps(token: str) -> np.ndarray:
    """Each character with the one before it, as a place in the transition table."""
    codes = np.array([0, *[INDEX.get(c, 0) for c in token]])
    return codes[:-1] * SIZE + codes[1:]


def random_strings(rules: SecretRules) -> Iterator[str]:
    rng = random.Random(rules.seed)
    alphabets = ("0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-")
    for i in range(rules.generated):
        yield "".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(16, 64)))


def identifiers(words: list[str], rng: random.Random) -> Iterator[str]:
    """Words, and the ways in which code and paths join them."""
    for i in range(len(words) - 2):
        few = words[i : i + rng.randint(1, 3)]
        yield rng.choice((
            "".join(few), "_".join(few), "-".join(few), "/".join(few), "".join(w.capitalize() for w in few),
            "_".join(few).upper(), f"{'_'.join(few)}_{rng.randint(0, 2030)}", f"/{'/'.join(few)}/{rng.randint(0, 99)}",
        ))


WORDS = re.compile(r"[A-Za-z]{2,}")


def train(docs: DataFrame, text: str = "text", rules: SecretRules = SecretRules()) -> np.ndarray:
    """The log-likelihood ratio of each character step, random strings against identifiers.

    Random examples are generated, and are the values that the fixed rules find
    in the sample; ordinary ones are the sample's other words, alone and joined
    as identifiers. The steps are counted in the tasks; the table is of fixed size.
    """
    docs = docs.select(F.col(text).alias("text"))
    chosen = drawn_texts(docs, "text", rules.sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            for value in batch.column(0):
                body = value.as_py() or ""
                spans = base_spans(body)
                rest, at = [], 0
                for start, kind, end in spans:
                    secret = RULES[kind][1].match(body, start)
                    np.add.at(counts[1], steps(secret[RULES[kind][3]]), 1)
                    rest.append(body[at:start])
                    at = max(at, end)
                words = WORDS.findall(" ".join([*rest, body[at:]]))
                for made in (*words, *identifiers(words, random.Random(len(body)))):
                    np.add.at(counts[0], steps(made), 1)
        label, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(step), pa.array(counts[label, step])], ["label", "step", "n"])

    rows = chosen.mapInArrow(count, "label long, step long, n long").groupBy("label", "step").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, SIZE * SIZE))
    for r in rows:
        counts[r.label, r.step] = r.n
    for made in random_strings(rules):
        np.add.at(counts[1], steps(made), 1)
    for made in identifiers(("the index of user name data file for api http path value list " * 40).split(), random.Random(rules.seed)):
        np.add.at(counts[0], steps(made), 1)
    table = counts.reshape(2, SIZE, SIZE) + rules.smoothing
    table = np.log(table / table.sum(axis=2, keepdims=True))
    return (table[1] - table[0]).reshape(-1)


REPEATS = re.compile(r"(.)\1{2,}")


def ratio(token: str, table: np.ndarray) -> float:
    """Its log-likelihood ratio; longer repeats of a character, as in ruled lines, count as two."""
    return float(table[steps(REPEATS.sub(r"\1\1", token))].sum())


def scan(text: str | None, table: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """The fixed rules' spans, and those of other runs that the models take for random."""
    body = text or ""
    base = base_spans(body)
    added = []
    for m in CANDIDATE.finditer(body):
        if all(m.end() <= s or m.start() >= e for s, _, e in base) and ratio(m[0], table) > threshold:
            added.append((m.start(), 3, m.end()))
    return sorted(base + added)


def find_secrets(docs: DataFrame, table: np.ndarray, text: str = "text", rules: SecretRules = SecretRules()) -> DataFrame:
    """Documents with ``secrets``, an array of (start, end, kind) by start, then kind.

    Offsets are code points, ends exclusive. Null text is empty. A run that
    overlaps a fixed rule's span is not judged again. Spans may nest where fixed
    rules overlap. A column named secrets is replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "secrets"])
    where, names = docs.columns.index(text), docs.columns
    model = docs.sparkSession.sparkContext.broadcast(table)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in scan(v.as_py(), model.value, rules.threshold)] for v in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*names, "secrets"])

    return docs.mapInArrow(find, StructType(docs.schema.fields + StructType.fromDDL("secrets array<struct<start:int,end:int,kind:string>>").fields))
