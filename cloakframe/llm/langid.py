"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UNKNOWN = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ProfileRules:
    #: Lengths of the n-grams.
    lengths: tuple[int, ...] = (1, 2, 3)
    #: Ranks in a language's profile, and the most frequent n-grams taken of a document.
    profile: int = 600
    document: int = 400
    #: Distinct labelled texts to learn a language from, in expectation.
    sample: int = 3000


def grams(text: str | None, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of a text's n-grams and their counts. Words are runs of letters in lower case, in single spaces."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    distinct, where = np.unique(points, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in distinct.tolist()], bool)
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    line = np.where(letter[where], points, np.uint32(32))
    line = np.concatenate([[np.uint32(32)], line, [np.uint32(32)]])
    line = line[np.r_[True, (line[1:] != 32) | (line[:-1] != 32)]].astype(np.uint64)
    parts = []
    with np.errstate(over="ignore"):
        code = np.zeros(len(line), np.uint64)
        for n in range(1, max(lengths) + 1):
            code = code[: len(line) - n + 1] * MIX + line[n - 1 :] + np.uint64(1)
            if n in lengths:
                parts.append(code[line != 32] if n == 1 else code)
    return np.unique(np.concatenate(parts), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, best first; ties by code."""
    return codes[np.lexsort((codes, -counts))[:most]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", rules: ProfileRules = ProfileRules()) -> dict[str, np.ndarray]:
    """A profile for each non-null language: its n-grams by falling frequency.

    Languages with more than ``rules.sample`` distinct texts are learned from about
    so many, chosen by a hash of the text, each once however many copies it has; the result is a few thousand codes a
    language. Counts are summed in each task before the shuffle.
    """
    docs = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = {r.lang: r["count"] for r in docs.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count().collect()}
    if not sizes:
        return {}
    # A row a language, as the profiles have.
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, rules.sample / n)) for k, n in sizes.items()], "lang string, share double")
    drawn = F.xxhash64("text").cast("double") / F.lit(float(2**64)) + 0.5 <= F.col("share")
    chosen = docs.join(F.broadcast(shares), "lang").where(drawn).dropDuplicates(["lang", "text"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                totals.setdefault(name, []).append(grams(value.as_py(), rules.lengths))
                if len(totals[name]) >= 500:
                    totals[name] = [summed(totals[name])]
        for name, parts in totals.items():
            codes, counts = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], ["lang", "code", "n"])

    counted = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = ranked(pdf["code"].to_numpy().view(np.uint64), pdf["n"].to_numpy(), rules.profile)
        return pd.DataFrame({"lang": pdf["lang"].iat[0], "rank": np.arange(len(codes)), "code": codes.view(np.int64)})

    rows = counted.groupBy("lang").applyInPandas(best, "lang string, rank int, code long").toPandas()
    return {name: g.sort_values("rank")["code"].to_numpy().view(np.uint64) for name, g in rows.groupby("lang")}


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


class Classifier:
    """Out-of-place distance from a document's ranked n-grams to each profile.

    For each code, the languages that have it and their ranks: as many numbers as
    the profiles have, however many languages there are.
    """

    def __init__(self, profiles: dict[str, np.ndarray], rules: ProfileRules):
        self.rules = rules
        self.names = sorted(profiles)
        codes = np.concatenate([np.zeros(0, np.uint64), *[profiles[n] for n in self.names]])
        sizes = [len(profiles[n]) for n in self.names]
        order = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[order], return_index=True)
        self.first = np.r_[first, len(codes)]
        self.lang = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.rank = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) for n in sizes]])[order].astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and, from 0 to 1, how near it is; ties go to the first name."""
        codes, counts = grams(text, self.rules.lengths)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        top = ranked(codes, counts, self.rules.document)
        at = np.searchsorted(self.codes, top)
        place = np.flatnonzero(self.codes[np.minimum(at, len(self.codes) - 1)] == top) if len(self.codes) else np.zeros(0, np.int64)
        begin, size = self.first[at[place]], np.diff(self.first)[at[place]]
        ends = np.cumsum(size)
        rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
        # An n-gram that a profile lacks is out of place by the whole profile.
        nearer = self.rules.profile - np.abs(self.rank[rows] - np.repeat(place, size))
        distance = self.rules.profile * len(top) - np.bincount(self.lang[rows], nearer, len(self.names))
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (self.rules.profile * len(top)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", rules: ProfileRules = ProfileRules()) -> DataFrame:
    """Documents with lang_pred and score, from their whole text alone.

    Null texts, and texts without a letter, are ``und`` with score 0, as all
    texts are where nothing was learned. Columns of the new names are replaced.
    Whole texts count, however long; repeated rows stay. The profiles broadcast
    have a fixed size a language.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    model = docs.sparkSession.sparkContext.broadcast(Classifier(profiles, rules))
    where, names = docs.columns.index(text), docs.columns

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = model.value
        for batch in batches:
            found = [classifier.predict(v.as_py()) for v in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(predict, StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double"))
