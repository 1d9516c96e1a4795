"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling."""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cloakframe.llm.common import aside, checkpointed, discard, stored, text_bytes

AXES = ("source", "lang", "topic")


@dataclass(frozen=True)
class MixRules:
    #: Each margin's target shares are its token shares to this power, made to sum to 1, unless given.
    temper: dict[str, float] = field(default_factory=lambda: {"source": 0.7, "lang": 0.7, "topic": 0.7})
    #: Given target shares by axis and value; values that are not named share nothing.
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    #: Share of all tokens to sample, in expectation.
    keep_tokens: float = 0.5
    #: Clusters of texts, the rounds in which they are fitted, and the hash rows of words.
    topics: int = 8
    topic_rounds: int = 10
    rows: int = 4096
    tolerance: float = 1e-9
    rounds: int = 500
    seed: int = 20250101
    #: Cells beyond this are raked as a DataFrame.
    driver_cells: int = 200_000


class HashRows(dict):
    """The hash row of each word, worked out when it is first asked for."""

    def __init__(self, rules: MixRules) -> None:
        self.rules = rules

    def __missing__(self, word: bytes) -> int:
        self[word] = row = xxhash.xxh64_intdigest(word, self.rules.seed) % self.rules.rows
        return row


#: The logarithms of counts, one more each, of the usual counts.
LOGS = np.log1p(np.arange(1 << 12))


def buckets(words: Counter, memo: HashRows) -> tuple[bytes, bytes]:
    """The hash rows of a text's words, and in each the sum of the logarithms of their counts, one more each."""
    if len(memo) > 400_000:
        memo.clear()
    n = np.fromiter(words.values(), np.int64, len(words))
    logs = LOGS[n] if n.max(initial=0) < len(LOGS) else np.log1p(n)
    sums = np.bincount(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)), logs)
    at = sums.nonzero()[0]
    return at.astype(np.uint32 if memo.rules.rows > 1 << 16 else np.uint16).tobytes(), sums[at].astype(np.float32).tobytes()


def vectors(docs: DataFrame, text: str, rules: MixRules) -> DataFrame:
    """Adds n_tokens (words), and _at and _n: the hash rows of the whole text and what they hold."""
    where, names = docs.columns.index(text), docs.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = HashRows(rules)
        for batch in batches:
            sizes, held = [], []
            for value in batch.column(where):
                ws = text_bytes(value.as_py()).lower().split()
                sizes.append(len(ws))
                held.append(buckets(Counter(ws), memo))
            more = [pa.array(sizes, pa.int64()), *[pa.array([h[i] for h in held], pa.binary()) for i in (0, 1)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "n_tokens", "_at", "_n"])

    return docs.mapInArrow(count, StructType(list(docs.schema.fields)).add("n_tokens", "long").add("_at", "binary").add("_n", "binary"))


def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all of a column's values in a row, and where each value's begin, with the end of the last."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.frombuffer(data.tobytes(), kind), (ends - ends[0]) // np.dtype(kind).itemsize


#: Unit vectors are summed as whole numbers of this part, so that sums don't depend on the order of rows.
PART = 1 << 30
#: Rows of a batch that are held against the centroids at once.
STEP = 1000


@dataclass
class Topics:
    """Clusters of hashed word vectors: each hash row's weight, and the centroids (topics, rows)."""

    weight: np.ndarray
    centroids: np.ndarray

    def near(self, at: pa.Array, n: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By some rows at a time, those that have weight: their places, lengths and dot products with the centroids;
        and their numbers: of which of those rows each is, its hash row, its value."""
        columns = np.ascontiguousarray(self.centroids.T.astype(np.float32))
        for first in range(0, len(at), STEP):
            rows, ends = flat(at.slice(first, STEP), np.uint32 if len(self.weight) > 1 << 16 else np.uint16)
            value = flat(n.slice(first, STEP), np.float32)[0] * self.weight[rows].astype(np.float32)
            of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            size = np.sqrt(np.bincount(of, value.astype(float) ** 2, len(ends) - 1))
            has = size > 0
            new = of
            if not has.all():
                keep = has[of]
                rows, value = rows[keep], value[keep]
                new = (np.cumsum(has) - 1)[of[keep]]
            if not len(rows):
                continue
            starts = np.r_[0, np.flatnonzero(np.diff(new)) + 1]
            dots = np.add.reduceat(columns[rows] * value[:, None], starts, axis=0) if len(self.centroids) else np.zeros((has.sum(), 0))
            yield first + np.flatnonzero(has), size[has], dots, new, rows, value

    def of(self, at: pa.Array, n: pa.Array) -> pa.Array:
        """The topic nearest by angle, the first of ties; 'none' without a word that the clusters know."""
        found = np.full(len(at), "none", object)
        if len(self.centroids):
            for places, _, dots, _, _, _ in self.near(at, n):
                found[places] = dots.argmax(axis=1).astype(str)
        return pa.array(found, pa.string())


def summed(vectors: DataFrame, arrays: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all partitions of an array of whole numbers of that size that each makes of its rows."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = arrays(batches)
        at = values.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values[at], pa.int64())], ["i", "v"])

    found = vectors.mapInArrow(made, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(size, np.int64)
    total[found["i"].to_numpy()] = found["v"].to_numpy()
    return total


def farthest(vectors: DataFrame, topics: Topics) -> np.ndarray | None:
    """The unit vector of the text of most weight apart from the nearest centroid; none where all are on one."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: tuple = (0.0, b"", b"")
        for batch in batches:
            at, n = batch.columns
            for places, size, dots, *_ in topics.near(at, n):
                score = size - dots.max(axis=1, initial=0.0)
                for i in np.flatnonzero(score >= max(score.max(), top[0])):
                    top = max(top, (float(score[i]), at[int(places[i])].as_py(), n[int(places[i])].as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in top], ["score", "at", "n"])

    found = vectors.mapInArrow(best, "score double, at binary, n binary").orderBy(F.desc("score"), F.desc("at"), F.desc("n")).first()
    if found is None or found.score <= 1e-3:
        return None
    at, n = (pa.array([bytes(x)], pa.binary()) for x in found[1:])
    *_, rows, value = next(Topics(topics.weight, topics.centroids[:0]).near(at, n))
    made = np.zeros(len(topics.weight))
    made[rows] = value
    return made / np.linalg.norm(made)


def learn_topics(docs: DataFrame, rules: MixRules) -> Topics:
    """Spherical k-means over the vectors of all documents, copies too.

    Rows that most texts have weigh little. The first centroids are the texts
    that have most weight apart from the ones before. All rounds read all rows,
    and their sums are of whole numbers, so the order of rows doesn't matter.
    """
    docs, size = docs.select("_at", "_n"), rules.rows

    def holders(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        held = np.zeros(size + 1, np.int64)
        for batch in batches:
            held[:size] += np.bincount(flat(batch.column(0), np.uint32 if size > 1 << 16 else np.uint16)[0], minlength=size)
            held[size] += batch.num_rows
        return held

    held = summed(docs, holders, size + 1)
    topics = Topics(np.log((1 + held[size]) / (1 + held[:size])), np.zeros((0, size)))
    while len(topics.centroids) < rules.topics and (one := farthest(docs, topics)) is not None:
        topics = Topics(topics.weight, np.vstack([topics.centroids, one]))
    count = len(topics.centroids)
    for _ in range(rules.topic_rounds if count else 0):

        def members(batches: Iterator[pa.RecordBatch], topics: Topics = topics) -> np.ndarray:
            sums = np.zeros(count * size, np.int64)
            for batch in batches:
                for _, length, dots, of, rows, value in topics.near(*batch.columns):
                    parts = np.rint(value / length[of] * PART)
                    sums += np.bincount(dots.argmax(axis=1)[of] * size + rows, parts, count * size).astype(np.int64)
            return sums

        sums = summed(docs, members, count * size).reshape(count, size).astype(float)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        following = np.where(length > 0, sums / np.maximum(length, 1e-12), topics.centroids)
        settled = np.array_equal(following, topics.centroids)
        topics = Topics(topics.weight, following)
        if settled:
            break
    return topics


def cell(name: str):
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def target_shares(cells: DataFrame, axis: str, rules: MixRules) -> DataFrame:
    """(axis, share) over the values that have tokens; the shares sum to 1."""
    sums = cells.groupBy(axis).agg(F.sum("tokens").alias("t"))
    if axis in rules.targets:
        given = F.create_map(*[F.lit(x) for k, v in rules.targets[axis].items() for x in (f"={k}", float(v))])
        sums = sums.select(axis, F.coalesce(given[F.col(axis)], F.lit(0.0)).alias("share"))
    else:
        sums = sums.select(axis, F.pow("t", F.lit(float(rules.temper.get(axis, 1.0)))).alias("share"))
    total = sums.agg(F.sum("share").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select(axis, F.try_divide("share", "total").alias("share"))  # total is one row


def rake(cells: pd.DataFrame, shares: dict[str, dict[str, float]], rules: MixRules) -> tuple[np.ndarray, float]:
    """Cell weights by iterative proportional fitting, and the largest miss of a margin.

    Weighted tokens sum to all tokens. Where margins can't all be met, as when a
    value occurs in one cell only, the last round's weights are the result.
    """
    tokens = cells["tokens"].to_numpy(float)
    total = tokens.sum()
    weight, miss = np.ones(len(cells)), 0.0
    codes = {axis: pd.factorize(cells[axis]) for axis in AXES}
    goals = {axis: np.array([shares[axis][v] or 0.0 for v in values]) * total for axis, (_, values) in codes.items()}
    for _ in range(rules.rounds):
        miss = 0.0
        for axis, (code, values) in codes.items():
            now = np.bincount(code, weight * tokens, len(values)).astype(float)
            miss = max(miss, float(np.abs(now - goals[axis]).max(initial=0.0)) / max(total, 1.0))
            weight *= np.divide(goals[axis], now, out=np.zeros_like(now), where=now > 0)[code]
        if miss <= rules.tolerance:
            break
    return weight, miss


def rate_for(tokens: np.ndarray, weight: np.ndarray, wanted: float) -> float:
    """The factor with which sum(tokens * min(1, factor * weight)) is the wanted number of tokens."""
    order = np.argsort(-weight)
    t, w = tokens[order], weight[order]
    full, rest = np.r_[0.0, np.cumsum(t)], np.r_[np.cumsum((t * w)[::-1])[::-1], 0.0]
    for i in range(len(t)):
        factor = (wanted - full[i]) / rest[i] if rest[i] > 0 else np.inf
        if factor * w[i] <= 1:
            return max(0.0, factor)
    return 1 / w[w > 0].min() if (w > 0).any() else 0.0


def warn_of(miss: float, rules: MixRules) -> None:
    if miss > max(rules.tolerance, 1e-6):
        warnings.warn(f"the margins can't all be met: one is missed by {miss:.2%} of all tokens; see margins()", stacklevel=2)


def margins(mixed: DataFrame, source: str = "source", lang: str = "lang", rules: MixRules = MixRules()) -> DataFrame:
    """(axis, value, target, reached): each value's target share, and its share of the weighted tokens of mix()'s rows."""
    keyed = mixed.select(cell(source).alias("source"), cell(lang).alias("lang"), cell("topic").alias("topic"), F.col("n_tokens").alias("tokens"), "weight")
    total = mixed.agg(F.sum(F.col("n_tokens") * F.col("weight"))).first()[0] or 0.0
    made = []
    for axis in AXES:
        now = keyed.groupBy(axis).agg(F.sum(F.col("tokens") * F.col("weight")).alias("t"))
        both = target_shares(keyed, axis, rules).join(now, axis)
        made.append(both.select(F.lit(axis).alias("axis"), F.expr(f"if({axis} = '', null, substr({axis}, 2))").alias("value"), F.col("share").alias("target"), F.try_divide("t", F.lit(float(total))).alias("reached")))
    return made[0].unionByName(made[1]).unionByName(made[2])


def calibrate(cells: DataFrame, rules: MixRules) -> DataFrame:
    """(source, lang, topic, weight, prob) for the cells (source, lang, topic, tokens)."""
    spark = cells.sparkSession
    shares = {axis: target_shares(cells, axis, rules) for axis in AXES}
    if cells.limit(rules.driver_cells + 1).count() <= rules.driver_cells:  # a table of sums with a checked size
        table = cells.toPandas()
        weight, miss = rake(table, {axis: dict(map(tuple, s.collect())) for axis, s in shares.items()}, rules)
        warn_of(miss, rules)
        tokens = table["tokens"].to_numpy(float)
        rate = rate_for(tokens, weight, rules.keep_tokens * tokens.sum())
        rows = zip(*[table[a].tolist() for a in AXES], weight.tolist(), np.minimum(1, rate * weight).tolist(), strict=True)
        return spark.createDataFrame(list(rows), "source string, lang string, topic string, weight double, prob double")
    return calibrate_at_scale(cells, shares, rules)


def calibrate_at_scale(cells: DataFrame, shares: dict[str, DataFrame], rules: MixRules) -> DataFrame:
    """The same fitting with a join and an aggregation for each margin and round."""
    total = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    state = state_table = stored(cells.withColumn("weight", F.lit(1.0)))
    misses: list[float] = []
    for _ in range(rules.rounds):
        misses = []
        for axis in AXES:
            sums = state.groupBy(axis).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now")).join(shares[axis], axis)
            factors = checkpointed(sums.select(axis, (F.abs(F.col("now") - F.col("share") * total) / max(total, 1.0)).alias("miss"), F.when(F.col("now") > 0, F.col("share") * total / F.col("now")).otherwise(0.0).alias("f")))
            misses.append(factors.agg(F.coalesce(F.max("miss"), F.lit(0.0))).first()[0])
            state = state.join(factors.select(axis, "f"), axis).withColumn("weight", F.col("weight") * F.col("f")).drop("f")
        last, state = state_table, stored(state)
        state_table = state
        discard(last)
        if max(misses) <= rules.tolerance:
            break
    warn_of(max(misses, default=0.0), rules)
    # The expected tokens are concave and piecewise linear in the rate: each step solves the piece it is on.
    wanted, rate = rules.keep_tokens * total, 0.0
    for _ in range(100):
        capped = rate * F.col("weight") >= 1
        full, rest = state.agg(
            F.sum(F.when(capped, F.col("tokens")).otherwise(0)).cast("double"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("tokens") * F.col("weight"))),
        ).first()
        step = (wanted - (full or 0.0)) / rest if rest else rate
        if step <= rate * (1 + 1e-12):
            break
        rate = step
    return state.select(*AXES, "weight", F.least(F.lit(1.0), rate * F.col("weight")).alias("prob"))


def mix(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", rules: MixRules = MixRules(), drop: tuple[str, ...] = ()) -> DataFrame:
    """All documents with n_tokens, topic, weight, prob and sampled.

    Token weights are raked to the target shares of source, language and topic,
    and each document is sampled with a probability in proportion to its cell's
    weight, 1 at most; the factor is set so that the expected sample is
    ``keep_tokens`` of all tokens. The draw is a hash of id and seed: the same
    for the same id, whatever the partitions. Null source or language is a value
    of its own. Documents without words have weight in their cell like others.
    Repeated ids draw alike, and so do all rows of null id. Columns of the new
    names are replaced, others stay. No documents, no rows. ``drop`` names columns
    to leave out of the result. Margins that can't be met give a warning; margins()
    lists what was reached. Topics, as all else, are learned from whole texts of
    all rows; the rounds read their hashed vectors, which are stored once.

    Cells are summed before the shuffle, so a source with a third of all rows
    costs a row for each of its cells and tasks.
    """
    new, own = ("n_tokens", "topic", "weight", "prob", "sampled"), (doc, text, source, lang)
    docs, back = aside(docs.drop(*[c for c in docs.columns if c.lower() in new or c in drop and c not in own]), *own)
    described = stored(vectors(docs, text, rules).drop(*[c for c in drop if c in own]))
    topic = F.arrow_udf(learn_topics(described, rules).of, "string")
    keyed = described.withColumns({"topic": topic("_at", "_n"), "_s": cell(source), "_l": cell(lang)}).drop("_at", "_n")
    cells = keyed.groupBy(F.col("_s").alias("source"), F.col("_l").alias("lang"), F.concat(F.lit("="), "topic").alias("topic"))
    cells = checkpointed(cells.agg(F.sum("n_tokens").alias("tokens")))
    found = stored(calibrate(cells, rules).select(*[F.col(a).alias(f"_{a}") for a in AXES], "weight", "prob"))
    joined = keyed.join(found, (F.col("_s") == F.col("_source")) & (F.col("_l") == F.col("_lang")) & (F.concat(F.lit("="), "topic") == F.col("_topic")), "left")
    draw = F.xxhash64(F.col(doc).cast("string"), F.lit(rules.seed)).cast("double") / F.lit(float(2**64)) + 0.5
    return back(joined.withColumn("sampled", draw < F.col("prob")).select(*[c for c in keyed.columns if c not in ("_s", "_l")], "weight", "prob", "sampled"))
