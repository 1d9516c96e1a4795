"""A hidden Markov language model over words: Baum-Welch counts summed across partitions, exact scaled scoring."""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from cloakframe.llm.common import discard, drawn_texts, stored, text_bytes

#: The hash that stands for the end of a text; no word is empty.
END_HASH = xxhash.xxh64_intdigest(b"") - (1 << 64) if xxhash.xxh64_intdigest(b"") >> 63 else xxhash.xxh64_intdigest(b"")


@dataclass(frozen=True)
class HmmRules:
    states: int = 8
    #: Each state emits words of so many tokens by themselves; the others share one symbol.
    own_count: int = 3
    #: Most frequent words, at most, whose counts and emissions go to every task; the others' are joined.
    own_words: int = 1 << 17
    #: Distinct training texts, at most, that the first weights are fitted to before the whole corpus is, and how many
    #: characters of each, from a place that its hash chooses.
    sample: int = 1500
    sample_chars: int = 20_000
    sample_rounds: int = 12
    corpus_rounds: int = 2
    #: Least weight of the corpus' word shares in a state's, in tokens; else it is the number of words the state emits.
    prior: float = 100.0
    stickiness: float = 0.95
    cells: int = 200_000
    #: Texts go through the model in chunks of so many tokens, or one longer text.
    chunk_tokens: int = 500_000
    seed: int = 3


def text_words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, with A-Z lower-cased."""
    return text_bytes(text).lower().split()


def word_hashes(words: Collection[bytes]) -> np.ndarray:
    """Signed hashes of words; the empty one's is END_HASH."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c) of all tokens of the texts (text), one end a text included; summed in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word_hashes(seen)), pa.array(list(seen.values()), pa.int64())], ["h", "c"])

        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(text_words(value.as_py()))
                seen[b""] += 1
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


#: The place of a word that is not looked up yet.
NEW = np.iinfo(np.int32).max


class Places(dict):
    """Places of words met among the broadcast words; as many entries as there are broadcast words, but for rare collisions."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' places, and the hashes of those outside the table: the j-th to come is at -1 - j. Words not met before are looked up together."""
        at = np.fromiter(map(self.get, words, repeat(NEW)), np.int32, len(words))
        gaps = np.flatnonzero(at == NEW)
        met = [words[i] for i in gaps.tolist()]
        new = list(dict.fromkeys(met))
        h = word_hashes(new)
        if len(self.hashes):
            near = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known, place = self.hashes[near] == h, self.order[near]
        else:
            known, place = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        found = dict(zip(new, np.where(known, place, -np.cumsum(~known)).tolist(), strict=True))
        at[gaps] = np.fromiter(map(found.__getitem__, met), np.int32, len(met))
        self.update((w, i) for w, i in found.items() if i >= 0)
        return at, h[~known]


@dataclass
class Vocabulary:
    """The broadcast words, by falling count, and sums over all words of the corpus.

    Symbols are the places of broadcast words of ``own_count`` tokens, then one
    for rare words and one for the end. While the model is fitted, words outside
    the table are rare too: they are tied until the last round's counts.
    """

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    ends: int
    own_count: int
    #: Words and tokens of all own words, those of the joined table too.
    owned: int
    own_tokens: int

    @property
    def rare(self) -> int:
        """The number of own words in the broadcast table; also the rare symbol."""
        return int((self.counts >= self.own_count).sum())

    @property
    def symbols(self) -> int:
        return self.rare + 2

    def shares(self, tied: bool) -> np.ndarray:
        """The corpus' share of each symbol, none of them 0; untied, they and ``joined_share`` sum to 1."""
        own = int(self.counts[: self.rare].sum()) if tied else self.own_tokens
        return np.r_[self.counts[: self.rare], self.tokens - self.ends - own + 1, self.ends + 1] / self.total

    @property
    def total(self) -> float:
        return float(self.tokens + 2)

    @property
    def joined_share(self) -> float:
        """The share of all own words outside the broadcast table."""
        return (self.own_tokens - int(self.counts[: self.rare].sum())) / self.total

    def rare_total(self) -> float:
        """The denominator of a word's share of the rare symbol: its tokens and types, and one unknown."""
        return float(self.tokens - self.ends - self.own_tokens + max(0, self.types - (self.ends > 0) - self.owned) + 1)

    def outside(self) -> Column:
        """Whether a word (h, c) is outside the broadcast table."""
        word = F.col("h") != END_HASH
        if not len(self.counts):
            return word
        c, h = int(self.counts[-1]), int(self.hashes[-1])
        return word & ((F.col("c") < c) | ((F.col("c") == c) & (F.col("h") > h)))


def sequences(symbols: np.ndarray, sizes: np.ndarray, end: int) -> list[np.ndarray]:
    """The symbols of texts, each with its end."""
    ends = np.cumsum(sizes)
    return np.split(np.insert(symbols, ends, end), (ends + np.arange(1, len(sizes) + 1))[:-1])


def symbols_of(at: np.ndarray, rare: int, base: int | None = None) -> np.ndarray:
    """The symbols of places; words apart are numbered from base, or rare without one."""
    symbols = np.minimum(at, rare).astype(np.int64)
    return np.where(symbols < 0, rare if base is None else base - 1 - symbols, symbols)


# --- the model --------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (symbols, states)
    #: A joined word of n expected tokens and a share of the corpus emits (n + weight * share) / total.
    weight: np.ndarray | float = 1.0
    total: np.ndarray | float = 1.0


def packs(rows: list[np.ndarray], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of ``cells`` symbols together, or one longer, longest first: their numbers, the symbols step by step, and the rows alive at each step."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths[order])
    at = 0
    while at < len(order):
        last = int(np.searchsorted(ends, cells + (ends[at - 1] if at else 0), side="right"))
        part = order[at : max(at + 1, last)]
        at += len(part)
        sizes = lengths[part]
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        steps = np.empty(len(step), np.int64)
        steps[(np.cumsum(alive) - alive)[step] + np.repeat(np.arange(len(part)), sizes)] = np.concatenate([rows[i] for i in part])
        yield part, steps, alive


#: Forward sums of 64 bits are scaled in every so many steps: even if each multiplied them by 1e-30, they would not vanish.
SCALED = 8


def forward(steps: np.ndarray, alive: np.ndarray, model: Model):
    """Natural log-likelihood of each sequence by the scaled forward recursion; then, as for the steps of ``packs``, the
    states' sums and the emissions with their scales in them, and each sequence's last place and sum."""
    total, ones = np.zeros(alive[0]), np.ones(len(model.start))
    emit = np.take(model.emit, steps, axis=0)
    states = np.empty_like(emit)
    a = np.multiply(model.start, emit[: alive[0]], out=states[: alive[0]])
    at = int(alive[0])
    for t, n in enumerate(alive[1:].tolist(), 1):
        b, e = states[at : at + n], emit[at : at + n]
        np.dot(a[:n], model.move, out=b)
        b *= e
        if t % SCALED == 0:
            scale = b @ ones
            total[:n] += np.log(scale)
            b /= scale[:, None]
            e /= scale[:, None]
        a = b
        at += n
    sizes = np.searchsorted(-alive, -np.arange(alive[0]), side="left")
    last = (np.cumsum(alive) - alive)[sizes - 1] + np.arange(alive[0])
    ends = states[last] @ ones
    return total + np.log(ends), states, emit, last, ends


class Counts:
    """Expected counts of the Baum-Welch step."""

    def __init__(self, symbols: int, states: int):
        self.start, self.move = np.zeros(states), np.zeros((states, states))
        self.emit = np.zeros((symbols, states))

    def add(self, rows: list[np.ndarray], model: Model, cells: int, tied: int = 0) -> None:
        """Symbols beyond the model's are emitted as the tied one is, but counted by themselves."""
        for _, own, alive in packs(rows, cells):
            steps = np.where(own < len(model.emit), own, tied) if len(self.emit) > len(model.emit) else own
            posteriors = self.passed(steps, alive, model)
            for k in range(self.emit.shape[1]):
                self.emit[:, k] += np.bincount(own, posteriors[k], len(self.emit))
            del posteriors  # before the next pack's

    def passed(self, steps: np.ndarray, alive: np.ndarray, model: Model) -> np.ndarray:
        """The posteriors of a pack's steps, by state; starts and moves are added."""
        _, states, ahead, last, ends = forward(steps, alive, model)
        # As the emissions have the scales in them, a state's sum times its beta is its posterior.
        beta, back = np.empty_like(states), np.ascontiguousarray(model.move.T)
        beta[last] = 1 / ends[:, None]
        to, counts = len(states), alive.tolist()
        for t in range(len(counts) - 1, 0, -1):
            at = to - counts[t]
            w = ahead[at:to]
            w *= beta[at:to]
            np.dot(w, back, out=beta[at - counts[t - 1] : at - counts[t - 1] + counts[t]])
            to = at
        first = counts[0]
        beta *= states
        self.start += beta[:first].sum(axis=0)
        before = np.arange(first, len(states)) - np.repeat(alive[:-1], alive[1:])
        for i in range(0, len(before), 1 << 15):
            part = before[i : i + (1 << 15)]
            self.move += np.take(states, part, axis=0).T @ ahead[first + i : first + i + len(part)] * model.move
        del states, ahead
        return np.ascontiguousarray(beta.T)

    def model(self, shares: np.ndarray, rules: HmmRules, joined: tuple = (0.0, 0.0, 0.0)) -> Model:
        """The next weights; ``joined`` has the joined words' counts, these up to 1 each, and their share of the corpus."""
        n, most_one, share = joined
        weight = np.maximum(rules.prior, np.minimum(1, self.emit).sum(axis=0) + most_one)
        emit = self.emit + weight * shares[:, None]
        start, move, total = self.start + 0.1, self.move + 0.1, emit.sum(axis=0) + n + weight * share
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / total, weight, total)


def first_model(rows: list[np.ndarray], shares: np.ndarray, rules: HmmRules) -> Model:
    """Weights from a sample: one state for each of the texts that are least like each other, then rounds of Baum-Welch."""
    k = rules.states
    rng = np.random.default_rng(rules.seed)
    emit = shares[:, None] * rng.uniform(0.7, 1.3, (len(shares), k))
    bags = [np.unique(r[:-1], return_counts=True) for r in rows]
    long = sorted((i for i in range(len(rows)) if len(bags[i][0]) >= 30), key=lambda i: (-len(bags[i][0]), i))[:300]
    if long:
        weight = -np.log(shares)
        sets = [dict(zip(bags[i][0].tolist(), weight[bags[i][0]], strict=True)) for i in long]

        def alike(a: dict, b: dict) -> float:
            return sum(w for s, w in a.items() if s in b) / min(sum(a.values()), sum(b.values()))

        seeds, nearest = [0], np.array([alike(sets[0], s) for s in sets])
        while len(seeds) < min(k, len(long)):
            seeds.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, [alike(sets[seeds[-1]], s) for s in sets])
        for state, seed in enumerate(seeds):
            symbols, n = bags[long[seed]]
            np.add.at(emit[:, state], symbols, n / n.sum())
    move = np.full((k, k), (1 - rules.stickiness) / max(1, k - 1))
    np.fill_diagonal(move, rules.stickiness if k > 1 else 1.0)
    model = Model(np.full(k, 1 / k), move, emit / emit.sum(axis=0))
    for _ in range(rules.sample_rounds if rows else 0):
        counts = Counts(len(shares), k)
        counts.add(rows, model, rules.cells)
        model = counts.model(shares, rules)
    return model


def encoded(docs: DataFrame, text: str, vocabulary: Vocabulary, rules: HmmRules, training: Column | None = None) -> DataFrame:
    """(_chunk, _docs, _learn, _sizes, _at, _apart): chunks of texts as places, with the other columns and the hashes of words apart.

    A chunk looks up each word apart once, however many of its texts have it.
    The places are 32-bit numbers, compressed. _learn says which texts are learned from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.hashes)
    others = [f for f in docs.schema.fields if f.name != text]
    names = [text, *[f.name for f in others]]
    row = "_".join(["row", *names])  # no column has this name
    learned_from = F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    docs = docs.select(*names, F.monotonically_increasing_id(), learned_from)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(shared.value)

        def chunk(batch: pa.RecordBatch, start: int, sizes: list[int], words: list[bytes]) -> pa.RecordBatch:
            columns = [c.slice(start, len(sizes)) for c in batch.columns]
            whole = pa.StructArray.from_arrays(columns[1:-1], [*names[1:], row])
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            at, hashes = places.of(words)
            at = pa.compress(at.tobytes(), "zstd", asbytes=True)
            made = [columns[-2].slice(0, 1), one(whole), one(columns[-1]), one(pa.array(sizes, pa.int64())), pa.array([at], pa.binary()), one(pa.array(hashes))]
            return pa.RecordBatch.from_arrays(made, ["_chunk", "_docs", "_learn", "_sizes", "_at", "_apart"])

        for batch in batches:
            start, sizes, words = 0, [], []
            for i, value in enumerate(batch.column(0)):
                had = len(words)
                words += text_words(value.as_py())
                sizes.append(len(words) - had)
                if len(words) >= rules.chunk_tokens or i == batch.num_rows - 1:
                    yield chunk(batch, start, sizes, words)
                    start, sizes, words = i + 1, [], []

    kept = StructType([*others, StructField(row, LongType())])
    schema = StructType([StructField("_chunk", LongType()), StructField("_docs", ArrayType(kept))])
    schema = StructType(schema.fields + StructType.fromDDL("_learn array<boolean>, _sizes array<long>, _at binary, _apart array<long>").fields)
    return stored(docs.mapInArrow(read, schema))


def unpacked(at: bytes, sizes: np.ndarray) -> np.ndarray:
    return np.frombuffer(pa.decompress(at, int(sizes.sum()) * 4, "zstd", asbytes=True), np.int32)


def state_names(rules: HmmRules) -> list[str]:
    return [f"s{i}" for i in range(rules.states)]


#: Expected counts travel as whole numbers of this part of a token, so that they take few bytes and sum alike in any order.
UNIT = 256.0


def corpus_counts(rows: DataFrame, model: Model, vocabulary: Vocabulary, rules: HmmRules, last: bool) -> tuple[Counts, DataFrame]:
    """The Baum-Welch counts of all encoded training texts, summed by symbol in the shuffle; and, of the last round, (h, s0, ...) of words apart.

    Words outside the broadcast table are emitted as the rare symbol is. The
    last round counts them one by one, so that each can have emissions of its own.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model, vocabulary.rare))
    names = state_names(rules)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rare = shared.value
        base = len(model.emit)

        def out(apart: bool, row: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
            whole = np.rint(table * UNIT).astype(np.int64)
            used = np.flatnonzero(whole.any(axis=1))
            columns = [pa.array(whole[used, i]) for i in range(rules.states)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(used), apart)), pa.array(row[used]), *columns], ["apart", "row", *names])

        total = Counts(base, rules.states)
        for batch in batches:
            for learn, sizes, at, hashes in zip(*batch.columns, strict=True):
                sizes, hashes = sizes.values.to_numpy(), hashes.values.to_numpy()
                learn = np.asarray(learn.values).astype(bool)
                places = unpacked(at.as_py(), sizes)
                if not learn.all():
                    places, sizes = places[np.repeat(learn, sizes)], sizes[learn]
                if not len(sizes):
                    continue
                n = len(hashes) if last else 0
                counts = Counts(base + n, rules.states)
                counts.add(sequences(symbols_of(places, rare, base if last else None), sizes, rare + 1), model, rules.cells, rare)
                total.start += counts.start
                total.move += counts.move
                total.emit += counts.emit[:base]
                if n:
                    yield out(True, hashes, counts.emit[base:])
        # Rows -1 to -states - 1 hold the starts and the moves.
        yield out(False, np.r_[np.arange(base), -1 - np.arange(rules.states + 1)], np.vstack([total.emit, total.start, total.move]))

    schema = "apart boolean, row long, " + ", ".join(f"{n} long" for n in names)
    summed = rows.select("_learn", "_sizes", "_at", "_apart").mapInArrow(count, schema).groupBy("apart", "row").agg(*[F.sum(n).alias(n) for n in names])
    summed = stored(summed)
    parts = summed.select("apart", "row", *[(F.col(n) / UNIT).alias(n) for n in names])
    sums = parts.where(~F.col("apart")).toPandas()  # of the broadcast symbols, as bounded as they are
    counts = Counts(vocabulary.symbols, rules.states)
    for row, value in zip(sums["row"].to_numpy(), sums[names].to_numpy(), strict=True):
        if row >= 0:
            counts.emit[row] = value
        elif row == -1:
            counts.start = value
        else:
            counts.move[-row - 2] = value
    return counts, parts.where("apart").select(F.col("row").alias("h"), *names)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, ``most`` of them or fewer: whole classes of like counts, so that no task sorts all.

    A class spans half a per cent; their sizes, a few thousand numbers at any
    corpus size, decide which fit.
    """
    classed = counts.where(F.col("h") != END_HASH).withColumn("k", F.floor(F.log("c") * 200))
    left, cut = most, None
    for r in sorted(classed.groupBy("k").count().collect(), key=lambda r: -r.k):
        if r["count"] > left:
            break
        left, cut = left - r["count"], r.k
    return classed.where(F.lit(False) if cut is None else F.col("k") >= cut).select("h", "c")


def untied(counts: DataFrame, sums: DataFrame, found: Counts, vocabulary: Vocabulary, rules: HmmRules) -> tuple[Model, DataFrame]:
    """The model in which each own word outside the broadcast table emits by itself, and (h, c, e): these words' emissions.

    e has a 32-bit number for each state; it is null for words that are rare.
    """
    names = state_names(rules)
    words = counts.where(vocabulary.outside()).join(sums, "h", "left").fillna(0.0, names)
    words = stored(words.withColumn("own", F.col("c") >= rules.own_count))
    one = [F.sum(F.when(F.col("own"), F.least(F.lit(1.0), n))) for n in names]
    totals = words.agg(*[F.sum(F.when(F.col("own"), F.col(n))) for n in names], *one, *[F.sum(F.when(~F.col("own"), F.col(n))) for n in names]).first()
    n, most_one, rare = np.array([x or 0.0 for x in totals]).reshape(3, -1)
    found.emit[vocabulary.rare] += rare
    model = found.model(vocabulary.shares(False), rules, (n, most_one, vocabulary.joined_share))
    weight, total = model.weight / vocabulary.total, model.total

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, own, *sums = batch.columns
            made = np.column_stack([x.to_numpy() for x in sums]) + weight * c.to_numpy()[:, None]
            made = (made / total).astype("<f4").tobytes()
            size = 4 * rules.states
            e = [made[i * size : (i + 1) * size] if x else None for i, x in enumerate(own.to_pylist())]
            yield pa.RecordBatch.from_arrays([h, c, pa.array(e, pa.binary())], ["h", "c", "e"])

    table = stored(words.select("h", "c", "own", *names).mapInArrow(emit, "h long, c long, e binary"))
    discard(words)
    return model, table


def count_corpus(docs: DataFrame, rules: HmmRules) -> tuple[DataFrame, Vocabulary]:
    """The stored counts (h, c) of all words of the texts (text), and the vocabulary."""
    counts = stored(count_words(docs))
    own = (F.col("h") != END_HASH) & (F.col("c") >= rules.own_count)
    totals = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("h") == END_HASH, F.col("c"))), F.count(F.when(own, 1)), F.sum(F.when(own, F.col("c")))).first()
    tokens, types, ends, owned, own_tokens = (int(x or 0) for x in totals)
    top = most_frequent(counts, rules.own_words).toPandas().sort_values(["c", "h"], ascending=[False, True])
    return counts, Vocabulary(top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64), tokens, types, ends, rules.own_count, owned, own_tokens)


def fit(docs: DataFrame, chunks: DataFrame, counts: DataFrame, vocabulary: Vocabulary, rules: HmmRules) -> tuple[Model, DataFrame]:
    """The model and the words outside the broadcast table, from the training texts (text) and all texts' chunks."""
    if rules.corpus_rounds < 1:
        raise ValueError("at least one round over the corpus parts the words outside the broadcast table")
    places = Places(vocabulary.hashes)
    sample = sorted(r.text or "" for r in drawn_texts(docs, "text", rules.sample, rules.sample_chars).collect())
    symbols = [symbols_of(places.of(text_words(x))[0], vocabulary.rare) for x in sample]
    tied = vocabulary.shares(True)
    model = first_model([np.r_[x, vocabulary.rare + 1] for x in symbols], tied, rules)
    for left in range(rules.corpus_rounds - 1, -1, -1):
        found, sums = corpus_counts(chunks, model, vocabulary, rules, not left)
        model = found.model(tied, rules)
    return untied(counts, sums, found, vocabulary, rules)


def learn(docs: DataFrame, text: str = "text", rules: HmmRules = HmmRules()) -> tuple[Model, Vocabulary, DataFrame]:
    """The model, its vocabulary, and the stored words (h, c, e) outside the broadcast table, with their emissions.

    All texts count: words, then ``corpus_rounds`` of Baum-Welch. Every word of
    ``own_count`` tokens gets its own emissions: those of the most frequent words
    are broadcast and fitted in all rounds; the others are tied to one symbol
    until the last round, whose counts by word and state part them. They are a
    table that grows with the corpus and is joined by word. Only the first
    weights come from a sample of distinct texts, chosen by their hashes.
    """
    docs = docs.select(F.col(text).alias("text"))
    counts, vocabulary = count_corpus(docs, rules)
    chunks = encoded(docs, "text", vocabulary, rules)
    model, words = fit(docs, chunks, counts, vocabulary, rules)
    discard(chunks)
    return model, vocabulary, words


def learn_and_score(docs: DataFrame, training: Column, text: str = "text", rules: HmmRules = HmmRules()) -> DataFrame:
    """All documents scored (see score) by a model of those for which ``training`` holds (see learn); texts are encoded once."""
    docs = unscored(docs)
    own = docs.where(training).select(F.col(text).alias("text"))
    counts, vocabulary = count_corpus(own, rules)
    chunks = encoded(docs, text, vocabulary, rules, training)
    model, words = fit(own, chunks, counts, vocabulary, rules)
    return judged(docs, chunks, (model, vocabulary, words), text, rules)


def unscored(docs: DataFrame) -> DataFrame:
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return docs.drop(*[c for c in docs.columns if c.lower() in new])


def score(docs: DataFrame, learned: tuple[Model, Vocabulary, DataFrame], text: str = "text", rules: HmmRules = HmmRules()) -> DataFrame:
    """Documents with n_tokens, n_known, train_tokens, base_score and score; the text column goes.

    score is the model's log10 probability of the words and the end: the forward
    likelihood of the symbols, and each rare word's share of the rare symbol.
    base_score is the smoothed unigram one. Null text is an end alone. Counts and
    emissions of words outside the broadcast table come from an exact join on
    64-bit hashes, once for each chunk of texts. Columns of the new names are
    replaced; rows are kept as they are, repeated ones too; no documents, no rows.
    """
    docs = unscored(docs)
    return judged(docs, encoded(docs, text, learned[1], rules), learned, text, rules)


def judged(docs: DataFrame, chunks: DataFrame, learned: tuple[Model, Vocabulary, DataFrame], text: str, rules: HmmRules) -> DataFrame:
    model, vocabulary, words = learned
    shared = docs.sparkSession.sparkContext.broadcast((model, vocabulary))
    others = [f for f in docs.schema.fields if f.name != text]
    base_total, rare_total = float(vocabulary.tokens + vocabulary.types + 1), vocabulary.rare_total()
    looked = chunks.select(F.col("_chunk").alias("_of"), F.posexplode("_apart").alias("j", "h")).join(words, "h").select("_of", "j", "c", "e")
    schema = StructType(others + StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double").fields)

    def judge(texts: pa.Table, looked: pa.Table) -> pa.Table:
        model, vocabulary = shared.value
        rare, base = vocabulary.rare, len(model.emit)
        sizes = texts.column("_sizes").combine_chunks().flatten().to_numpy()
        at = unpacked(texts.column("_at")[0].as_py(), sizes)
        # Words apart: their counts, and emissions in rows after those of the broadcast symbols.
        n = int(max(0, -at.min(initial=0)))
        j, c, e = looked.column("j").to_numpy(), np.zeros(n, np.int64), looked.column("e")
        c[j] = looked.column("c").to_numpy()
        has = np.asarray(e.is_valid())
        emit = np.frombuffer(b"".join(e.drop_null().to_pylist()), "<f4").reshape(-1, rules.states).astype(float)
        number = np.full(n, rare)
        number[j[has]] = base + np.arange(len(emit))
        # Tables by place; the j-th word apart is at -1 - j.
        count = np.r_[vocabulary.counts, c[::-1]]
        symbol = np.r_[np.minimum(np.arange(len(vocabulary.counts)), rare), number[::-1]]
        base_share, rare_share = np.log10((count + 1) / base_total), np.where(symbol == rare, np.log10((count + 1) / rare_total), 0.0)
        row = np.repeat(np.arange(len(sizes)), sizes)
        summed = lambda x: np.bincount(row, x[at], len(sizes)).astype(float)
        scores = summed(rare_share)
        local = Model(model.start, model.move, np.vstack([model.emit, emit]))
        for part, steps, alive in packs(sequences(symbol[at], sizes, rare + 1), rules.cells):
            scores[part] += forward(steps, alive, local)[0] / np.log(10)
        end = np.log10((vocabulary.ends + 1) / base_total)
        made = [sizes + 1, summed(count > 0).astype(np.int64) + (vocabulary.ends > 0), np.full(len(sizes), vocabulary.tokens), summed(base_share) + end, scores]
        columns = texts.column("_docs").combine_chunks().flatten().flatten()[:-1]
        return pa.Table.from_arrays([*columns, *map(pa.array, made)], schema.names)

    return chunks.drop("_apart", "_learn").groupBy("_chunk").cogroup(looked.groupBy("_of")).applyInArrow(judge, schema)
