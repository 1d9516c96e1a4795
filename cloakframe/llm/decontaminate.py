"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import aside, checkpointed, stored, text_bytes

WORD = re.compile(r"\w+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class AlignmentRules:
    #: Words of a seed.
    gram: int = 4
    #: Items are aligned in segments of this many words, each half over the last one.
    segment: int = 64
    #: Items of fewer words can't be told from chance when they are edited: they match verbatim only.
    min_words: int = 8
    #: A seed is rare if its document count is at most this many times the median of its segment's seeds that documents
    #: hold, or FEW. Pairs that only other seeds link are aligned where enough of the segment's words are in the passage.
    rare_factor: float = 4.0
    few: int = 8
    match: int = 2
    miss: int = -1
    gap: int = -1
    #: Share of the score of a whole verbatim segment.
    min_score: float = 0.5
    #: Benchmarks with more distinct words than this take joins instead of a broadcast vocabulary.
    broadcast_words: int = 500_000
    #: The same for more distinct seeds, of 8 bytes each.
    broadcast_codes: int = 4_000_000


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(text_bytes(word), 7) or 1


def gram_codes(hashes: np.ndarray, gram: int) -> np.ndarray:
    """A code for the words from each position; 0 where one of them is unknown (hash 0)."""
    size = len(hashes) - gram + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    code, known = np.zeros(size, np.uint64), np.ones(size, bool)
    with np.errstate(over="ignore"):
        for i in range(gram):
            part = hashes[i : i + size]
            code = (code ^ part) * FACTOR
            code ^= code >> np.uint64(31)
            known &= part != 0
    return np.where(known, code | np.uint64(1), np.uint64(0))


def item_segments(items: DataFrame, item: str, text: str, rules: AlignmentRules) -> DataFrame:
    """(item, seg, body, codes): the distinct segments of the items, with a hash to name them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bodies, codes = [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                ws = tokens(value)
                if len(ws) < rules.min_words:
                    continue
                last = max(0, len(ws) - rules.segment)
                for start in sorted({*range(0, last, rules.segment // 2), last}):
                    part = ws[start : start + rules.segment]
                    rows.append(row)
                    bodies.append(" ".join(part))
                    codes.append(np.unique(gram_codes(np.array([word_hash(w) for w in part], np.uint64), rules.gram)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(bodies, pa.string()), pa.array(codes, pa.list_(pa.int64()))], ["item", "body", "codes"])

    items = items.select(F.col(item).alias("item"), F.col(text).alias("text"))
    made = items.mapInArrow(cut, f"item {items.schema['item'].dataType.simpleString()}, body string, codes array<long>")
    return made.withColumn("seg", F.xxhash64("body")).select("item", "seg", "body", "codes").distinct()


class Seeds:
    """The codes to look for, and the hashes of their words if these are bounded."""

    def __init__(self, spark, codes: np.ndarray, vocabulary: dict[str, int]):
        self.data = spark.sparkContext.broadcast((np.sort(codes.astype(np.int64).view(np.uint64)), vocabulary))

    def hits(self, words: list[str], gram: int) -> tuple[np.ndarray, np.ndarray]:
        """The positions in the words, and their codes."""
        wanted, vocabulary = self.data.value
        get = vocabulary.get
        codes = gram_codes(np.array([get(w, 0) for w in words], np.uint64), gram)
        return held(codes, np.flatnonzero(codes), wanted)


def held(codes: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(wanted):
        at = at[:0]
    found = codes[at]
    same = wanted[np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)] == found if len(at) else np.zeros(0, bool)
    return at[same], found[same]


def all_hits(words: list[str], gram: int, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    codes = gram_codes(np.array([word_hash(w) for w in words], np.uint64), gram)
    at = np.arange(len(codes))
    return (at, codes) if wanted is None else held(codes, at, wanted)


def seed_rows(docs: DataFrame, seeds: Seeds | None, rules: AlignmentRules) -> DataFrame:
    """(doc, code) for the distinct seeds of each document; all its n-grams where seeds is None."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for row, value in enumerate(batch.column(1)):
                ws = tokens(value.as_py())
                found = np.unique((seeds.hits(ws, rules.gram) if seeds else all_hits(ws, rules.gram, None))[1])
                if len(found):
                    rows.append(np.full(len(found), row))
                    codes.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(codes).view(np.int64))], ["doc", "code"])

    return docs.mapInArrow(find, f"doc {docs.schema['doc'].dataType.simpleString()}, code long")


def passages(docs: DataFrame, seeds: Seeds | None, rules: AlignmentRules) -> DataFrame:
    """(doc, start, body, codes): the stretches of documents around their seeds, a segment wide on both sides.

    Without broadcast seeds, the documents bring a column of their own codes.
    """
    margin, gram = rules.segment, rules.gram

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, bodies, codes = [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ws = tokens(value.as_py())
                if seeds:
                    at, found = seeds.hits(ws, gram)
                else:
                    at, found = all_hits(ws, gram, np.sort(np.array(batch.column(2)[row].as_py(), np.int64).view(np.uint64)))
                if not len(at):
                    continue
                breaks = np.flatnonzero(np.diff(at) > margin) + 1
                for a, b in zip(np.r_[0, breaks], np.r_[breaks, len(at)], strict=True):
                    start = max(0, int(at[a]) - margin)
                    rows.append(row)
                    starts.append(start)
                    bodies.append(" ".join(ws[start : int(at[b - 1]) + gram + margin]))
                    codes.append(np.unique(found[a:b]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(bodies, pa.string()), pa.array(codes, pa.list_(pa.int64()))],
                ["doc", "start", "body", "codes"],
            )

    return docs.mapInArrow(cut, f"doc {docs.schema['doc'].dataType.simpleString()}, start long, body string, codes array<long>")


def short_items(items: DataFrame, item: str, text: str, rules: AlignmentRules) -> DataFrame:
    """(item, code, size, body): the items that have words, but fewer than ``min_words``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [tokens(v) for v in batch.column(1).to_pylist()]
            rows = [i for i, ws in enumerate(said) if 0 < len(ws) < rules.min_words]
            codes = np.concatenate([np.zeros(0, np.uint64), *[gram_codes(np.array([word_hash(w) for w in said[i]], np.uint64), len(said[i])) for i in rows]])
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(codes.view(np.int64)), pa.array([len(said[i]) for i in rows], pa.int32()), pa.array([" ".join(said[i]) for i in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "code", "size", "body"])

    items = items.select(F.col(item).alias("item"), F.col(text).alias("text"))
    return items.mapInArrow(read, f"item {items.schema['item'].dataType.simpleString()}, code long, size int, body string")


def verbatim(docs: DataFrame, short: DataFrame, rules: AlignmentRules) -> DataFrame:
    """(item, doc, score, end_word) of short items: ``gram`` words or more in a row, or, of fewer, as the whole text."""
    sizes = sorted(r["size"] for r in short.select("size").distinct().collect())
    bodies = short.select("body").distinct()
    small = bodies.limit(rules.broadcast_words + 1).count() <= rules.broadcast_words
    rows = bodies.collect() if small else []
    wanted = docs.sparkSession.sparkContext.broadcast(({w: word_hash(w) for r in rows for w in r.body.split(" ")}, {r.body for r in rows}))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bodies = wanted.value
        for batch in batches:
            rows, codes, made, ends = [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ws = tokens(value.as_py())
                hashes = np.array([known.get(w, 0) if small else word_hash(w) for w in ws], np.uint64)
                for size in sizes:
                    if size < rules.gram and size != len(ws):
                        continue
                    found = gram_codes(hashes, size)
                    for i in np.flatnonzero(found).tolist():
                        body = " ".join(ws[i : i + size])
                        if not small or body in bodies:
                            rows.append(row)
                            codes.append(found[i])
                            made.append(body)
                            ends.append(i + size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(np.array(codes, np.uint64).view(np.int64)), pa.array(made, pa.string()), pa.array(ends, pa.int64())], ["doc", "code", "body", "end_word"])

    held = docs.mapInArrow(find, f"doc {docs.schema['doc'].dataType.simpleString()}, code long, body string, end_word long")
    return held.join(short, ["code", "body"]).select("item", "doc", F.lit(1.0).alias("score"), "end_word")


def smith_waterman(segments: np.ndarray, bodies: np.ndarray, rules: AlignmentRules) -> tuple[np.ndarray, np.ndarray]:
    """The best local alignment score of each pair of rows, and the body position at which it ends.

    Rows are word numbers, padded with -1 (segments) and -2 (bodies). Gaps along
    the body are carried by a running maximum, so each segment word is one step.
    """
    count, width = bodies.shape
    along = np.arange(width + 1, dtype=np.int32) * -rules.gap
    h = np.zeros((count, width + 1), np.int32)
    best, ends = np.zeros(count, np.int32), np.zeros(count, np.int64)
    for i in range(segments.shape[1]):
        step = np.where(bodies == segments[:, i : i + 1], np.int32(rules.match), np.int32(rules.miss))
        new = np.zeros_like(h)
        np.maximum(h[:, :-1] + step, h[:, 1:] + np.int32(rules.gap), out=new[:, 1:])
        np.maximum(new, 0, out=new)
        h = np.maximum.accumulate(new + along, axis=1) - along
        at = h.argmax(axis=1)
        top = h[np.arange(count), at]
        better = top > best
        best[better], ends[better] = top[better], at[better]
    return best, ends


def padded(rows: list[list[int]], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.int32)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def within_reach(rules: AlignmentRules) -> Column:
    """Whether the body has enough of the segment's words for min_score: a score counts matched words at most."""
    words = F.split("segment", " ")
    return F.size(F.array_except(words, F.split("body", " "))) <= F.size(words) * (1 - rules.min_score) + 1e-9


def align(pairs: DataFrame, rules: AlignmentRules) -> DataFrame:
    """Adds score and end_word to (item, doc, start, segment, body); keeps only what reaches min_score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, docs, starts = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            numbers: dict[str, int] = {}
            number = lambda text: [numbers.setdefault(w, len(numbers)) for w in text.split(" ")]
            segments = [number(x) for x in batch.column(3).to_pylist()]
            bodies = [number(x) for x in batch.column(4).to_pylist()]
            scores, ends = np.zeros(len(bodies)), np.zeros(len(bodies), np.int64)
            order = sorted(range(len(bodies)), key=lambda i: len(bodies[i]))
            while order:
                width = len(bodies[order[-1]])
                part = [order.pop() for _ in range(min(len(order), max(1, 200_000 // width)))]
                top, at = smith_waterman(padded([segments[i] for i in part], -1), padded([bodies[i] for i in part], -2), rules)
                scores[part] = top / [rules.match * len(segments[i]) for i in part]
                ends[part] = at
            keep = pa.array(np.flatnonzero(scores >= rules.min_score))
            yield pa.RecordBatch.from_arrays([items.take(keep), docs.take(keep), pa.array(scores).take(keep), pa.array(starts + ends).take(keep)], ["item", "doc", "score", "end_word"])

    types = {c: pairs.schema[c].dataType.simpleString() for c in ("item", "doc")}
    pairs = pairs.select("item", "doc", "start", "segment", "body")
    return pairs.mapInArrow(score, f"item {types['item']}, doc {types['doc']}, score double, end_word long")


def contaminated(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rules: AlignmentRules = AlignmentRules()
) -> DataFrame:
    """(doc, item, score, end_word): one row for each document and test item that it holds a copy of.

    Words are runs of letters, digits and underscores in lower case, so that
    case, punctuation and layout don't matter. score is the best alignment's
    share of what a verbatim copy of the item's segment scores; 1 is verbatim,
    and min_score lets about a third of the words differ. end_word is where the
    alignment ends in the document's words. Items of fewer than min_words words
    match verbatim only, and those of fewer than ``gram`` words only where they
    are the whole text: one word is no benchmark passage. Null items and those
    without words match nothing; repeated items give a row for each item id.
    Rows of one doc id, or of null id, are one document. Very long texts are read
    whole; only the passages around seeds are kept. Empty tables, no rows.

    The corpus is read twice: to count the documents of each seed, and to cut
    out the passages around seeds. A seed is rare beside the other seeds of its
    own segment. Pairs linked by a rare seed are aligned; those linked by common
    seeds alone first pass an exact bound on the words they share, so no count
    of copies hides a copy. One without ``gram`` words in a row of its item has
    no seed and isn't found. A bounded vocabulary of the benchmark is broadcast;
    larger benchmarks take an exact join on n-gram codes instead.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    segments = checkpointed(item_segments(items, item, item_text, rules))
    seeds = segments.select("seg", F.explode("codes").alias("code")).distinct()
    vocabulary = segments.select(F.explode(F.split("body", " ")).alias("word")).distinct()
    small = vocabulary.limit(rules.broadcast_words + 1).count() <= rules.broadcast_words
    small = small and seeds.select("code").distinct().limit(rules.broadcast_codes + 1).count() <= rules.broadcast_codes
    known = {r.word: word_hash(r.word) for r in vocabulary.collect()} if small else {}

    def lookup(codes: DataFrame) -> Seeds | None:
        if not small:
            return None
        rows = codes.select("code").distinct().toPandas()["code"].to_numpy(np.int64)  # broadcast_codes at most
        return Seeds(spark, rows, known)

    found = seed_rows(docs, lookup(seeds), rules)
    if not small:
        found = found.join(seeds.select("code").distinct(), "code", "left_semi")
    counts = found.groupBy("code").agg(F.count(F.lit(1)).alias("docs"))
    counted = seeds.join(counts, "code").select("seg", "code", "docs")
    median = counted.groupBy("seg").agg(F.percentile("docs", 0.5).alias("median"))
    rare = (F.col("docs") <= rules.few) | (F.col("docs") <= rules.rare_factor * F.col("median"))
    held_seeds = checkpointed(counted.join(median, "seg").select("seg", "code", rare.alias("rare")))
    if small:
        around = passages(docs, lookup(held_seeds), rules)
    else:
        own = found.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("code").alias("codes"))
        around = passages(docs.join(own, docs.doc.eqNullSafe(own["_doc"])).select("doc", "text", "codes"), None, rules)
    around = stored(around.withColumn("passage", F.xxhash64("doc", "start", "body")))
    links = around.select("passage", F.explode("codes").alias("code")).join(held_seeds, "code").groupBy("passage", "seg").agg(F.bool_or("rare").alias("rare"))
    pairs = links.join(around.select("passage", "doc", "start", "body").distinct(), "passage")
    named = segments.select("seg", "item", F.col("body").alias("segment"))
    scored = align(pairs.join(named, "seg").where(F.col("rare") | within_reach(rules)), rules)
    short = checkpointed(short_items(items, item, item_text, rules))
    if not short.isEmpty():
        scored = scored.unionByName(verbatim(docs, short, rules))
    best = scored.groupBy("doc", "item").agg(F.max(F.struct("score", "end_word")).alias("best"))
    return best.select("doc", "item", "best.score", "best.end_word")


def drop_contaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The documents that hold no copy of an item, with their columns as they are, whatever their names.

    Rows of null id stay. All rows of an id go if one of them holds a copy; see contaminated for the other cases.
    """
    docs, back = aside(docs, doc, text)
    found = contaminated(docs, items, doc, text, **names).select(F.col("doc").alias("_found")).distinct()
    return back(docs.join(found, docs[doc] == found["_found"], "left_anti"))
