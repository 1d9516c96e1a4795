"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cloakframe.llm.common import SPACES, aside, remove, shared_dir, text_bytes
from cloakframe.llm.cuckoo import CuckooFilter

MIN_CHARS = 10
#: References to a shard, on average, at most: shards double as the index grows, so a task's share has a fixed size.
SHARD_REFS = 200_000
#: A key with more than this share of all references is hot. Fewer than 1 / HOT keys can be, at any size.
HOT = 1e-4


def line_digest(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """16 bytes for the key of a line; None for keys that are too short."""
    key = line.strip(SPACES)
    return blake2b(text_bytes(key).lower(), digest_size=16).digest() if len(key) >= min_chars else None


def digests(text: str | None, min_chars: int) -> list[bytes | None]:
    return [line_digest(line, min_chars) for line in (text or "").split("\n")]


def as_longs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)


def as_keys(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The two halves as 16 bytes that sort and compare whole."""
    return np.ascontiguousarray(np.column_stack([hi, lo])).astype("<i8").view("S16").ravel()


def found_in(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would be in the sorted table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def line_keys(docs: DataFrame, doc: str, text: str, min_chars: int, hot: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(doc, hi, lo, doomed) for each row's distinct keys. With the hot keys and their first documents, these are settled here."""
    shared = docs.sparkSession.sparkContext.broadcast(hot or (np.zeros(0, "S16"), np.zeros(0)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, firsts = shared.value
        for batch in batches:
            rows, keys = [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                own = set(digests(value, min_chars))
                own.discard(None)
                rows += [row] * len(own)
                keys += own
            pairs, at = as_longs(keys), np.array(rows, np.int64)
            doomed = np.zeros(len(at), bool)
            if len(table) and len(at):
                place, known = found_in(table, as_keys(pairs[:, 0], pairs[:, 1]))
                docs = batch.column(0).to_pandas().to_numpy()[at]
                doomed[known] = firsts[place[known]] < docs[known]
                stay = doomed | ~known
                pairs, at, doomed = pairs[stay], at[stay], doomed[stay]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(doomed)], ["doc", "hi", "lo", "doomed"])

    docs = docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    return docs.mapInArrow(find, f"doc {docs.schema['doc'].dataType.simpleString()}, hi long, lo long, doomed boolean")


def drop_lines(docs: DataFrame, doomed: DataFrame, doc: str, text: str, min_chars: int) -> DataFrame:
    """Documents without the lines whose keys (doc, hi, lo) are doomed; adds n_lines and n_dropped."""
    docs, back = aside(docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")]), doc, text)
    lists = doomed.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set(F.struct("hi", "lo")).alias("_doomed"))
    joined = docs.join(lists, docs[doc] == lists["_doc"], "left").drop("_doc")
    names, where = docs.columns, docs.columns.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for value, gone in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                lines = (value or "").split("\n")
                n_lines.append(len(lines))
                if gone:
                    pairs = np.array([(g["hi"], g["lo"]) for g in gone], "<i8")
                    keys = {pairs[i].tobytes() for i in range(len(pairs))}
                    lines = [x for x in lines if line_digest(x, min_chars) not in keys]
                kept.append("\n".join(lines))
                n_dropped.append(n_lines[-1] - len(lines))
            columns = batch.columns[: len(names)]
            columns[where] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return back(joined.mapInArrow(rewrite, StructType(list(docs.schema.fields)).add("n_lines", "long").add("n_dropped", "long")))


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents, each without the lines that a document of smaller id holds too.

    A line's key is the line stripped of white space with A-Z lower-cased; keys
    under ``min_chars`` code points are never dropped. A key that two ids or more
    hold stays, with all its lines, in the smallest id. Null text is one empty
    line. Rows of null id are kept as they are and don't count. Rows with the
    same id are one document. Lines are split at \\n alone and keys compared by
    128-bit digests. Adds n_lines (before) and n_dropped; input columns of these
    names are replaced, all others stay. No documents, no rows.

    The documents go into a new LineIndex and are held against it.
    """
    index = new_index(docs, doc, min_chars)
    index.insert(docs, doc, text)
    return index.dedup(docs, doc, text)


def new_index(docs: DataFrame, doc: str = "doc_id", min_chars: int = MIN_CHARS) -> LineIndex:
    """An empty index in this session's part of the shared folder."""
    spark = docs.sparkSession
    return LineIndex(spark, f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}", min_chars, docs.schema[doc].dataType.simpleString())


class LineIndex:
    """An incremental index in a shared folder: insert documents, delete them, dedup against it.

    ``postings/N`` has the (doc, hi, lo) that version N added and ``gone/N`` the
    ids that it removed. ``shards/N`` has a row for each shard: its sorted keys,
    how many postings refer to each, the smallest id that does, and a cuckoo
    filter of the keys. A version counts once ``meta/N`` is written, so a lost
    job leaves the last one whole, and the index can be opened again at any time.
    Deleting a document gives the same shards as never having inserted it.

    Keys are dealt to shards by hash, after they are counted in each task, so a
    line of every document costs a row for each task. Shards double with the
    postings; a shard's filter and table go to one task, never to all. Look-ups
    are dealt in the same way, but those of hot keys, of which there are fewer
    than 1 / HOT, are settled where the documents are read. The two last versions
    stay for readers; shards of older ones are removed.
    """

    def __init__(self, spark: SparkSession, path: str, min_chars: int = MIN_CHARS, doc_type: str = "bigint", shard_refs: int = SHARD_REFS):
        """Open the index at the path, with the rules it was made with, or begin one there."""
        self.spark, self.path, self.shard_refs = spark, path, shard_refs
        self.version = self.last_version()
        if self.version < 0:
            self.meta = {"min_chars": min_chars, "doc_type": doc_type, "shards": 1, "refs": 0, "postings": [], "gone": []}
            empty = f"shard long, keys binary, refs binary, first array<{doc_type}>, bits binary"
            spark.createDataFrame([], empty).write.mode("overwrite").parquet(f"{path}/shards/0")
            self.commit({})
        else:
            self.meta = json.loads(spark.read.text(f"{path}/meta/{self.version}").first()[0])
        self.min_chars, self.doc_type = self.meta["min_chars"], self.meta["doc_type"]

    def last_version(self) -> int:
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        where = files.Path(f"{self.path}/meta")
        system = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []
        return max((int(n) for n in names if system.exists(files.Path(f"{self.path}/meta/{n}/_SUCCESS"))), default=-1)

    def commit(self, change: dict) -> None:
        meta = {**self.meta, **change}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta/{self.version + 1}")
        self.version += 1
        self.meta = meta
        remove(self.spark, f"{self.path}/shards/{self.version - 2}")

    def state(self) -> DataFrame:
        """The shards, split as often as their number has doubled since they were written."""
        return self.spark.read.parquet(f"{self.path}/shards/{self.version}")

    def postings(self) -> DataFrame:
        """(doc, hi, lo) of the documents that the index holds."""
        schema = f"doc {self.doc_type}, hi long, lo long"
        live = self.spark.createDataFrame([], schema + ", since long")
        for v in self.meta["postings"]:
            live = live.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/postings/{v}").withColumn("since", F.lit(v).cast("long")))
        for v in self.meta["gone"]:
            gone = self.spark.read.parquet(f"{self.path}/gone/{v}").select(F.col("doc").alias("_gone"))
            live = live.join(gone, (live.doc == gone["_gone"]) & (live.since < v), "left_anti")
        return live.drop("since")

    def refs(self) -> DataFrame:
        """(hi, lo, refs, first): the exact table."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, refs, first in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                    pairs = np.frombuffer(keys.as_py(), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.frombuffer(refs.as_py(), "<i8")), first.values], ["hi", "lo", "refs", "first"])

        return self.state().select("keys", "refs", "first").mapInArrow(read, f"hi long, lo long, refs long, first {self.doc_type}")

    def insert(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> None:
        """Add documents whose ids the index doesn't hold; others are left as they are. Null ids are passed over."""
        new = line_keys(docs, doc, text, self.min_chars).drop("doomed")
        if self.meta["postings"]:
            new = new.join(self.postings().select(F.col("doc").alias("_held")).distinct(), F.col("doc") == F.col("_held"), "left_anti")
        path = f"{self.path}/postings/{self.version + 1}"
        new.write.mode("overwrite").parquet(path)
        new = self.spark.read.parquet(path)
        refs = self.meta["refs"] + new.count()

        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b for b in batches if b.num_rows):
                frame = pd.DataFrame({"doc": batch.column(0).to_pandas(), "hi": batch.column(1).to_numpy(), "lo": batch.column(2).to_numpy()})
                made = frame.groupby(["hi", "lo"], sort=False).agg(change=("doc", "size"), first=("doc", "min")).reset_index()
                yield pa.RecordBatch.from_pandas(made[["hi", "lo", "change", "first"]], preserve_index=False)

        # Counted by task first, so that a line of every document costs a row for each batch.
        delta = new.mapInArrow(combine, f"hi long, lo long, change long, first {self.doc_type}")
        self.advance(delta, refs, {"postings": [*self.meta["postings"], self.version + 1]})

    def delete(self, ids: DataFrame) -> None:
        """Remove the documents of ``ids`` (doc); ids that the index doesn't hold change nothing."""
        path = f"{self.path}/gone/{self.version + 1}"
        ids.select(F.col("doc").cast(self.doc_type).alias("doc")).dropna().distinct().write.mode("overwrite").parquet(path)
        gone = self.spark.read.parquet(path).withColumnRenamed("doc", "_gone")
        postings = self.postings()
        change = postings.join(gone, F.col("doc") == F.col("_gone"), "left_semi").groupBy("hi", "lo").agg((-F.count(F.lit(1))).alias("change"))
        kept = f"{self.path}/removed/{self.version + 1}"
        change.write.mode("overwrite").parquet(kept)  # its size is known from here on
        change = self.spark.read.parquet(kept)
        removed = change.agg(F.coalesce(F.sum("change"), F.lit(0))).first()[0]
        rest = postings.join(gone, F.col("doc") == F.col("_gone"), "left_anti").join(change, ["hi", "lo"], "left_semi")
        first = rest.groupBy("hi", "lo").agg(F.min("doc").alias("first"))
        # No nulls among the numbers: pandas would turn them into floats. Keys without a document go anyway.
        delta = change.join(first, ["hi", "lo"], "left").select("hi", "lo", "change", F.coalesce("first", F.lit("0").cast(self.doc_type)).alias("first"))
        self.advance(delta, self.meta["refs"] + removed, {"gone": [*self.meta["gone"], self.version + 1]})
        remove(self.spark, kept)

    def advance(self, delta: DataFrame, refs: int, change: dict) -> None:
        """Write the next version's shards: each applies its part of (hi, lo, change, first)."""
        shards = self.meta["shards"]
        while shards * self.shard_refs < refs:
            shards *= 2
        schema = f"shard long, keys binary, refs binary, first array<{self.doc_type}>, bits binary"
        state = self.state().mapInArrow(split(shards // self.meta["shards"], self.meta["shards"]), schema)
        delta = delta.withColumn("shard", F.pmod("hi", F.lit(shards)))
        made = state.groupBy("shard").cogroup(delta.groupBy("shard")).applyInArrow(apply_delta, schema)
        made.write.mode("overwrite").parquet(f"{self.path}/shards/{self.version + 1}")
        self.commit({"shards": shards, "refs": refs, **change})

    def hot_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys with more than HOT of all references, sorted, and their first documents."""
        least = max(1.0, HOT * self.meta["refs"])
        rows = self.refs().where(F.col("refs") > least).select("hi", "lo", "first").toPandas()  # fewer than 1 / HOT
        keys = as_keys(rows["hi"].to_numpy(np.int64), rows["lo"].to_numpy(np.int64))
        order = np.argsort(keys)
        return keys[order], rows["first"].to_numpy()[order]

    def dedup(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """Documents without the lines that an indexed document of smaller id holds too; see dedup_lines."""
        keys = line_keys(docs, doc, text, self.min_chars, self.hot_keys())
        shards = F.lit(self.meta["shards"])
        dealt = keys.withColumn("shard", F.when(F.col("doomed"), F.pmod(F.xxhash64("doc"), shards)).otherwise(F.pmod("hi", shards)))
        doomed = self.state().groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(look_up, f"doc {self.doc_type}, hi long, lo long")
        return drop_lines(docs, doomed, doc, text, self.min_chars)


def split(times: int, shards: int):
    """Cuts each shard into so many, by the same hash; their filters are built anew."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if times == 1:
                yield batch
                continue
            for shard, keys, refs, first, _ in zip(*batch.columns, strict=True):
                pairs = np.frombuffer(keys.as_py(), "<i8").reshape(-1, 2)
                counts = np.frombuffer(refs.as_py(), "<i8")
                to = pairs[:, 0] % (shards * times)
                for part in range(shard.as_py(), shards * times, shards):
                    own = np.flatnonzero(to == part)
                    if len(own):
                        yield shard_row(part, as_keys(pairs[own, 0], pairs[own, 1]), counts[own], first.values.take(pa.array(own)), CuckooFilter.build(pairs[own, 1]))

    return cut


def shard_row(shard: int, keys: np.ndarray, refs: np.ndarray, first: pa.Array, seen: CuckooFilter) -> pa.RecordBatch:
    first = pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), first)
    packed = [pa.array([x.tobytes()], pa.binary()) for x in (keys, refs.astype("<i8"))]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *packed, first, pa.array([seen.to_bytes()], pa.binary())], ["shard", "keys", "refs", "first", "bits"])


def shard_of(state: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, CuckooFilter]:
    """Keys, references, first documents and filter of a shard's row, or of none."""
    if not state.num_rows:
        return np.zeros(0, "S16"), np.zeros(0, np.int64), np.zeros(0, np.int64), CuckooFilter.build(np.zeros(0, np.int64))
    keys, refs, bits = (state.column(c)[0].as_py() for c in ("keys", "refs", "bits"))
    return np.frombuffer(keys, "S16"), np.frombuffer(refs, "<i8"), state.column("first")[0].values.to_pandas().to_numpy(), CuckooFilter.from_bytes(bits)


def apply_delta(state: pa.Table, delta: pa.Table) -> pa.Table:
    """One shard after a change: the filter tells new keys from those that the exact table may have."""
    if not delta.num_rows:
        return state
    table, refs, first, seen = shard_of(state)
    changed, group = np.unique(as_keys(delta.column("hi").to_numpy(), delta.column("lo").to_numpy()), return_inverse=True)
    change = np.bincount(group, delta.column("change").to_numpy(), len(changed)).astype(np.int64)
    new_first = delta.column("first").to_pandas().groupby(group).min().to_numpy()
    los = lambda keys: keys.view("<i8").reshape(-1, 2)[:, 1]
    old = np.zeros(len(changed), bool)
    at = np.zeros(len(changed), np.int64)
    maybe = np.flatnonzero(seen.contains(los(changed)))
    at[maybe], old[maybe] = found_in(table, changed[maybe])
    refs, first = refs.copy(), first.copy()
    where = at[old]
    refs[where] += change[old]
    first[where] = np.where(change[old] > 0, np.minimum(first[where], new_first[old]), new_first[old])
    fresh = ~old & (change > 0)
    dead = refs <= 0
    seen.delete(los(table[dead]))
    keys = np.concatenate([table[~dead], changed[fresh]])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if not seen.add(los(changed[fresh])):
        seen = CuckooFilter.build(los(keys))
    first = np.concatenate([first[~dead], new_first[fresh]])[order]
    refs = np.concatenate([refs[~dead], change[fresh]])[order]
    shard = int((state if state.num_rows else delta).column("shard")[0].as_py())
    return pa.Table.from_batches([shard_row(shard, keys, refs, pa.array(first, delta.schema.field("first").type), seen)])


def look_up(state: pa.Table, asked: pa.Table) -> pa.Table:
    """The (doc, hi, lo) asked for that a document of smaller id holds; those settled before pass through."""
    table, _, first, seen = shard_of(state)
    hi, lo = asked.column("hi").to_numpy(), asked.column("lo").to_numpy()
    doomed = np.asarray(asked.column("doomed")).astype(bool).copy()
    maybe = np.flatnonzero(~doomed & seen.contains(lo)) if len(lo) else np.zeros(0, np.int64)
    at, held = found_in(table, as_keys(hi[maybe], lo[maybe]))
    maybe, at = maybe[held], at[held]
    docs = asked.column("doc").to_pandas().to_numpy()
    doomed[maybe] = first[at] < docs[maybe]
    return asked.filter(pa.array(doomed)).select(["doc", "hi", "lo"])
