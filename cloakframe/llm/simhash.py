"""SimHash near-duplicates: pigeonhole blocks, then verified Hamming distances."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import aside, checkpointed, connected_components, text_bytes

BITS = 64
SHINGLE = 4
DISTANCE = 4
#: Bits of a join key that a fingerprint count of n needs: its logarithm and a few more.
SPARE_BITS = 3
#: Tasks that a component's members are dealt to.
SALTS = 32
#: A fingerprint with more than this share of all rows is hot.
HOT = 1e-4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without words."""
    norm = b" ".join(text_bytes(text).lower().split())
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = np.r_[0, gaps + 1]
    ends = np.r_[gaps, len(norm)]
    if len(starts) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(norm[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc, fp) with the fingerprint as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc", "fp"])

    docs = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    return docs.mapInArrow(make, f"doc {docs.schema['doc'].dataType.simpleString()}, fp long")


def block_count(fingerprints: int, distance: int = DISTANCE) -> int:
    """Blocks to cut fingerprints into, so that keys have bits enough to tell chance from likeness.

    With b blocks, two fingerprints that differ in d bits share b - d blocks at
    least, so each choice of b - d blocks is a join key. Any count gives the same
    pairs; more blocks give longer and more keys.
    """
    wanted = math.log2(max(2, fingerprints)) + SPARE_BITS
    for blocks in range(distance + 2, 2 * distance + 4):
        if BITS * (blocks - distance) // blocks >= wanted:
            return blocks
    return 2 * distance + 4


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(block, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def link_classes(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) for the distinct fingerprints that have a link; root names the component.

    Within a block, fingerprints are linked to the block's smallest and largest
    where they are near it. After that, only pairs that are still in different
    components are joined and verified, so a group of near copies costs a few
    links each and not all pairs, and no link between components is missed.
    """
    nodes = nodes.select("fp")
    choices = masks(block_count(nodes.count(), distance), distance)
    blocks = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in choices])).alias("k", "block"))
    hubs = blocks.groupBy("k", "block").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    # Only blocks of two or more take part from here on.
    shared = checkpointed(blocks.join(hubs, ["k", "block"]))
    stars = shared.select(F.col("fp").alias("a"), F.explode(F.array("low", "high")).alias("b"))
    stars = stars.where(F.col("a") != F.col("b")).where(near(F.col("a"), F.col("b"), distance))
    first = checkpointed(connected_components(stars))
    labelled = shared.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("k", "block", "fp", F.coalesce("component", "fp").alias("label"))
    mixed = labelled.groupBy("k", "block").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("k", "block")
    open_blocks = checkpointed(labelled.join(mixed, ["k", "block"], "left_semi"))
    left = open_blocks.select("k", "block", F.col("fp").alias("a"), F.col("label").alias("la"))
    right = open_blocks.select("k", "block", F.col("fp").alias("b"), F.col("label").alias("lb"))
    pairs = left.join(right, (left.k == right.k) & (left.block == right.block) & (F.col("la") < F.col("lb")) & near(F.col("a"), F.col("b"), distance))
    merged = connected_components(pairs.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    all_labels = first.select(F.col("node").alias("fp"), F.col("component").alias("label")).union(
        merged.join(first.select(F.col("node")), "node", "left_anti").select("node", "node")
    )
    return checkpointed(
        all_labels.join(merged.select(F.col("node").alias("label"), F.col("component").alias("root")), "label", "left").select(
            "fp", F.coalesce("root", "label").alias("root")
        )
    )


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc, fp, component): component is the smallest id among the documents reachable over links.

    Documents of equal fingerprint are linked, as are those whose fingerprints
    differ in ``distance`` bits or fewer. Null or empty texts have the
    fingerprint 0, linked like any other. Null ids get the component of their
    fingerprint. Repeated rows stay. No documents, no rows.

    Copies collapse to their fingerprint before blocks are made; everything after
    that has one row a distinct fingerprint and block. A component's smallest id
    goes back to its members by a salted join, and to the documents of a hot
    fingerprint, of which there are fewer than 1 / HOT, by a broadcast.
    """
    made = checkpointed(fingerprints(docs, doc, text, shingle))
    nodes = checkpointed(made.groupBy("fp").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows")))
    linked = checkpointed(nodes.join(link_classes(nodes, distance), "fp").select("fp", "first", "root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"]).select("fp", "component")
    named = checkpointed(nodes.join(linked, "fp", "left").select("fp", "rows", F.coalesce("component", "first").alias("component")))
    total = named.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = named.where(F.col("rows") > HOT * total).select("fp", F.struct("component").alias("held"))
    both = made.join(F.broadcast(hot), "fp", "left")  # fewer than 1 / HOT rows
    rest = both.where("held IS NULL").drop("held").join(named.where(F.col("rows") <= HOT * total), "fp")
    return both.where("held IS NOT NULL").select("doc", "fp", "held.component").unionByName(rest.select("doc", "fp", "component"))


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The documents that are the smallest id of their component, with their columns as they are.

    Rows of null id stay. Rows that share the smallest id all stay. Columns of any other name are left alone.
    """
    found = near_duplicates(docs, doc, text, shingle, distance)
    docs, back = aside(docs, doc, text)
    gone = found.where("doc > component").select(F.col("doc").alias("_gone"))
    return back(docs.join(gone, docs[doc] == gone["_gone"], "left_anti"))
