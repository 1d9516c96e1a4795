"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This session's part of the shared checkpoint folder that the cluster names in spark.checkpoint.dir.

    Without the setting, a temporary folder serves a local master, as in tests;
    elsewhere executors could not see one another's files, so that is an error.
    The session's own part is removed when the driver's Python ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        atexit.register(remove, spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table; a session that has ended leaves it."""
    with contextlib.suppress(Exception):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of wide rows with a compressed table in the shared checkpoint folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.parquet(path)
    made.stored_at = path
    return made


def discard(df: DataFrame) -> None:
    """Remove the table of ``stored`` before the session ends, where nothing reads it any more."""
    remove(df.sparkSession, df.stored_at)


def aside(docs: DataFrame, *kept: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The documents with all columns but ``kept`` renamed, so that no name of the operators' own can clash.

    The second result gives a frame its names back: columns that it still has of
    the renamed ones, and any others as they are.
    """
    held = {f"_aside{i}_": c for i, c in enumerate(docs.columns) if c not in kept}
    names = {c: k for k, c in held.items()}
    return docs.toDF(*[names.get(c, c) for c in docs.columns]), lambda made: made.toDF(*[held.get(c, c) for c in made.columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spaced(text: Column) -> Column:
    """The text with plain spaces for all of SPACES; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(spaced_text: Column) -> Column:
    """The words of a text that has plain spaces only."""
    return F.array_remove(F.split(spaced_text, " "), "")


def text_bytes(value: str | None) -> bytes:
    """UTF-8 of a text; lone surrogates, which no valid text has, become question marks."""
    return (value or "").encode("utf-8", "replace")


def drawn_texts(docs: DataFrame, text: str, most: int, chars: int | None = None) -> DataFrame:
    """The distinct texts of the lowest hashes, ``most`` of them at most: copies neither weigh more nor come whole.

    ``chars`` bounds each by a stretch of so many characters, from a place that its hash chooses.
    """
    hashed = F.xxhash64(F.col(text))
    lowest = docs.select(hashed.alias("h")).distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if lowest is None:
        return docs.select(text).limit(0)
    drawn = docs.select(text).where(hashed <= lowest).dropDuplicates([text])
    if chars is None:
        return drawn
    start = F.pmod(hashed, F.greatest(F.lit(1), F.length(text) - chars + 1)).cast("int") + 1
    return drawn.select(F.substring(F.col(text), start, F.lit(chars)).alias(text))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b); component is its smallest node.

    Large-star and small-star steps alternate until nothing changes. Each step
    reduces neighbourhoods to their minimum with map-side aggregation, so no
    neighbourhood is gathered in one task, and writes its edges as a checkpoint.
    Self loops and repeated edges are ignored; an empty input gives no rows.
    """
    edges = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        edges = checkpointed(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b"), F.col("b")).distinct()
    )
