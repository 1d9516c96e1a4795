"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import decontaminate, linededup, mixing, quality, simhash
from cloakframe.llm.common import aside, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go.

    All stages: columns beside doc_id, text, source, lang and n_chars are the
    user's, whatever their names, and come back as they were; repeated rows and
    rows of null id are kept or dropped one by one; null texts are empty; empty
    tables give empty tables; texts count whole.
    """
    docs, back = aside(docs, "doc_id", "source", "text")
    return back(quality.judge(docs).where("kept").select(*docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the smallest id only; n_chars, if there, follows the new text. Rows of null id stay as they are."""
    docs, back = aside(docs, "doc_id", "text", "n_chars")
    kept = linededup.dedup_lines(docs).select(*docs.columns)
    return back(kept.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates stays; null and empty texts are one group."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose tokens follow the target shares.

    Adds n_tokens, topic, weight and prob, each with underscores after it where the documents have that name.
    """
    kept, back = aside(docs, "doc_id", "text", "source", "lang")
    made = mixing.mix(kept).where("sampled").drop("sampled")
    taken = {c.lower() for c in docs.columns}
    for name in ("n_tokens", "topic", "weight", "prob"):
        free = name
        while free in taken:
            free += "_"
        made = made.withColumnRenamed(name, free)
    return back(made)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: Fingerprints, alignments and raking are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each over the stored result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
