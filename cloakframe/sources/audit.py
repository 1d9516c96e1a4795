"""Sinks and sources of the audit files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_audit(path: str, redacted: DataFrame, detections: DataFrame, mapping: DataFrame, summary: DataFrame) -> None:
    """redacted_blocks (Parquet), mapping (CSV with a header), detections and run_summary (JSON lines) under a path."""
    redacted.drop("edits", "text").write.parquet(f"{path}/redacted_blocks")
    mapping.write.option("header", True).csv(f"{path}/mapping")
    detections.write.json(f"{path}/detections")
    summary.write.json(f"{path}/run_summary")


def write_hidden_audit(path: str, fields: DataFrame | None = None, media: DataFrame | None = None) -> None:
    """field_code_redactions and media_redactions (JSON lines) under a path; the bytes of media stay out."""
    if fields is not None:
        fields.write.json(f"{path}/field_code_redactions")
    if media is not None:
        media.drop("content").write.json(f"{path}/media_redactions")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("entity_type string, source_sha256 string, replacement string").option("header", True).csv(path)


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256) of all files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_evaluation(path: str, reports: dict[str, DataFrame]) -> None:
    """Each report as JSON lines under a path."""
    for name, report in reports.items():
        report.write.json(f"{path}/{name}")


GOLD = "block_index int, stratum string, block_id string, text string, entities array<struct<start:int,end:int,text:string,entity_type:string>>"


def write_gold(path: str, gold: DataFrame) -> None:
    """Gold blocks as JSON lines; a sample without entities is written in the same way."""
    gold.write.json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, GOLD)
