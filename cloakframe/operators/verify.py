"""Integrity of a redacted corpus: leaks, structure, media and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.detectors import EMAIL


def leaks(redacted: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, block_index, entity_type) of source values (doc_id, entity_type, text) that redacted blocks still hold.

    Compared on decoded, joined text, within the document. Documents that are
    free of leaks give no rows; no value is printed.
    """
    held = values.select("doc_id", F.struct("entity_type", F.col("text").alias("value")).alias("v")).groupBy("doc_id").agg(F.collect_set("v").alias("vs"))
    left = redacted.join(held, "doc_id").select("doc_id", "block_index", F.explode(F.filter("vs", lambda v: F.contains(F.col("redacted"), v["value"]))).alias("v"))
    return left.select("doc_id", "block_index", "v.entity_type")


def email_leaks(redacted: DataFrame, allowed: str = "@example.com") -> DataFrame:
    """Blocks with an e-mail address that no fake can have."""
    left = F.filter(F.regexp_extract_all("redacted", F.lit(EMAIL), F.lit(0)), lambda e: ~F.endswith(F.lower(e), F.lit(allowed)))
    return redacted.where(F.size(left) > 0).select("doc_id", "block_index")


def structure(blocks: DataFrame, text: str = "text") -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.max("block_index").alias("last_block"), F.count_if(F.length(text) == 0).alias("empty_blocks"))


def structure_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    left, right = structure(before).select("doc_id", "blocks", "last_block"), structure(after, "redacted").select("doc_id", "blocks", "last_block")
    return left.exceptAll(right).unionByName(right.exceptAll(left))


def media_differences(media: DataFrame, placeholders: dict[str, bytes]) -> DataFrame:
    """Parts whose bytes aren't the placeholder of their type."""
    wanted = F.lit(None).cast("binary")
    for kind, data in placeholders.items():
        wanted = F.when(F.col("content_type") == kind, F.lit(data)).otherwise(wanted)
    return media.where(~F.col("content").eqNullSafe(wanted)).select("doc_id", "part", "content_type")


def audit_report(redacted: DataFrame, audit: DataFrame, mapping: DataFrame, values: DataFrame) -> DataFrame:
    """One row: do the audit tables have hashes only, and as many rows as there are replacements and values."""
    replacements = redacted.agg(F.coalesce(F.sum(F.size("edits")), F.lit(0)).alias("replacements"))
    hashes = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.regexp_like("source_sha256", F.lit("^[0-9a-f]{64}$"))).alias("bad"))
    a, m = hashes(audit), hashes(mapping)
    leaked, mailed = leaks(redacted, values).agg(F.count(F.lit(1)).alias("leaks")), email_leaks(redacted).agg(F.count(F.lit(1)).alias("email_leaks"))
    one = replacements
    for i, df in enumerate((a.toDF("detections", "bad_detections"), m.toDF("mappings", "bad_mappings"), leaked, mailed)):
        one = one.crossJoin(F.broadcast(df))  # single rows
    clear = {"original", "text", "source"} & {c.lower() for c in (*audit.columns, *mapping.columns)}
    return one.withColumn("cleartext_columns", F.lit(len(clear))).withColumn(
        "passed", F.expr("replacements = detections AND bad_detections + bad_mappings + leaks + email_leaks + cleartext_columns = 0")
    )
