"""Detection on streams: the stateless detectors, and a gazetteer that a batch run learned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.redact import blocks_of, detect, span_rows


def detect_stream(documents: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Spans of a stream of documents (doc_id, text); the gazetteer is the static side of the join."""
    return detect(blocks_of(documents), gazetteer)


def audit_stream(documents: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    rows = span_rows(detect_stream(documents, gazetteer).select("doc_id", "block_id", "spans"))
    return rows.select("doc_id", "block_id", "start", "end", "entity_type", "detector", F.sha2("text", 256).alias("source_sha256"))


def windowed_counts(events: DataFrame, time: str, text: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Spans by type and window of event time; late rows are waited for as long as the watermark says."""
    from cloakframe.functions.detectors import candidates
    from cloakframe.functions.spans import resolve_overlaps

    found = events.withWatermark(time, late).select(time, F.explode(resolve_overlaps(candidates(F.coalesce(text, F.lit(""))))).alias("s"))
    return found.groupBy(F.window(time, window), "s.entity_type").agg(F.count(F.lit(1)).alias("spans"))
