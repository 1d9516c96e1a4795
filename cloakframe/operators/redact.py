"""Pass two: detect, settle conflicts, map to stable fakes and rewrite."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import fakes
from cloakframe.functions.detectors import REGISTRY, Context, Detector, candidates, ner_spans
from cloakframe.functions.spans import apply_spans, built, resolve_overlaps
from cloakframe.operators.barrier import barrier
from cloakframe.operators.harvest import by_document, context_columns, harvest


@dataclass(frozen=True)
class RedactionConfig:
    seed: int = fakes.SEED
    #: False maps a value to one fake in the whole corpus; True, to one in each document.
    by_document: bool = False
    salt: str = ""
    detectors: tuple[Detector, ...] = REGISTRY


def blocks_of(docs: DataFrame, doc: str = "doc_id", text: str = "text", location: str = "body") -> DataFrame:
    """(doc_id, block_index, location, block_id, text): the lines of documents that aren't blank, numbered in order."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda l: F.regexp_like(l, F.lit(r"(?U)\S")))
    rows = docs.select(F.col(doc).alias("doc_id"), F.posexplode(lines).alias("block_index", "text"))
    return rows.select("doc_id", "block_index", F.lit(location).alias("location"), F.concat(F.lit(f"{location}#"), "block_index").alias("block_id"), "text")


def detect(blocks: DataFrame, gazetteer: DataFrame | None = None, ner: DataFrame | None = None, detectors: tuple[Detector, ...] = REGISTRY, settle: bool = True) -> DataFrame:
    """Blocks with ``spans``: the detectors' spans, conflicts settled.

    The gazetteer joins by document; Spark broadcasts it where it is small.
    A model's entities (doc_id, block_index, start, text, label) take part with
    the lowest priority where they are given. ``settle=False`` keeps all spans by
    start, overlapping ones too: each is then a value of its own, counted, mapped
    and rewritten, so that none of a card and an address that share digits stays.
    """
    context = Context()
    names = list(blocks.columns)
    if gazetteer is not None:
        blocks = blocks.join(by_document(gazetteer), "doc_id", "left")
        context = Context(**context_columns())
    found = built(("candidates", gazetteer is not None, detectors), lambda: candidates(F.col("text"), context, detectors))
    if ner is not None:
        ents = ner.groupBy("doc_id", "block_index").agg(F.collect_list(F.struct("start", "text", "label")).alias("_ents"))
        blocks = blocks.join(ents, ["doc_id", "block_index"], "left")
        found = F.concat(found, F.coalesce(ner_spans(F.col("_ents")), F.array().cast("array<struct<start:int,end:int,text:string,entity_type:string,detector:string,priority:int,ord:int>>")))
    return blocks.withColumn("_found", found).withColumn("spans", resolve_overlaps(F.col("_found")) if settle else F.array_sort("_found")).select(*names, "spans")


def detect_only(blocks: DataFrame, ner: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    return detect(blocks, harvest(blocks, ner, tables))


def span_rows(detected: DataFrame) -> DataFrame:
    """One row for each span of detected blocks."""
    names = [c for c in detected.columns if c not in ("spans", "text")]
    return detected.select(*names, F.explode("spans").alias("s")).select(*names, "s.*")


def rewrite(detected: DataFrame, config: RedactionConfig = RedactionConfig()) -> tuple[DataFrame, DataFrame]:
    """The blocks with ``redacted`` text and ``edits``, and the mapping.

    The spans, not the texts, are written once; the mapping and the edits read
    them, and the edits join back to the blocks, whose detection is then pruned.
    """
    scope = ["doc_id"] if config.by_document else []
    rows = barrier(span_rows(detected.select("doc_id", "block_index", "text", "spans")))
    mapping = barrier(fakes.mapping(rows, scope, config.seed, config.salt))
    keyed = rows.withColumn("canonical", fakes.canonical_of_span())
    named = keyed.join(mapping.select(*scope, "entity_type", "canonical", "replacement"), [*scope, "entity_type", "canonical"])
    edit = F.struct("start", "end", fakes.match_case(F.col("text"), F.col("replacement")).alias("replacement"), "entity_type", "detector", F.col("text").alias("source"))
    edits = named.groupBy("doc_id", "block_index").agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    joined = detected.drop("spans").join(edits, ["doc_id", "block_index"], "left")
    made = joined.withColumn("edits", F.coalesce("edits", F.array())).withColumn("redacted", apply_spans(F.col("text"), F.col("edits")))
    return made, mapping


def source_values(redacted: DataFrame) -> DataFrame:
    """(doc_id, entity_type, text) of what was replaced."""
    rows = redacted.select("doc_id", F.explode("edits").alias("e"))
    return rows.select("doc_id", "e.entity_type", F.col("e.source").alias("text")).distinct()


def redact(blocks: DataFrame, ner: DataFrame | None = None, tables: DataFrame | None = None, config: RedactionConfig = RedactionConfig()) -> tuple[DataFrame, DataFrame]:
    return rewrite(detect(blocks, harvest(blocks, ner, tables), detectors=config.detectors), config)


def detection_audit(redacted: DataFrame, salt: str = "") -> DataFrame:
    """One row for each replacement, with a hash in place of the source value."""
    rows = redacted.select("doc_id", "block_id", F.explode("edits").alias("e"))
    return rows.select(
        "doc_id", "e.start", "e.end", (F.col("e.end") - F.col("e.start")).alias("length"), "e.entity_type", "e.detector",
        F.col("block_id").alias("block"), F.sha2(F.concat(F.lit(salt), "e.source"), 256).alias("source_sha256"),
        F.sha2(F.concat(F.lit(salt), fakes.canonical(F.col("e.entity_type"), F.col("e.source"))), 256).alias("canonical_sha256"), "e.replacement",
    )


def mapping_audit(mapping: DataFrame) -> DataFrame:
    return mapping.orderBy("entity_type", "canonical").select("entity_type", "source_sha256", "replacement")


def run_summary(redacted: DataFrame, fields: DataFrame | None = None, media: DataFrame | None = None, mapping: DataFrame | None = None, gazetteer: DataFrame | None = None) -> DataFrame:
    """One row: blocks, blocks touched, replacements, and these by type; and counts of the other tables that are given."""
    types = redacted.select(F.explode("edits.entity_type").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    by_type = types.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("by_type"))
    counts = redacted.agg(F.count(F.lit(1)).alias("blocks_scanned"), F.count_if(F.size("edits") > 0).alias("blocks_modified"), F.coalesce(F.sum(F.size("edits")), F.lit(0)).cast("long").alias("replacements"))
    more = [by_type]
    if fields is not None:
        more.append(fields.agg(F.coalesce(F.sum(F.size("edits")), F.lit(0)).cast("long").alias("hidden_field_values")))
    if media is not None:
        more.append(media.agg(F.count(F.lit(1)).alias("image_parts")))
    if mapping is not None:
        more.append(mapping.agg(F.count(F.lit(1)).alias("stable_mappings")))
    if gazetteer is not None:
        kinds = gazetteer.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
        more.append(kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("gazetteer")))
    for df in more:
        counts = counts.crossJoin(F.broadcast(df))  # single rows
    return counts


def redact_fields(fields: DataFrame, config: RedactionConfig = RedactionConfig()) -> tuple[DataFrame, DataFrame]:
    """Hidden fields (doc_id, part, idx, text) through the same plan; gives them rewritten, and the mapping."""
    blocks = fields.select("doc_id", F.col("idx").alias("block_index"), F.concat_ws("#", "part", "idx").alias("block_id"), "part", "text")
    return rewrite(detect(blocks, detectors=config.detectors), config)


def field_audit(redacted: DataFrame, salt: str = "") -> DataFrame:
    """One row for each replacement in hidden fields, with a hash in place of the source value."""
    rows = redacted.select("doc_id", "part", F.explode("edits").alias("e"))
    source = F.sha2(F.concat(F.lit(salt), "e.source"), 256)
    return rows.select("doc_id", "part", F.lit("instruction").alias("field"), "e.entity_type", source.alias("source_sha256"), "e.replacement")


#: Placeholder bytes for images by content type; any other type stops the run.
IMAGE_TYPES = ("image/png", "image/jpeg")
#: Fixed value of the audit.
MEDIA_ACTION = "replaced_with_neutral_placeholder"


def redact_media(media: DataFrame, placeholders: dict[str, bytes]) -> DataFrame:
    """Media (doc_id, part, content_type, content) with the placeholder of their type in place of the content."""
    kind = F.col("content_type")
    made = F.raise_error(F.concat(F.lit("no placeholder for "), kind)).cast("binary")
    for name in IMAGE_TYPES:
        if name in placeholders:
            made = F.when(kind == name, F.lit(placeholders[name])).otherwise(made)
    return media.withColumn("content", made).withColumn("action", F.lit(MEDIA_ACTION))


def apply_to_runs(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """Runs (doc_id, block_index, run_idx, text) rewritten by their block's edits, their formatting columns kept.

    A replacement goes into the first run that its span covers; the span's part
    in other runs is deleted.
    """
    from pyspark.sql import Window

    key = ["doc_id", "block_index"]
    before = Window.partitionBy(*key).orderBy("run_idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_from", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).withColumn("_to", F.col("_from") + F.length("text"))
    joined = placed.join(edits.select(*key, "edits"), key, "left")
    inside = F.filter(F.coalesce("edits", F.array()), lambda e: (e["start"] < F.col("_to")) & (F.col("_from") < e["end"]))
    own = F.transform(
        inside,
        lambda e: F.struct(
            (F.greatest(e["start"], F.col("_from")) - F.col("_from")).cast("int").alias("start"),
            (F.least(e["end"], F.col("_to")) - F.col("_from")).cast("int").alias("end"),
            F.when(e["start"] >= F.col("_from"), e["replacement"]).otherwise("").alias("replacement"),
        ),
    )
    return joined.withColumn("text", apply_spans(F.col("text"), own)).drop("_from", "_to", "edits")
