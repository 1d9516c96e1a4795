"""Folders of Word packages: redacted and written in one call, and the delivery verified in another."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.detectors import Context, candidates
from cloakframe.functions.spans import resolve_overlaps
from cloakframe.operators import redact as rd
from cloakframe.operators import verify as vf
from cloakframe.operators.barrier import barrier
from cloakframe.operators.harvest import by_document, context_columns, harvest
from cloakframe.sources import docx


def redact_folder(
    spark: SparkSession, source: str, target: str, placeholders: dict[str, bytes] | None = None, ner: DataFrame | None = None, config: rd.RedactionConfig = rd.RedactionConfig()
) -> dict[str, DataFrame]:
    """Redact all .docx files under ``source`` and write them under ``target``, each by the task that rewrites it.

    Gives the tables redacted, mapping, detections, fields, media and summary.
    Without placeholders images stay as they are; with them, an image of a type
    that has none stops the run. Files have the same names below ``target``; a
    task that runs again writes the same bytes.
    """
    parts = docx.load_package(spark, source)
    blocks = docx.join_runs(parts["run"])
    gazetteer = harvest(blocks, ner, parts["cell"])
    made, mapping = rd.rewrite(rd.detect(blocks, gazetteer, detectors=config.detectors), config)
    made = barrier(made)
    fields, hidden = rd.redact_fields(parts["field"], config)
    media = rd.redact_media(parts["media"], placeholders) if placeholders else parts["media"].limit(0).withColumn("action", F.lit(""))
    runs = rd.apply_to_runs(parts["run"], made).select("doc_id", F.struct("block_index", "run_idx", "text").alias("v")).groupBy("doc_id").agg(F.collect_list("v").alias("runs"))
    notes = fields.select("doc_id", F.struct("part", F.col("block_index").alias("idx"), F.col("redacted").alias("text")).alias("v")).groupBy("doc_id").agg(F.collect_list("v").alias("fields"))
    images = media.select("doc_id", F.struct("part", "content").alias("v")).groupBy("doc_id").agg(F.collect_list("v").alias("images"))
    files = docx.packages(spark, source).join(runs, "doc_id", "left").join(notes, "doc_id", "left").join(images, "doc_id", "left")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target)
        rows = lambda value: value if value is not None else []
        for frame in frames:
            for f in frame.itertuples():
                new = docx.rewrite_package(
                    f.content,
                    {(r["block_index"], r["run_idx"]): r["text"] for r in rows(f.runs)},
                    {(r["part"], r["idx"]): r["text"] for r in rows(f.fields)},
                    {r["part"]: bytes(r["content"]) for r in rows(f.images)},
                )
                path = f"{root}/{f.name}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(new)
                yield pd.DataFrame({"doc_id": [f.doc_id], "name": [f.name], "bytes": [len(new)]})

    written = barrier(files.mapInPandas(write, "doc_id long, name string, bytes long"))
    return {
        "redacted": made, "mapping": mapping.unionByName(hidden).dropDuplicates(["entity_type", "canonical"]), "detections": rd.detection_audit(made, config.salt),
        "fields": rd.field_audit(fields, config.salt), "media": media, "summary": rd.run_summary(made, fields, media, mapping, gazetteer), "written": written,
    }


def detected_values(spark: SparkSession, path: str, ner: DataFrame | None = None) -> DataFrame:
    """(doc_id, entity_type, text, hidden): what the detectors find in the blocks and fields of a folder's packages."""
    parts = docx.load_package(spark, path)
    blocks = docx.join_runs(parts["run"])
    gazetteer = harvest(blocks, ner, parts["cell"])
    seen = rd.span_rows(rd.detect(blocks, gazetteer).select("doc_id", "spans")).select("doc_id", "entity_type", "text", F.lit(False).alias("hidden"))
    known = parts["field"].join(by_document(gazetteer), "doc_id", "left")
    fields = known.select("doc_id", F.explode(resolve_overlaps(candidates(F.col("text"), Context(**context_columns())))).alias("s"))
    return seen.unionByName(fields.select("doc_id", "s.entity_type", "s.text", F.lit(True).alias("hidden"))).distinct()


def verify_folder(spark: SparkSession, source: str, target: str, placeholders: dict[str, bytes] | None = None, ner: DataFrame | None = None) -> DataFrame:
    """One row: what of the sources is left in the redacted packages, and what else differs. No value is printed.

    Leaks are looked for in the decoded text of every XML part, where runs are
    joined and entities resolved: visible values, hidden ones, and any e-mail
    address of the source. Counts of paragraphs, tables, sections, bold runs and
    blocks must be the same by document; packages must be sound, and images the
    placeholders.
    """
    before, after = docx.load_package(spark, source), docx.load_package(spark, target)
    values = barrier(detected_values(spark, source, ner))
    held = values.groupBy("doc_id").agg(F.collect_set(F.struct("hidden", "entity_type", "text")).alias("vs"))
    left = after["xml"].join(held, "doc_id").select("doc_id", F.explode(F.filter("vs", lambda v: F.contains(F.col("text"), v["text"]))).alias("v")).select("doc_id", "v.*").distinct()
    leaks = left.agg(F.count_if(~F.col("hidden")).alias("visible_leaks"), F.count_if("hidden").alias("hidden_leaks"), F.count_if(F.col("entity_type") == "EMAIL").alias("email_leaks"))
    counts = ["doc_id", "paragraphs", "tables", "sections", "bold_runs"]
    blocks = lambda parts: vf.structure(docx.join_runs(parts["run"])).select("doc_id", "blocks")
    shape = lambda parts: parts["structure"].select(*counts).join(blocks(parts), "doc_id", "left")
    a, b = shape(before), shape(after)
    differ = a.exceptAll(b).unionByName(b.exceptAll(a)).select("doc_id").distinct().agg(F.count(F.lit(1)).alias("structure_differences"))
    unsound = after["structure"].agg(F.count_if(~F.col("sound")).alias("unsound_packages"), F.count(F.lit(1)).alias("documents"))
    images = vf.media_differences(after["media"], placeholders or {}) if placeholders else after["media"].limit(0)
    one = leaks
    for df in (differ, unsound, images.agg(F.count(F.lit(1)).alias("media_differences")), values.agg(F.count(F.lit(1)).alias("source_values"))):
        one = one.crossJoin(F.broadcast(df))  # single rows
    return one.withColumn("passed", F.expr("visible_leaks + hidden_leaks + email_leaks + structure_differences + unsound_packages + media_differences = 0"))
