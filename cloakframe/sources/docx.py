"""Word packages: blocks, runs, tables, fields and media of a folder of files; and their rewriting."""

from __future__ import annotations

import io
import json
import zipfile
from base64 import b64encode
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators.barrier import barrier

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "emf": "image/x-emf", "wmf": "image/x-wmf", "tif": "image/tiff", "tiff": "image/tiff"}


R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: The kinds of a section's headers and footers, in the order of reading: default, first page, even pages.
SIDES = [(tag, kind) for kind in ("default", "first", "even") for tag in ("headerReference", "footerReference")]
FIELDS = (f"{W}instrText", f"{W}delInstrText")
#: Values that turn a switch off.
OFF = ("0", "false", "off")


def xml_parts(names: list[str]) -> list[str]:
    return sorted(n for n in names if n.endswith((".xml", ".rels")))


def text_parts(package: zipfile.ZipFile) -> list[str]:
    """The body, then the headers and footers of its sections by kind, each part once, then those that no section names."""
    names = package.namelist()
    found = [n for n in ("word/document.xml",) if n in names]
    if found and "word/_rels/document.xml.rels" in names:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(package.read("word/_rels/document.xml.rels"))}
        for section in ElementTree.fromstring(package.read(found[0])).iter(f"{W}sectPr"):
            for tag, kind in SIDES:
                for node in section.findall(f"{W}{tag}"):
                    target = targets.get(node.get(f"{R}id"), "")
                    part = target.lstrip("/") if target.startswith("/") else f"word/{target}"
                    if node.get(f"{W}type", "default") == kind and part in names:
                        found.append(part)
    found += sorted(n for n in names if n.startswith(("word/header", "word/footer")) and n.endswith(".xml"))
    return list(dict.fromkeys(found))


def is_bold(run: ElementTree.Element) -> bool:
    mark = run.find(f"{W}rPr/{W}b")
    return mark is not None and mark.get(f"{W}val", "true").lower() not in OFF


def field_nodes(root: ElementTree.Element) -> list[ElementTree.Element]:
    return [n for n in root.iter() if n.tag in FIELDS and (n.text or "").strip()]


def structure_of(package: zipfile.ZipFile) -> dict[str, int]:
    """Counts that redaction must not change."""
    root = ElementTree.fromstring(package.read("word/document.xml"))
    bold = sum(is_bold(r) for n in package.namelist() if n.startswith("word/") and n.endswith(".xml") for r in ElementTree.fromstring(package.read(n)).iter(f"{W}r"))
    return {"paragraphs": sum(1 for _ in root.iter(f"{W}p")), "tables": sum(1 for _ in root.iter(f"{W}tbl")), "sections": sum(1 for _ in root.iter(f"{W}sectPr")), "bold_runs": bold}


def paragraphs(root: ElementTree.Element) -> Iterator[list[ElementTree.Element]]:
    """The runs of each paragraph, at any depth; a nested paragraph's runs are its own."""

    def runs(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
        for child in node:
            if child.tag == f"{W}r":
                yield child
            if child.tag != f"{W}p":
                yield from (r for r in runs(child) if child.tag != f"{W}r") if child.tag != f"{W}r" else ()

    for p in root.iter(f"{W}p"):
        yield list(runs(p))


def run_text(run: ElementTree.Element) -> str:
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join(n.text or "" if n.tag == f"{W}t" else marks.get(n.tag, "") for n in run)


def read_package(content: bytes) -> Iterator[tuple[str, dict]]:
    """(kind, record) of everything that the engine reads: run, cell, field and media."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        names = package.namelist()
        index = 0
        for part in text_parts(package):
            root = ElementTree.fromstring(package.read(part))
            for runs in paragraphs(root):
                texts = [run_text(r) for r in runs]
                if not "".join(texts).strip():
                    continue
                for i, (run, text) in enumerate(zip(runs, texts, strict=True)):
                    yield "run", {"block_index": index, "location": part, "run_idx": i, "text": text, "bold": is_bold(run)}
                index += 1
            if part == "word/document.xml":
                for t, table in enumerate(root.iter(f"{W}tbl")):
                    for r, row in enumerate(table.findall(f"{W}tr")):
                        for c, cell in enumerate(row.findall(f"{W}tc")):
                            yield "cell", {"table_idx": t, "row_idx": r, "col_idx": c, "text": "".join(run_text(x) for x in cell.iter(f"{W}r"))}
        for part in xml_parts(names):
            for i, node in enumerate(field_nodes(ElementTree.fromstring(package.read(part)))):
                yield "field", {"part": part, "idx": i, "text": node.text}
        for part in sorted(n for n in names if n.startswith("word/media/")):
            yield "media", {"part": part, "content_type": IMAGES.get(part.rsplit(".", 1)[-1].lower(), "application/octet-stream"), "content": b64encode(package.read(part)).decode()}
        for part in xml_parts(names):
            yield "xml", {"part": part, "text": "".join(ElementTree.fromstring(package.read(part)).itertext())}
        yield "structure", {**structure_of(package), "sound": package.testzip() is None}


SCHEMAS = {
    "run": "block_index int, location string, run_idx int, text string, bold boolean",
    "cell": "table_idx int, row_idx int, col_idx int, text string",
    "field": "part string, idx int, text string",
    "media": "part string, content_type string, content string",
    "xml": "part string, text string",
    "structure": "paragraphs long, tables long, sections long, bold_runs long, sound boolean",
}


def packages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, content) of all .docx files under a path; names are relative to it, and the id is a hash of the name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    # Paths come back with their scheme: what follows the folder's own name is the file's.
    folder = path.rstrip("/").split("://")[-1].split("/")[-1]
    name = F.regexp_replace("path", F.lit(rf"^.*?/\Q{folder}\E/"), F.lit("")) if folder else F.col("path")
    return files.select(F.xxhash64(name).alias("doc_id"), name.alias("name"), "content")


def load_package(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """DataFrames run, cell, field, media, xml and structure of all .docx files under a path, by doc_id.

    The files are read once and what they hold is a stage boundary, so each kind
    reads its own rows only.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, content in zip(frame["doc_id"], frame["content"], strict=True):
                rows = [(doc, kind, json.dumps(record, ensure_ascii=False)) for kind, record in read_package(content)]
                yield pd.DataFrame(rows, columns=["doc_id", "kind", "record"])

    rows = barrier(packages(spark, path).select("doc_id", "content").mapInPandas(read, "doc_id long, kind string, record string"))
    found = {kind: rows.where(F.col("kind") == kind).select("doc_id", F.from_json("record", schema).alias("r")).select("doc_id", "r.*") for kind, schema in SCHEMAS.items()}
    found["media"] = found["media"].withColumn("content", F.unbase64("content"))
    return found


def load_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, block_index, location, block_id, text, layout): paragraphs joined from their runs, with the runs' offsets."""
    return join_runs(load_package(spark, path)["run"])


def join_runs(runs: DataFrame) -> DataFrame:
    """Blocks of runs (doc_id, block_index, location, run_idx, text); see load_blocks."""
    grouped = runs.groupBy("doc_id", "block_index", "location").agg(F.array_sort(F.collect_list(F.struct("run_idx", "text"))).alias("rs"))
    sizes = F.transform("rs", lambda r: F.length(r["text"]))
    layout = F.transform(
        "rs",
        lambda r, i: F.struct(
            F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x).alias("start"), F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, x: a + x).alias("end"), r["run_idx"].alias("run_idx")
        ),
    )
    text = F.array_join(F.transform("rs", lambda r: r["text"]), "")
    return grouped.select("doc_id", "block_index", "location", F.concat("location", F.lit("#"), "block_index").alias("block_id"), text.alias("text"), layout.alias("layout"))


def rewrite_package(content: bytes, runs: dict[tuple[int, int], str], fields: dict[tuple[str, int], str] | None = None, media: dict[str, bytes] | None = None) -> bytes:
    """The package with the texts of runs (block_index, run_idx), fields (part, idx) and the bytes of images replaced."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as package, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        changed: dict[str, bytes] = {}
        index = 0
        names, texts = package.namelist(), text_parts(package)
        for part in texts + [n for n in xml_parts(names) if n not in texts]:
            root = ElementTree.fromstring(package.read(part))
            before = ElementTree.tostring(root)
            if part in texts:
                for own in paragraphs(root):
                    if not "".join(map(run_text, own)).strip():
                        continue
                    for i, run in enumerate(own):
                        if (index, i) in runs and runs[index, i] != run_text(run):
                            for node in [n for n in run if n.tag in (f"{W}t", f"{W}tab", f"{W}br", f"{W}cr")]:
                                run.remove(node)
                            node = ElementTree.SubElement(run, f"{W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
                            node.text = runs[index, i]
                    index += 1
            for i, node in enumerate(field_nodes(root)):
                node.text = (fields or {}).get((part, i), node.text)
            if ElementTree.tostring(root) != before:
                changed[part] = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
        for name in names:
            made.writestr(name, (media or {}).get(name, changed.get(name, package.read(name))))
    return out.getvalue()
