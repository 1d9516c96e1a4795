import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import deliver
from cloakframe.operators import evaluate as ev
from cloakframe.operators import redact as rd
from cloakframe.operators import verify as vf
from cloakframe.sources import audit, docx
from cloakframe.streaming.detect import audit_stream, windowed_counts

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package():
    run = lambda t, bold="": f'<w:r>{bold}<w:t xml:space="preserve">{t}</w:t></w:r>'
    body = (
        f"<w:p>{run('E-mail: con', '<w:rPr><w:b/></w:rPr>')}<w:hyperlink>{run('tact@acme')}</w:hyperlink>{run('.example.org; x &amp; y')}</w:p><w:p/>"
        f"<w:tbl><w:tr><w:tc><w:p>{run('Term')}</w:p></w:tc><w:tc><w:p>{run('Description')}</w:p></w:tc></w:tr>"
        f"<w:tr><w:tc><w:p>{run('Board/ Directors')}</w:p></w:tc><w:tc><w:p>{run('the board')}</w:p></w:tc></w:tr></w:tbl>"
        '<w:p><w:r><w:instrText>HYPERLINK "mailto:hidden@acme.example.org"</w:instrText></w:r></w:p>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}><w:p>{run('10.1.2.3 header')}</w:p></w:hdr>")
        z.writestr("word/media/image1.png", b"pixels")
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package())
    blocks = docx.load_blocks(spark, str(tmp_path)).orderBy("block_index").collect()
    assert [b.text for b in blocks] == ["E-mail: contact@acme.example.org; x & y", "Term", "Description", "Board/ Directors", "the board", "10.1.2.3 header"]
    assert [(x.start, x.end) for x in blocks[0].layout] == [(0, 11), (11, 20), (20, 39)]
    parts = docx.load_package(spark, str(tmp_path))
    assert parts["field"].first().text == 'HYPERLINK "mailto:hidden@acme.example.org"'
    assert parts["media"].first().content_type == "image/png"
    assert parts["cell"].count() == 4
    made, _ = rd.redact(docx.load_blocks(spark, str(tmp_path)), tables=parts["cell"])
    runs = {(r.block_index, r.run_idx): r.text for r in rd.apply_to_runs(parts["run"], made).collect()}
    fields, _ = rd.redact_fields(parts["field"])
    hidden = {("word/document.xml", r.block_index): r.redacted for r in fields.collect()}
    new = docx.rewrite_package(package(), runs, hidden, {"word/media/image1.png": b"blank"})
    records = list(docx.read_package(new))
    text = "".join(r["text"] for k, r in records if k in ("run", "field"))
    assert "acme" not in text and "10.1.2.3" not in text and "@example.com" in text
    assert [r["bold"] for k, r in records if k == "run"][:3] == [True, False, False]
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.read("word/media/image1.png") == b"blank" and z.testzip() is None


def test_folders_are_redacted_and_verified(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "sub").mkdir(parents=True)
    (source / "a.docx").write_bytes(package())
    (source / "sub" / "b.docx").write_bytes(package())
    blank = {"image/png": b"a neutral png"}
    made = deliver.redact_folder(spark, str(source), str(target), blank)
    assert sorted(r.name for r in made["written"].collect()) == ["a.docx", "sub/b.docx"]
    summary = made["summary"].first()
    assert (summary.hidden_field_values, summary.image_parts, summary.replacements) == (2, 2, 4) and summary.gazetteer["glossary"] == 4
    report = deliver.verify_folder(spark, str(source), str(target), blank).first()
    assert report.passed and report.documents == 2 and report.source_values == 6
    # What is left of the sources is found: here, all of one file.
    (target / "a.docx").write_bytes(package())
    report = deliver.verify_folder(spark, str(source), str(target), blank).first()
    assert not report.passed and (report.visible_leaks, report.hidden_leaks, report.media_differences, report.structure_differences) == (2, 1, 1, 0)
    with pytest.raises(Exception, match="no placeholder"):
        deliver.redact_folder(spark, str(source), str(target), {"image/jpeg": b"x"})


def test_headers_by_section_and_structure(tmp_path):
    run = lambda t, mark="": f'<w:r><w:rPr>{mark}</w:rPr><w:t>{t}</w:t></w:r>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="header2.xml"/><Relationship Id="r2" Target="/word/footer9.xml"/></Relationships>'
    section = f'<w:sectPr xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:headerReference w:type="first" r:id="r1"/><w:footerReference w:type="default" r:id="r2"/></w:sectPr>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        bold, off = run("b", "<w:b/>"), run("c", '<w:b w:val="false"/>')
        z.writestr("word/document.xml", f"<w:document {W}><w:body><w:p>{run('a')}{bold}{off}</w:p><w:tbl/>{section}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", rels)
        for name in ("header1", "header2", "footer9"):
            z.writestr(f"word/{name}.xml", f"<w:hdr {W}><w:p>{run(name)}</w:p></w:hdr>")
        z.writestr("customXml/item1.xml", f"<x {W}><w:instrText>MAILTO q@r.org</w:instrText></x>")
    records = list(docx.read_package(out.getvalue()))
    assert [r["text"] for k, r in records if k == "run"] == ["a", "b", "c", "footer9", "header2", "header1"]
    assert [r["part"] for k, r in records if k == "field"] == ["customXml/item1.xml"]
    assert [r for k, r in records if k == "structure"] == [{"paragraphs": 1, "tables": 1, "sections": 1, "bold_runs": 1, "sound": True}]


def spans(*rows):
    return [{"start": s, "end": e, "entity_type": k} for s, e, k in rows]


@pytest.fixture(scope="module")
def pairs(spark):
    kind = "array<struct<start:int,end:int,entity_type:string>>"
    rows = [
        ("a", "x" * 20, spans((0, 5, "EMAIL"), (6, 9, "PERSON")), spans((0, 4, "EMAIL"), (0, 5, "EMAIL"), (7, 12, "ORG"))),
        ("b", "y" * 10, spans((1, 3, "SSN")), spans((1, 3, "SSN"))),
        ("c", "z" * 7, [], []),
    ]
    return spark.createDataFrame(rows, f"stratum string, text string, gold {kind}, predicted {kind}")


def test_scores(pairs):
    strict = {r.entity_type: r for r in ev.score_spans(pairs, True).collect()}
    assert (strict["EMAIL"].tp, strict["EMAIL"].fp, strict["EMAIL"].fn, strict["EMAIL"].f1) == (1, 1, 0, 0.6667)
    assert "SSN" not in strict and (strict["MICRO_AVG"].tp, strict["MICRO_AVG"].fp, strict["MICRO_AVG"].fn) == (2, 2, 1)
    assert strict["MACRO_AVG"].recall == round(1 / 3, 4)
    relaxed = {r.entity_type: r for r in ev.score_spans(pairs, False).collect()}
    assert (relaxed["EMAIL"].tp, relaxed["EMAIL"].fp) == (1, 1)
    chars = ev.score_characters(pairs).first()
    assert (chars.tp_chars, chars.fp_chars, chars.fn_chars, chars.tn_chars) == (9, 3, 1, 24)
    assert chars.accuracy == round(33 / 37, 6)
    assert {r.stratum for r in ev.score_spans(pairs, True, by_stratum=True).collect()} == {"a", "b"}


def test_gold_and_samples(spark):
    blocks = spark.createDataFrame([(0, "a.b a.b axb"), (1, "none")], "block_index int, text string")
    marks = spark.createDataFrame([(0, "a.b", "EMAIL")], "block_index int, surface string, entity_type string")
    assert [(r.start, r.end) for r in ev.gold_offsets(blocks, marks).orderBy("start").collect()] == [(0, 3), (4, 7)]
    with pytest.raises(Exception, match="annotation"):
        ev.gold_offsets(blocks, marks.withColumn("block_index", F.lit(1))).collect()
    rows = spark.range(1000).select(F.col("id").cast("int").alias("block_index"))
    strata = [("front", 0, 700, 45), ("rest", 0, 10**6, 400)]
    one = ev.stratified_sample(rows, strata)
    assert {r.stratum: r["count"] for r in one.groupBy("stratum").count().collect()} == {"front": 45, "rest": 300}
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, ev.stratified_sample(rows.repartition(5), strata).collect()))
    two = ev.stratified_sample(rows, strata, exclude=one)
    assert two.join(one, "block_index").count() == 0


def test_evaluation_driver(spark, tmp_path):
    rows = [(0, "mail a.b@c.org and x.y@z.org"), (1, "Phone: +91 98765 43210"), (2, "nothing"), (3, "host 10.0.0.1")]
    blocks = spark.createDataFrame(rows, "block_index int, text string").selectExpr("1L AS doc_id", "block_index", "concat('body#', block_index) AS block_id", "text")
    sample = ev.stratified_sample(blocks, [("front", 0, 2, 9), ("rest", 0, 99, 9)])
    marks = spark.createDataFrame([(0, "a.b@c.org", "EMAIL"), (0, "mail", "PERSON"), (1, "+91 98765 43210", "PHONE")], "block_index int, surface string, entity_type string")
    gold = ev.gold_blocks(sample, blocks, marks)
    audit.write_gold(str(tmp_path / "gold"), gold)
    gold = audit.read_gold(spark, str(tmp_path / "gold"))
    reports = ev.evaluate(gold, rd.detect(blocks))
    strict = {r.entity_type: (r.tp, r.fp, r.fn) for r in reports["strict"].collect()}
    assert strict["EMAIL"] == (1, 1, 0) and strict["PERSON"] == (0, 0, 1) and strict["PHONE"] == (1, 0, 0) and strict["MICRO_AVG"] == (2, 2, 1)
    assert {(r.kind, r.type) for r in reports["errors"].collect()} == {("missed", "PERSON"), ("spurious", "EMAIL"), ("spurious", "IP_ADDRESS")}
    assert {r.stratum for r in reports["by_stratum"].collect()} == {"front", "rest"}
    audit.write_evaluation(str(tmp_path / "reports"), reports)
    assert spark.read.json(f"{tmp_path}/reports/strict").count() == reports["strict"].count()
    assert ev.report_table(reports["strict"], "Strict").count("| EMAIL |") == 1
    assert {r.entity_type: r.spans for r in ev.counts_by_type(gold.selectExpr("explode(entities.entity_type) AS entity_type")).collect()} == {"EMAIL": 1, "PERSON": 1, "PHONE": 1}
    with pytest.raises(ValueError, match="not in the sample"):
        ev.gold_blocks(sample.where("block_index <> 0"), blocks, marks)
    assert [sum(n for *_, n in ev.DESIGNS[v]) for v in ("v1", "v2")] == [130, 200]


def test_verify_and_sinks(spark, tmp_path):
    blocks = spark.createDataFrame([(1, 0, "b#0", "mail a.b@acme.org now"), (1, 1, "b#1", "plain")], "doc_id long, block_index int, block_id string, text string")
    made, mapping = rd.redact(blocks)
    values = rd.source_values(made)
    report = vf.audit_report(made, rd.detection_audit(made), mapping.select("entity_type", "source_sha256", "replacement"), values).first()
    assert report.passed and report.detections == 1
    assert vf.structure_differences(blocks, made).count() == 0
    bad = made.withColumn("redacted", F.col("text"))
    assert vf.leaks(bad, values).count() == 1 and vf.email_leaks(bad).count() == 1
    media = spark.createDataFrame([(1, "p", "image/png", bytearray(b"x"))], "doc_id long, part string, content_type string, content binary")
    assert vf.media_differences(media, {"image/png": b"x"}).count() == 0 and vf.media_differences(media, {}).count() == 1
    audit.write_audit(str(tmp_path / "out"), made, rd.detection_audit(made), rd.mapping_audit(mapping), rd.run_summary(made))
    assert audit.read_mapping(spark, str(tmp_path / "out/mapping")).first().entity_type == "EMAIL"
    assert audit.manifest(spark, str(tmp_path / "out"), "part-*").where("length(sha256) = 64").count() >= 4


def test_hidden_audit(spark, tmp_path):
    fields = spark.createDataFrame([(1, "doc.xml", 0, "HYPERLINK mailto:a.b@acme.example.org"), (1, "doc.xml", 1, None)], "doc_id long, part string, idx int, text string")
    media = spark.createDataFrame([(1, "p", "image/png", bytearray(b"x"))], "doc_id long, part string, content_type string, content binary")
    audit.write_hidden_audit(str(tmp_path), rd.field_audit(rd.redact_fields(fields)[0]), rd.redact_media(media, {"image/png": b"y"}))
    row = audit.read_json_lines(spark, f"{tmp_path}/field_code_redactions", "part string, field string, entity_type string, source_sha256 string, replacement string").collect()
    assert [(r.part, r.field, r.entity_type, len(r.source_sha256)) for r in row] == [("doc.xml", "instruction", "EMAIL", 64)]
    assert spark.read.json(f"{tmp_path}/media_redactions").first().action == "replaced_with_neutral_placeholder"


def test_streams(spark, tmp_path):
    schema = "doc_id long, text string, at timestamp"
    spark.createDataFrame([(1, "host 10.0.0.1 now\nArjun Mehta", None)], schema).withColumn("at", F.lit("2025-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    gaz = spark.createDataFrame([(1, "person", "Arjun Mehta")], "doc_id long, kind string, term string")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = audit_stream(stream, gaz).writeStream.format("memory").queryName("spans").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.entity_type for r in spark.table("spans").collect()} == {"IP_ADDRESS", "PERSON"}
    run = windowed_counts(stream, "at", "text").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [(r.entity_type, r.spans) for r in spark.table("counts").collect()] == [("IP_ADDRESS", 1)]


def test_properties(spark, sf_dir):
    """Spans are disjoint, text outside them is untouched, and partitions don't matter."""
    from cloakframe.plans.queries import fixture

    blocks = fixture(spark, sf_dir)
    one, _ = rd.redact(blocks)
    rows = one.collect()
    for r in rows:
        ends = [0, *[e.end for e in r.edits]]
        assert all(e.start >= before for e, before in zip(r.edits, ends, strict=False))
        left = r.redacted
        for e in r.edits:
            assert e.replacement in left
        gaps = "".join(r.text[a:b] for a, b in zip(ends, [*[e.start for e in r.edits], len(r.text)], strict=True))
        assert len(left) == len(gaps) + sum(len(e.replacement) for e in r.edits)
    two, _ = rd.redact(blocks.repartition(7))
    assert sorted((r.doc_id, r.block_index, r.redacted) for r in rows) == sorted((r.doc_id, r.block_index, r.redacted) for r in two.collect())
