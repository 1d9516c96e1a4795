import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import fakes, policy
from cloakframe.functions.detectors import NANP, REGISTRY, Context, candidates, ner_spans
from cloakframe.functions.spans import SPAN, apply_spans, resolve_overlaps
from cloakframe.operators import harvest as hv
from cloakframe.operators import redact as rd

DETECT = [
    ("write to post@mill.example.net; or not", "EMAIL", ["post@mill.example.net"]),
    ("read http://www.mill.example.net/x?y=2. Then", "WEBSITE", ["http://www.mill.example.net/x?y=2"]),
    ("read www.rbi.org.in/notes", "WEBSITE", []),
    ("a lot of 71,204,900 units at face value", "CREDIT_CARD", []),
    ("paid by 5105 1051 0510 5100 then", "CREDIT_CARD", ["5105 1051 0510 5100"]),
    ("paid by 9234567890123452 then", "CREDIT_CARD", []),
    ("a sum near 5100000000 lakh", "PHONE", []),
    ("Fax: + 44 20712 34567", "PHONE", ["+ 44 20712 34567"]),
    ("phone 044 (2811) 7300", "PHONE", ["044 (2811) 7300"]),
    ("in a letter dated July 4, 2019", "DATE_OF_BIRTH", []),
    ("born on July 4, 1957", "DATE_OF_BIRTH", ["July 4, 1957"]),
    ("date of birth - 04.07.57", "DATE_OF_BIRTH", ["04.07.57"]),
    ("D.O.B.: 4/7/1957", "DATE_OF_BIRTH", []),
    ("SSN 219-09-9999", "SSN", ["219-09-9999"]),
    ("SSN 900-09-9999", "SSN", []),
    ("from 198.51.100.24 on", "IP_ADDRESS", ["198.51.100.24"]),
    ("see 2.7.1.8.2 and 192.0.2.9.", "IP_ADDRESS", []),
    ("DIN: 7654321 and DIN no. 00987654", "DIN", ["7654321", "00987654"]),
    ("(Erstwhile Copper Loom Private Limited)", "ORG", ["Copper Loom Private Limited"]),
    ("of the High Court Limited", "ORG", []),
    ("shown by Leela Iyer whose file has the number K-654321", "ADDRESS", []),
    ("Gat no. 12/ 9, Quiet Residency, Teak Society, lane no. 8 Fern Road, Sample Town – 560034 Sample State, India", "ADDRESS", ["Gat no. 12/ 9, Quiet Residency, Teak Society, lane no. 8 Fern Road, Sample Town – 560034 Sample State, India"]),
    ("Copper Looms Limited Loom House, Plot 31, Wharf Road, Sample Town – 560034 Sample State, India", "ADDRESS", ["Loom House, Plot 31, Wharf Road, Sample Town – 560034 Sample State, India"]),
    ("77, Block-3, Teak Trade Centre Off Canal Avenue, East End", "ADDRESS", ["77, Block-3, Teak Trade Centre Off Canal Avenue, East End"]),
    ("Copper Looms Limited B-31, Wharf View, East End", "ADDRESS", ["B-31, Wharf View, East End"]),
    ("Copper Looms Limited, as of 2021, has been asked to file", "ADDRESS", []),
    ("Registered Office: Old Mill, 4 Dyers Street, Pune 411 002; then", "ADDRESS", ["Old Mill, 4 Dyers Street, Pune 411 002"]),
    ("We moved. Flat no. 123456, Fern Street, Pune 411 002, and stayed", "ADDRESS", ["Flat no. 123456, Fern Street, Pune 411 002"]),
    ("one near road, behind it all and so on\nOld Mill, Sector 4, Canal Colony;", "ADDRESS", ["one near road, behind it all and so on", "Old Mill, Sector 4, Canal Colony"]),
    ("😀 post é@x p.q@r.st", "EMAIL", ["p.q@r.st"]),
    ("", "EMAIL", []),
    (None, "EMAIL", []),
]


def test_detectors(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(DETECT)], "i int, text string")
    got = {r.i: r.c for r in rows.select("i", candidates(F.coalesce("text", F.lit(""))).alias("c")).collect()}
    for i, (text, kind, want) in enumerate(DETECT):
        found = [s for s in got[i] if s.entity_type == kind]
        assert [s.text for s in found] == want, text
        assert all(text[s.start : s.end] == s.text for s in got[i])


def test_gazetteer_and_dins(spark):
    rows = [("a note by Teak & Fern, LLP, who audit", ["Teak & Fern, LLP"]), ("FOUNDERS: LEELA IYER", ["LEELA IYER"]), ("Xleela iyer @leela iyer", []), ("list: 00987654 and 88888888", ["00987654"])]
    context = Context(persons=F.array(F.lit("Leela Iyer")), orgs=F.array(F.lit("Teak & Fern LLP")), dins=F.array(F.lit("00987654")))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, text string")
    for r in df.select("i", candidates(F.col("text"), context).alias("c")).collect():
        assert [s.text for s in r.c if s.priority == 60] == rows[r.i][1]
    none = Context(persons=F.array().cast("array<string>"))
    assert df.select(candidates(F.col("text"), none).alias("c")).where(F.exists("c", lambda s: s["entity_type"] == "PERSON")).count() == 0


def test_nanp_and_ner(spark):
    df = spark.createDataFrame([("call +1 (555) 123-4567",)], "text string")
    assert [s.text for s in df.select(candidates(F.col("text"), detectors=(*REGISTRY, NANP)).alias("c")).first().c] == ["+1 (555) 123-4567"]
    ents = spark.createDataFrame([([(3, " Maya Patel ", "PERSON"), (20, "SEBI", "ORG"), (30, "Director", "PERSON")],)], "e array<struct<start:int,text:string,label:string>>")
    assert [(s.start, s.text) for s in ents.select(ner_spans(F.col("e")).alias("s")).first().s] == [(4, "Maya Patel")]


def span(start, end, priority, kind="ORG", ord_=0):
    return (start, end, "x" * (end - start), kind, "d", priority, ord_)


def test_resolve_overlaps(spark):
    cases = [
        ([span(0, 5, 80), span(0, 40, 40, "ADDRESS")], [(0, 5)]),
        ([span(10, 20, 1), span(0, 5, 1)], [(0, 5), (10, 20)]),
        ([span(0, 5, 60, ord_=2), span(0, 5, 60, "PERSON", 1)], [(0, 5)]),
        ([span(0, 4, 9), span(3, 8, 9), span(7, 9, 9)], [(3, 8)]),
        ([], []),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], f"i int, s array<{SPAN}>")
    for r in df.select("i", resolve_overlaps(F.col("s")).alias("k")).collect():
        assert [(s.start, s.end) for s in r.k] == cases[r.i][1]
        if r.i == 2:
            assert r.k[0].entity_type == "PERSON"


def test_apply_spans(spark):
    df = spark.createDataFrame([("a😀bcdef", [(2, 4, "XYZ"), (5, 6, "")]), ("same", [])], "t string, e array<struct<start:int,end:int,replacement:string>>")
    assert [r[0] for r in df.select(apply_spans(F.col("t"), F.col("e"))).collect()] == ["a😀XYZdf", "same"]


def test_apply_spans_that_overlap(spark):
    cases = [([(1, 4, "X"), (3, 6, "Y")], "aX Yg"), ([(1, 6, "X"), (2, 4, "Y"), (6, 7, "Z")], "aXZ"), ([(1, 3, "X"), (1, 5, "Y")], "aX Yfg")]
    df = spark.createDataFrame([("abcdefg", e) for e, _ in cases], "t string, e array<struct<start:int,end:int,replacement:string>>")
    assert [r[0] for r in df.select(apply_spans(F.col("t"), F.col("e"))).collect()] == [want for _, want in cases]


@pytest.mark.parametrize(
    "value,want",
    [("RBI", 0), ("Companies Act, 1956", 0), ("NSE", 0), ("High Court", 0), ("Bid Amount", 0), ("Copper Looms Limited", 1), ("Teak & Co. LLP", 1), ("Fern Alloys NV", 1), ("Iyer Family Trust", 1), ("Public Limited", 0), ("Mehta Pumps", 1)],
)
def test_org_policy(spark, value, want):
    made = policy.is_redactable_org(F.lit(value), F.array(F.lit("mehta")), F.array(F.lit("bid amount")))
    assert spark.range(1).select(made).first()[0] == bool(want)


def test_person_policy(spark):
    noise = ["Bid Amount", "Floor Price", "Key Managerial Personnel", "Mutual Funds", "Gram Jyoti", "ISO 9001:2015", "Northpoint Industrial Park VI Private Limited", "McDonald Smith", "arjun mehta", "Arjun"]
    names = ["Arjun Mehta", "Maya Patel", "Anita Rao", "ANITA RAO"]
    df = spark.createDataFrame([(v,) for v in noise + names], "v string")
    assert [r.v for r in df.where(~policy.is_person_noise(F.col("v"), strict=True)).collect()] == names
    assert [r.v for r in df.where(policy.looks_like_person(F.col("v"))).collect()] == names


def test_mapping(spark):
    rows = [
        ("PHONE", "+ 44 (20) 7123 4567"), ("PHONE", "+44 20 7123 4567"), ("ORG", "Teak & Fern LLP"), ("ORG", "Teak & Fern, LLP"), ("ORG", "Copper Looms LLC"),
        ("WEBSITE", "https://a.example.org"), ("WEBSITE", "http://b.example.org"), ("EMAIL", "a.b@c.de"), ("CREDIT_CARD", "5105-1051-0510-5100"), ("SSN", "123-45-6789"), ("IP_ADDRESS", "10.0.0.1"),
        ("DATE_OF_BIRTH", "March 3, 1961"), ("DIN", "0012345"), ("ADDRESS", "1 Road, Town"), ("OTHER", "x"), *[("PERSON", f"Name{i} Person") for i in range(1500)],
    ]
    df = spark.createDataFrame([(i, 0, k, v) for i, (k, v) in enumerate(rows)], "block_index int, start int, entity_type string, text string")
    one = fakes.mapping(df).collect()
    by = {(r.entity_type, r.canonical): r for r in one}
    assert len(by) == len(rows) - 2
    assert sorted(map(tuple, fakes.mapping(df.repartition(7)).collect())) == sorted(map(tuple, one))
    people = [r.replacement for r in one if r.entity_type == "PERSON"]
    assert len(set(people)) == 1500
    get = lambda k: next(r.replacement for r in one if r.entity_type == k)
    assert get("PHONE").startswith("+91 ") and len(get("DIN")) == 7 and get("EMAIL").endswith("@example.com") and get("OTHER") == "[OTHER]"
    assert by["ORG", "copper looms llc"].replacement.endswith(" LLC")
    assert {r.replacement.split("www")[0] for r in one if r.entity_type == "WEBSITE"} == {"https://", "http://"}
    number = get("CREDIT_CARD")
    assert number.count("-") == 3 and spark.range(1).select(F.call_function("luhn_check", F.lit(number.replace("-", "")))).first()[0]
    assert all(len(r.source_sha256) == 64 for r in one)


BLOCKS = [
    (1, 0, "Contact Person: Arjun Mehta, Company Secretary; Tel: +91 98765 43210"),
    (1, 1, "OUR PROMOTERS: MAYA PATEL AND NORTHPOINT FAMILY TRUST"),
    (1, 2, "arjun mehta wrote to a.b@acme.example.org from 10.1.2.3"),
    (1, 3, "Arjun Mehta"),
    (1, 4, "00123456"),
    (1, 5, "Northpoint Industrial Park VI Private Limited and Patel Electricals Limited"),
    (1, 6, "SSN 123-45-6789, card 4539 5787 6362 1486, Date of Birth: March 3, 1961, www.acme.example.org"),
    (1, 7, "Plot 7, Lake Road, Horizon Tower, Example City – 411004 Example State, India"),
    (2, 0, "Arjun Mehta is unknown here, as is 00123456"),
]


def test_two_passes(spark):
    blocks = spark.createDataFrame(BLOCKS, "doc_id long, block_index int, text string").withColumn("block_id", F.concat(F.lit("body#"), "block_index"))
    tables = spark.createDataFrame([(1, 0, 0, 0, "Name of entity"), (1, 0, 1, 0, "Acme Metals Limited"), (1, 1, 0, 0, "Term"), (1, 1, 0, 1, "Description"), (1, 1, 1, 0, "Board/ Board of Directors"), (1, 1, 1, 1, "x")], "doc_id long, table_idx int, row_idx int, col_idx int, text string")
    gaz = {(r.doc_id, r.kind, r.term) for r in hv.harvest(blocks, tables=tables).collect()}
    assert {(1, "person", "Arjun Mehta"), (1, "person", "MAYA PATEL"), (1, "org", "NORTHPOINT FAMILY TRUST"), (1, "din", "00123456"), (1, "org", "Acme Metals Limited"), (1, "org", "Acme Metals"), (1, "glossary", "board of directors")} <= gaz
    assert not any(d == 2 for d, _, _ in gaz)
    out, mapping = rd.redact(blocks, tables=tables)
    out = out.cache()
    by = {(r.doc_id, r.block_index): r for r in out.collect()}
    assert len(by) == len(BLOCKS)
    whole = "\n".join(r.redacted for k, r in by.items() if k[0] == 1).lower()
    for secret in ("arjun mehta", "maya patel", "98765", "acme.example.org", "10.1.2.3", "00123456", "123-45-6789", "4539", "1961", "lake road, horizon"):
        assert secret not in whole
    assert by[2, 0].redacted == BLOCKS[-1][2]
    assert by[1, 2].redacted.split(" wrote")[0] == by[1, 3].redacted.lower()
    summary = rd.run_summary(out).first()
    assert summary.blocks_scanned == 9 and set(summary.by_type) == {"PERSON", "ORG", "EMAIL", "PHONE", "ADDRESS", "SSN", "CREDIT_CARD", "DATE_OF_BIRTH", "IP_ADDRESS", "WEBSITE", "DIN"}
    audit = rd.detection_audit(out)
    assert audit.count() == summary.replacements and "source" not in audit.columns
    assert rd.mapping_audit(mapping).columns == ["entity_type", "source_sha256", "replacement"]


def test_runs_and_media(spark):
    runs = spark.createDataFrame([(1, 0, 0, "E-mail: con", True), (1, 0, 1, "tact@acme", False), (1, 0, 2, ".org; x", True)], "doc_id long, block_index int, run_idx int, text string, bold boolean")
    edits = spark.createDataFrame([(1, 0, [(8, 24, "f@example.com")])], "doc_id long, block_index int, edits array<struct<start:int,end:int,replacement:string>>")
    assert [(r.text, r.bold) for r in rd.apply_to_runs(runs, edits).orderBy("run_idx").collect()] == [("E-mail: f@example.com", True), ("", False), ("; x", True)]
    media = spark.createDataFrame([(1, "a.png", "image/png", bytearray(b"x"))], "doc_id long, part string, content_type string, content binary")
    assert rd.redact_media(media, {"image/png": b"p"}).first().content == b"p"
    with pytest.raises(Exception, match="no placeholder"):
        rd.redact_media(media.withColumn("content_type", F.lit("image/gif")), {"image/png": b"p"}).collect()


def luhn(body):
    """The body with its check digit."""
    total = sum(x - 9 * (x > 9) for x in (int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(reversed(body))))
    return f"{body}{-total % 10}"


def test_fakes_are_distinct_and_well_formed(spark):
    """As many values as a corpus has: no fake twice, none its own source, each of its type's form."""
    n = 4000
    made = {
        "PERSON": lambda i: f"Name{i} Person", "EMAIL": lambda i: f"u.{i}@x.org" if i % 2 else f"u{i}@x.org", "PHONE": lambda i: f"+91 {i:05} {i * 7 % 100_000:05}" if i % 2 else f"0{i:08}",
        "ORG": lambda i: f"Firm {i} Limited", "ADDRESS": lambda i: f"Plot {i}, Road", "DIN": lambda i: f"{i:08}", "SSN": lambda i: f"{i % 665 + 1:03}-{i // 665 + 1:02}-{i + 1:04}",
        "CREDIT_CARD": lambda i: luhn(f"{3 + i % 4}{i:0{11 + i % 7}}"), "IP_ADDRESS": lambda i: f"10.{i >> 8}.{i & 255}.1", "WEBSITE": lambda i: f"https://w{i}.org",
        "DATE_OF_BIRTH": lambda i: f"{i % 28 + 1}/{i // 28 % 12 + 1}/{1900 + i // 336 * 9}",
    }
    form = {
        "EMAIL": r"[a-z.]+@example\.com", "PHONE": r"\+91 \d{5} \d{5}|\d{9}", "DIN": r"\d{8}", "SSN": r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", "CREDIT_CARD": r"[3-6]\d{12,18}", "ORG": r"[A-Z][a-z]+ [A-Z][a-z]+ Limited",
        "IP_ADDRESS": r"((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}", "WEBSITE": r"https://www\.[a-z]+\.example\.com", "PERSON": r"[A-Z][a-z]+ [A-Z][a-z]+", "ADDRESS": r".+ Road, .+ - 9\d{5}", "DATE_OF_BIRTH": r"[A-Z][a-z]+ \d{2}, \d{4}",
    }
    rows = [(0, i, kind, make(i)) for kind, make in made.items() for i in range(n)]
    mapped = fakes.mapping(spark.createDataFrame(rows, "block_index int, start int, entity_type string, text string")).collect()
    for kind in made:
        own = [r for r in mapped if r.entity_type == kind]
        values = [r.replacement for r in own]
        assert len(own) == len(set(values)) == len({make[3] for make in rows if make[2] == kind}), kind
        assert all(re.fullmatch(form[kind], v) for v in values), (kind, [v for v in values if not re.fullmatch(form[kind], v)][:3])
        assert all(r.replacement.lower() != r.first_original.lower() for r in own), kind
        if kind == "CREDIT_CARD":
            assert all(luhn(v[:-1]) == v for v in values) and {len(v) for v in values} == {len(r.first_original) for r in own}
        if kind == "DATE_OF_BIRTH":
            assert all(datetime.strptime(v, "%B %d, %Y") for v in values)


def test_namesakes_are_numbered(spark, monkeypatch):
    """Where one fake is all that can be drawn, the values that draw it are told apart, and its own source gets another."""
    monkeypatch.setattr(fakes, "FIRST", ("Riya",))
    monkeypatch.setattr(fakes, "VOWELS", "aaaa")
    monkeypatch.setattr(fakes, "draw", lambda h, k, n: F.lit(0))
    word = fakes.made_word
    monkeypatch.setattr(fakes, "made_word", lambda h, n: word(F.lit("0" * 64), n))
    monkeypatch.setattr(fakes, "built", lambda key, make: make())
    rows = [(0, i, "PERSON", v) for i, v in enumerate(["Riya Bababababa", *[f"Name{i} Some" for i in range(300)]])]
    mapped = fakes.mapping(spark.createDataFrame(rows, "block_index int, start int, entity_type string, text string")).collect()
    assert len({r.replacement for r in mapped}) == 301 and {"Riya Bababababa"} < {r.replacement for r in mapped}
    assert all(r.replacement.lower() != r.first_original.lower() for r in mapped)
