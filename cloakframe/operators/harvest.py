"""Pass one: what each document teaches about its own people, organisations and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions import policy
from cloakframe.functions.detectors import DIN_LABEL
from cloakframe.functions.lexicon import Lexicon
from cloakframe.functions.policy import LEXICON
from cloakframe.operators.barrier import barrier

# Cues that name a person or a promoter outright.
NAME = r"((?:[A-Z][\w.'’\-]*\s+){1,3}[A-Z][\w.'’\-]*)"
CUES = {
    "contact": r"(?iU)\bcontact\s+person\s*[:\-]\s*([^\n;]+)",
    "promoter": r"(?iU)\bour\s+promoters?\s*[:\-]\s*([^\n]+)",
    "compliance": r"(?iU)\bcompliance\s+officer\s*[:\-]\s*([^\n;]+)",
    "namely": rf"(?U)\bnamely,?\s+{NAME}",
    "consent": rf"(?U)\bconsent\s+dated\s+[\w\s,]+?\s+from\s+{NAME}",
    "title": r"(?U)\b(?:Mr|Mrs|Ms|Dr|Shri|Smt)\.?\s+((?:[A-Z][\w.'’\-]*\s+){0,3}[A-Z][\w.'’\-]*)",
}
LIST_BREAK = r"(?iU),|\band\b|/|;"
LEGAL_TAIL = r"(?iU)[\s,]*(?:\b(?:Private|Public|Pvt\.?)\b[\s,]*)?\b(?:Limited|Ltd\.?|LLP|LLC|Inc\.?|Corporation|Corp\.?|GmbH|PLC|Trust|HUF)\b[\s.,]*$"
ROMAN_TAIL = r"(?iU)[\s,]*\b(?:I{1,3}|IV|V|VI{1,3}|IX|XI{0,3})\b[\s,]*$"
# End of the fixed values.


def glossary(tables: DataFrame) -> DataFrame:
    """(doc_id, term, term_norm) from two-column tables (doc_id, table_idx, row_idx, col_idx, text) headed as definitions."""
    key = ["doc_id", "table_idx"]
    head = F.lower(F.trim("text"))
    heads = tables.groupBy(*key).agg(
        (F.max("col_idx") == 1).alias("two"),
        F.max(F.when((F.col("row_idx") == 0) & (F.col("col_idx") == 0), head.isin("term", "terms"))).alias("a"),
        F.max(F.when((F.col("row_idx") == 0) & (F.col("col_idx") == 1), head.startswith("descri"))).alias("b"),
    )
    heads = heads.where(F.col("two") & (F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False)))).select(*key)
    term = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    terms = tables.where("row_idx > 0 AND col_idx = 0").join(heads, key, "left_semi").select("doc_id", term.alias("term"))
    return terms.where(F.length("term").between(3, 89)).select("doc_id", "term", F.explode(policy.glossary_terms(F.col("term"))).alias("term_norm")).distinct()


def routed(candidates: DataFrame, value: str, lexicon: Lexicon = LEXICON) -> DataFrame:
    """Adds kind: 'person', 'org' for those with an entity marker, or null."""
    v, g = F.col(value), F.col("glossary") if "glossary" in candidates.columns else None
    return candidates.withColumn("kind", F.when(policy.looks_like_person(v, g, lexicon), "person").when(policy.has_entity_marker(v, lexicon), "org"))


def name_columns(tables: DataFrame, lexicon: Lexicon = LEXICON) -> DataFrame:
    """(doc_id, kind, term) from the table columns headed as names."""
    head = F.lower(F.trim("text"))
    named = tables.where((F.col("row_idx") == 0) & ((head == "name") | head.startswith("name of"))).select("doc_id", "table_idx", "col_idx")
    cells = tables.where("row_idx > 0").join(named, ["doc_id", "table_idx", "col_idx"], "left_semi")
    cells = cells.select("doc_id", policy.clean_candidate(F.regexp_replace("text", r"(?U)\s+", " ")).alias("term"))
    return routed(cells.where(F.length("term").between(1, 80)), "term", lexicon).where("kind IS NOT NULL").select("doc_id", "kind", "term").distinct()


def cue_candidates(blocks: DataFrame, lexicon: Lexicon = LEXICON) -> DataFrame:
    """(doc_id, cue, kind, term) of the names that cues introduce in blocks (doc_id, text)."""
    found = F.array(*[F.struct(F.lit(cue).alias("cue"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("hits")) for cue, p in CUES.items()])
    any_cue = F.regexp_like("text", F.lit(r"(?iU)contact\s+person|promoter|compliance\s+officer|namely|consent\s+dated|\b(?:mr|mrs|ms|dr|shri|smt)\b"))
    rows = blocks.where(any_cue).select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.cue", F.explode("f.hits").alias("hit"))
    parts = rows.select("doc_id", "cue", F.explode(F.split("hit", LIST_BREAK, -1)).alias("part"))
    return routed(parts.select("doc_id", "cue", policy.clean_candidate(F.col("part")).alias("term")), "term", lexicon).where("kind IS NOT NULL").distinct()


def ner_candidates(ner: DataFrame, lexicon: Lexicon = LEXICON) -> DataFrame:
    """(doc_id, kind, term) of a model's entities (doc_id, text, label); a PERSON with a corporate form is an organisation."""
    cleaned = routed(ner.select("doc_id", "label", policy.clean_candidate(F.col("text")).alias("term")).where("term <> ''"), "term", lexicon)
    kind = F.when(F.col("label") == "ORG", "org").when(F.col("label") == "PERSON", F.col("kind"))
    return cleaned.select("doc_id", kind.alias("kind"), "term").where("kind IS NOT NULL").distinct()


def family_names(people: DataFrame, lexicon: Lexicon = LEXICON) -> DataFrame:
    """(doc_id, surname) in lower case, of (doc_id, term, promoter): the promoters', or everyone's where a document has none."""
    any_promoter = F.max(F.col("promoter")).over(Window.partitionBy("doc_id"))
    long = F.filter(F.split("term", r"\s+"), lambda t: F.length(t) > 2)
    names = people.withColumn("_any", any_promoter).where("promoter OR NOT _any").select("doc_id", F.when(F.size(long) >= 2, F.element_at(long, -1)).alias("surname"))
    low = F.lower("surname")
    return names.where((F.length("surname") >= 4) & ~low.isin(*lexicon.generic, *lexicon.noise)).select("doc_id", low.alias("surname")).distinct()


def base_names(orgs: DataFrame, lexicon: Lexicon = LEXICON) -> DataFrame:
    """(doc_id, term): the short forms of organisations (doc_id, term), without legal form and roman numeral."""
    base = F.btrim(F.regexp_replace("term", LEGAL_TAIL, ""))
    short = orgs.select("doc_id", "term", F.explode(F.array_distinct(F.array(base, F.btrim(F.regexp_replace(base, ROMAN_TAIL, ""))))).alias("short"))
    v, words = F.col("short"), F.array_remove(F.split("short", r"\s+"), "")
    good = (F.size(words) >= 2) & (F.lower(v) != F.lower("term")) & ~policy.is_only_generic(v, lexicon) & ~policy.is_allowlisted_org(v, lexicon)
    tail = F.forall(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda w: F.array_contains(policy.strings(lexicon.generic), F.lower(w)))
    return short.where(good & ~tail).select("doc_id", v.alias("term")).distinct()


def din_cues(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(DIN_LABEL), F.lit(1))).alias("term")).distinct()


def table_dins(blocks: DataFrame, people: DataFrame) -> DataFrame:
    """(doc_id, term): blocks that are eight digits within four blocks of a known person (doc_id, term).

    Blocks are numbered without gaps, so the neighbours are looked up by number:
    only the texts around such blocks move.
    """
    found = barrier(blocks.where(F.regexp_like(F.trim("text"), F.lit(r"^\d{8}$"))).select("doc_id", F.col("block_index").alias("_at"), F.trim("text").alias("term")))
    near = found.select("doc_id", "_at", "term", F.explode(F.sequence(F.col("_at") - 4, F.col("_at") + 4)).alias("block_index"))
    texts = blocks.select("doc_id", "block_index", F.lower("text").alias("_low")).join(near, ["doc_id", "block_index"])
    around = texts.groupBy("doc_id", "_at", "term").agg(F.array_sort(F.collect_list(F.struct("block_index", "_low"))).alias("_ls"))
    around = around.select("doc_id", "term", F.array_join("_ls._low", " ").alias("_around"))
    names = people.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.lower("term")).alias("_names"))
    hit = around.join(names, around.doc_id == names["_doc"]).where(F.exists("_names", lambda n: F.contains(F.col("_around"), n)))
    return hit.select("doc_id", "term").distinct()


def harvest(blocks: DataFrame, ner: DataFrame | None = None, tables: DataFrame | None = None, lexicon: Lexicon = LEXICON) -> DataFrame:
    """The gazetteer (doc_id, kind, term) of blocks (doc_id, block_index, text): kinds 'person', 'org', 'din' and 'glossary'.

    Everything is kept by document, so many documents are learned at once. The
    result is a stage boundary: pass two starts when pass one has seen all blocks.
    """
    terms = glossary(tables).select("doc_id", F.lit("glossary").alias("kind"), F.col("term_norm").alias("term")) if tables is not None else None
    if terms is not None:
        held = terms.groupBy("doc_id").agg(F.collect_set("term").alias("glossary"))
        known = blocks.join(held, "doc_id", "left")
    else:
        held, known = None, blocks
    cues = cue_candidates(known, lexicon)
    found = cues.select("doc_id", "kind", "term", (F.col("cue") == "promoter").alias("promoter"))
    for more in ([name_columns(tables, lexicon)] if tables is not None else []) + ([ner_candidates(ner, lexicon)] if ner is not None else []):
        found = found.unionByName(more.withColumn("promoter", F.lit(False)))
    found = barrier(found)  # candidates are few beside the text, and read four times
    people = found.where("kind = 'person'").groupBy("doc_id", "term").agg(F.max("promoter").alias("promoter"))
    families = family_names(people, lexicon).groupBy("doc_id").agg(F.collect_set("surname").alias("families"))
    orgs = found.where("kind = 'org'").select("doc_id", "term").distinct().join(families, "doc_id", "left")
    if held is not None:
        orgs = orgs.join(held, "doc_id", "left")
    allowed = policy.is_redactable_org(F.col("term"), F.col("families"), F.col("glossary") if held is not None else None, lexicon)
    orgs = barrier(orgs.where(allowed).select("doc_id", "term"))
    orgs = orgs.unionByName(base_names(orgs, lexicon)).distinct()
    dins = din_cues(blocks).unionByName(table_dins(blocks, people.select("doc_id", "term"))).distinct()
    parts = [people.select("doc_id", F.lit("person").alias("kind"), "term"), orgs.select("doc_id", F.lit("org").alias("kind"), "term"), dins.select("doc_id", F.lit("din").alias("kind"), "term")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return barrier(out.unionByName(terms.distinct()) if terms is not None else out)


def summary(gazetteer: DataFrame) -> DataFrame:
    return gazetteer.groupBy("kind").agg(F.count(F.lit(1)).alias("terms"))


def by_document(gazetteer: DataFrame) -> DataFrame:
    """One row a document, with its terms of each kind as arrays."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("term")))).alias(f"g_{kind}")
    return gazetteer.groupBy("doc_id").agg(of("person"), of("org"), of("din"), of("glossary"))


def context_columns() -> dict[str, Column]:
    return {"persons": F.col("g_person"), "orgs": F.col("g_org"), "dins": F.col("g_din"), "glossary": F.col("g_glossary")}
