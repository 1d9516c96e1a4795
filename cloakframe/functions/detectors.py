"""Detectors: each maps a text column to an array of spans, in native expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions import policy
from cloakframe.functions.address import address_spans
from cloakframe.functions.lexicon import Lexicon
from cloakframe.functions.spans import let, matches, no_spans, typed

#: Priorities, and the patterns of the closed forms. (?U) gives Java the Unicode classes.
STRUCTURED, CONTEXTUAL, GAZETTEER, MODEL = 100, 80, 60, 40
EMAIL = r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
WEBSITE = r"(?U)\b(?:https?://|www\.)[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+[A-Za-z0-9/]"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?U)\b(?:{OCTET}\.){{3}}{OCTET}\b"
SSN = r"(?U)\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"
CARD = r"(?U)\b(?:\d[ \-]?){12,18}\d\b"
PHONE_PLUS = r"(?U)\+\s?\d{1,3}[\s\-]?\d[\d\s\-]{6,15}\d"
PHONE_LABEL = r"(?iU)\b(?:tele?phone|tel|phone|mobile|fax|contact\s+no|helpline)\b\s*+(?:no\.?|number)?\s*+[:.\-]?\s*+(\+?\s?\d[\d\s\-()]{7,17}\d)"
PHONE_NANP = r"(?U)\+1 \(\d{3}\) \d{3}-\d{4}"
DIN_LABEL = r"(?iU)\bDIN\b\s*(?:no\.?|number)?\s*[:.\-]?\s*(\d{6,8})"
DIN_BARE = r"(?U)\b\d{8}\b"
BIRTH = (
    r"(?U)(?i:\b(?:date\s+of\s+birth|d\.?o\.?b\.?|born\s+on|birth\s+date)\b\s*+[:\-]?\s*+)"
    r"(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{1,2}\s+[A-Z][a-z]+,?\s+\d{4}|[A-Z][a-z]+\s+\d{1,2},?\s+\d{4})"
)
FORMS = (
    r"(?:Private\s+Limited|Public\s+Limited|Limited|Ltd\.?|LLP|L\.L\.P\.?|LLC|L\.L\.C\.?|Inc\.?|Incorporated|Corporation|Corp\.?|GmbH|PLC"
    r"|N\.?V\.?|B\.?V\.?|A\.?G\.?|S\.?A\.?|Pte\.?\s+Ltd\.?|Family\s+Trust|HUF)"
)
CORPORATE = rf"(?U)\b((?:[A-Z][\w'’.\-]*\s+|&\s+|[A-Z]{{2,}}\s+){{1,6}}{FORMS})\b"
LEADING = r"(?U)^(?:(?:Formerly|Erstwhile|Namely|Viz\.?|Including|Between|Amongst|Among|And|Or|From|With|By|To)\s+)+"
# End of the fixed values.


@dataclass(frozen=True)
class Detector:
    """A named detector; ``find`` takes the text and the context's columns and gives (start, end, text) spans."""

    name: str
    entity_type: str
    priority: int
    find: Callable[[Column, Context], Column]
    #: What a text must have for the detector to look at it; detectors of one gate share the test.
    gate: str = ""
    #: Further kinds among the spans: name, priority, and which they are. The others are of the detector's own.
    also: tuple[tuple[str, int, Callable[[Column], Column]], ...] = ()
    #: Whether a span counts, given itself and the character after it.
    accept: Callable[[Column, Column], Column] | None = None


@dataclass(frozen=True)
class Context:
    """What a document taught: columns beside the text, and the policy."""

    lexicon: Lexicon = policy.LEXICON
    glossary: Column | None = None
    dins: Column | None = None
    persons: Column | None = None
    orgs: Column | None = None
    #: True accepts an address before a full stop, as at a sentence's end.
    ip_before_stop: bool = False


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def email(text: Column, c: Context) -> Column:
    return matches(text, EMAIL)


def website(text: Column, c: Context) -> Column:
    return F.filter(matches(text, WEBSITE), lambda s: ~F.exists(policy.strings(c.lexicon.kept_sites), lambda k: F.contains(F.lower(s["text"]), k)))


def ipv4(text: Column, c: Context) -> Column:
    found = matches(text, IPV4)
    return found if c.ip_before_stop else F.filter(found, lambda s: F.substring(text, s["end"] + 1, 1) != ".")


def is_card(s: Column, following: Column) -> Column:
    return let(digits(s["text"]), lambda d: F.length(d).between(13, 19) & F.left(d, F.lit(1)).isin("3", "4", "5", "6") & F.call_function("luhn_check", d))


def phones(text: Column, c: Context) -> Column:
    """Numbers with a plus, and labelled ones that aren't these; eight digits or more."""
    found = lambda pattern, labelled: F.filter(
        F.transform(matches(text, pattern, labelled), lambda s: s.withField("labelled", F.lit(labelled))), lambda s: F.length(digits(s["text"])) >= 8
    )
    first = F.when(F.contains(text, F.lit("+")), found(PHONE_PLUS, False)).otherwise(no_phones())
    others = lambda plus: F.filter(found(PHONE_LABEL, True), lambda s: ~F.exists(plus, lambda f: (f["start"] == s["start"]) & (f["end"] == s["end"])))
    return let(first, lambda plus: F.concat(plus, others(plus)))


def no_phones() -> Column:
    return F.array().cast("array<struct<start:int,end:int,text:string,labelled:boolean>>")


def din_bare(text: Column, c: Context) -> Column:
    if c.dins is None:
        return matches(F.lit(""), DIN_BARE)
    return F.filter(matches(text, DIN_BARE), lambda s: F.coalesce(F.array_contains(c.dins, s["text"]), F.lit(False)))


def corporate(text: Column, c: Context) -> Column:
    def bare(s: Column) -> Column:
        value = F.regexp_replace(s["text"], LEADING, "")
        return F.struct((s["end"] - F.length(value)).alias("start"), s["end"].alias("end"), value.alias("text"))

    return F.filter(
        F.transform(matches(text, CORPORATE), bare),
        lambda s: ~policy.is_allowlisted_org(s["text"], c.lexicon) & ~policy.is_defined_term(s["text"], c.glossary) & ~policy.is_only_generic(s["text"], c.lexicon),
    )


def term_words(term: Column) -> Column:
    return F.array_remove(F.split(term, r"(?U)[^\w]+"), "")


def term_pattern(terms: Column) -> Column:
    """One alternation for an array of terms: longest first, any punctuation between their words, not inside a word or address."""
    ranked = F.transform(F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda q: q["t"])
    one = lambda t: F.when(F.size(term_words(t)) > 0, F.array_join(term_words(t), r"[\s,.\-–—&/]+")).otherwise(F.concat(F.lit(r"\Q"), t, F.lit(r"\E")))
    return F.concat(F.lit(r"(?iuU)(?<![\w@.])(?:"), F.array_join(F.transform(ranked, one), "|"), F.lit(r")(?![\w@])"))


def gazetteer(text: Column, terms: Column | None) -> Column:
    """Spans of a document's terms. Only terms whose first word the text has go into its pattern, which few texts need."""
    none = matches(F.lit(""), EMAIL)
    if terms is None:
        return none
    first = lambda t: F.coalesce(F.try_element_at(term_words(t), F.lit(1)), t)
    present = let(F.lower(text), lambda low: F.filter(terms, lambda t: F.contains(low, F.lower(first(t)))))
    found = lambda own: F.when(F.size(own) > 0, let(term_pattern(own), lambda p: matches(text, p))).otherwise(none)
    return F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, let(present, found)).otherwise(none)


#: The order decides ties between spans of equal priority, length and start.
REGISTRY: tuple[Detector, ...] = (
    Detector("regex:email", "EMAIL", STRUCTURED, email, "@"),
    Detector("regex:corporate", "ORG", CONTEXTUAL, corporate, "form"),
    Detector("regex:website", "WEBSITE", STRUCTURED, website, "site"),
    Detector("regex:ssn", "SSN", STRUCTURED, lambda t, c: matches(t, SSN), "digits"),
    Detector("regex:credit_card", "CREDIT_CARD", STRUCTURED, lambda t, c: matches(t, CARD), "digits", accept=is_card),
    Detector("regex:ip", "IP_ADDRESS", STRUCTURED, ipv4, "digits"),
    Detector("regex:phone", "PHONE", STRUCTURED, phones, "digits", (("regex:phone", CONTEXTUAL, lambda s: s["labelled"]),)),
    Detector("contextual:din", "DIN", STRUCTURED, lambda t, c: matches(t, DIN_LABEL, True), "digits"),
    Detector("contextual:din:gazetteer", "DIN", GAZETTEER, din_bare, "digits"),
    Detector("contextual:dob", "DATE_OF_BIRTH", CONTEXTUAL, lambda t, c: matches(t, BIRTH, True), "digits"),
    Detector("contextual:address", "ADDRESS", CONTEXTUAL, lambda t, c: address_spans(t), "", (("contextual:address:markers", GAZETTEER + 1, lambda s: ~s["pin"]),)),
    Detector("gazetteer:person", "PERSON", GAZETTEER, lambda t, c: gazetteer(t, c.persons)),
    Detector("gazetteer:org", "ORG", GAZETTEER, lambda t, c: gazetteer(t, c.orgs)),
)
#: Cheap tests that a text must pass for the detectors of a gate.
GATES: dict[str, Callable[[Column], Column]] = {
    "@": lambda t: F.contains(t, F.lit("@")),
    "site": lambda t: F.contains(t, F.lit("://")) | F.contains(t, F.lit("www.")),
    "digits": lambda t: F.regexp_like(t, F.lit(r"(?Us)\d.?.?\d")),
    "form": lambda t: F.regexp_like(t, F.lit(FORMS)),
}
#: Extensions that are not part of the default set.
NANP = Detector("regex:phone_nanp", "PHONE", STRUCTURED, lambda t, c: matches(t, PHONE_NANP))


def spans_of(detector: Detector, text: Column, context: Context, ord_: int) -> Column:
    """A detector's typed spans; its further kinds have the next places in the order."""
    kinds = [(detector.name, detector.priority, lambda s: ~reduce(or_, (which(s) for _, _, which in detector.also), F.lit(False))), *detector.also]

    def named(found: Column) -> Column:
        if detector.accept:
            found = F.filter(found, lambda s: detector.accept(s, F.substring(text, s["end"] + 1, 1)))
        if not detector.also:
            return typed(found, detector.entity_type, detector.name, detector.priority, ord_)
        return F.concat(*[typed(F.filter(found, which), detector.entity_type, name, priority, ord_ + i) for i, (name, priority, which) in enumerate(kinds)])

    return let(detector.find(text, context), named)


def candidates(text: Column, context: Context = Context(), detectors: tuple[Detector, ...] = REGISTRY) -> Column:
    """All detectors' spans of a text, before conflicts are settled. Each gate is tested once."""
    by_gate: dict[str, list[Column]] = {}
    place = 0
    for d in detectors:
        by_gate.setdefault(d.gate, []).append(spans_of(d, text, context, place))
        place += 1 + len(d.also)
    parts = by_gate.pop("", [])
    parts += [F.when(GATES[gate](text), F.concat(no_spans(), *found)).otherwise(no_spans()) for gate, found in by_gate.items()]
    return F.concat(no_spans(), *parts)


def ner_spans(ents: Column, lexicon: Lexicon = policy.LEXICON) -> Column:
    """Spans of a model's entities, array<struct<start, text, label>>: trimmed, and filtered by the policy."""

    def trimmed(e: Column) -> Column:
        value = F.regexp_replace(e["text"], r"(?U)^\s+|\s+$", "")
        start = e["start"] + F.length(e["text"]) - F.length(F.regexp_replace(e["text"], r"(?U)^\s+", ""))
        return F.struct(
            start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"), value.alias("text"), e["label"].alias("entity_type"),
            F.concat(F.lit("spacy:"), F.lower(e["label"])).alias("detector"), F.lit(MODEL).alias("priority"), F.lit(sum(1 + len(d.also) for d in REGISTRY)).alias("ord"),
        )

    keep = lambda s: ((s["entity_type"] == "PERSON") & ~policy.is_person_noise(s["text"], lexicon=lexicon)) | (
        (s["entity_type"] == "ORG") & ~policy.is_allowlisted_org(s["text"], lexicon) & (F.length(s["text"]) > 3)
    )
    return F.filter(F.transform(ents, trimmed), keep)
