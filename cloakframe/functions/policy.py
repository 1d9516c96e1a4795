"""Which organisation and person candidates count: predicates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.lexicon import Lexicon

LEXICON = Lexicon()


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def normalise(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def tokens(value: Column) -> Column:
    return F.array_remove(F.split(normalise(value), " "), "")


def glossary_terms(term: Column) -> Column:
    """The defined terms of a headword: its slash or semicolon alternatives of over two characters."""
    return F.array_distinct(F.filter(F.transform(F.split(term, "[/;]"), normalise), lambda t: F.length(t) > 2))


def is_defined_term(value: Column, glossary: Column | None = None) -> Column:
    """Whether the glossary (array<string>, normalised) has it, as it is, without an article, or without plural s."""
    if glossary is None:
        return F.lit(False)
    n = normalise(value)
    bare = F.regexp_replace(n, r"^(?:the|our|its)\s+", "")
    held = lambda v: F.coalesce(F.array_contains(glossary, v), F.lit(False))
    return (n != "") & (held(n) | held(bare) | held(F.regexp_replace(bare, "s+$", "")))


def has_entity_marker(value: Column, lexicon: Lexicon = LEXICON) -> Column:
    t = tokens(value)
    tail = F.slice(t, F.greatest(F.size(t) - 1, F.lit(1)), 2)
    return F.arrays_overlap(t, strings(lexicon.strong)) | F.arrays_overlap(tail, strings(lexicon.weak))


def is_only_generic(value: Column, lexicon: Lexicon = LEXICON) -> Column:
    t = tokens(value)
    return (F.size(t) > 0) & F.forall(t, lambda x: F.array_contains(strings(lexicon.generic), x))


def contains_noise(value: Column, lexicon: Lexicon = LEXICON) -> Column:
    return F.arrays_overlap(tokens(value), strings(lexicon.noise))


def is_allowlisted_org(value: Column, lexicon: Lexicon = LEXICON) -> Column:
    n = normalise(value)
    known = strings(lexicon.institutions)
    long = strings([t for t in lexicon.institutions if len(t) > 6])
    if lexicon.whole_word_markers:
        marked = F.exists(strings(lexicon.markers), lambda m: F.contains(F.concat(F.lit(" "), n, F.lit(" ")), F.concat(F.lit(" "), m, F.lit(" "))))
    else:
        marked = F.exists(strings(lexicon.markers), lambda m: F.contains(n, m))
    return (n == "") | F.array_contains(known, n) | F.array_contains(known, F.regexp_replace(n, "^the ", "")) | F.exists(long, lambda t: F.contains(n, t)) | marked


def is_redactable_org(value: Column, families: Column | None = None, glossary: Column | None = None, lexicon: Lexicon = LEXICON) -> Column:
    """A named legal entity, or, with two words or more, a namesake of ``families`` (array<string>, lower case)."""
    namesake = F.lit(False) if families is None else (F.size(tokens(value)) >= 2) & F.coalesce(F.arrays_overlap(tokens(value), families), F.lit(False))
    return (
        (F.length(normalise(value)) >= 4)
        & ~is_only_generic(value, lexicon)
        & ~is_allowlisted_org(value, lexicon)
        & ~is_defined_term(value, glossary)
        & (has_entity_marker(value, lexicon) | namesake)
    )


def is_person_noise(value: Column, strict: bool = False, glossary: Column | None = None, lexicon: Lexicon = LEXICON) -> Column:
    n, t = normalise(value), tokens(value)
    stop = strings(lexicon.person_stopwords)
    noise = (
        (F.length(n) < 4)
        | F.array_contains(stop, n)
        | (F.size(t) < 2)
        | F.forall(t, lambda x: F.array_contains(stop, x))
        | F.arrays_overlap(t, strings(("limited", "ltd", "llp", "trust", "bank")))
    )
    if not strict:
        return noise
    capital = lambda w: ((F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1))) & F.regexp_like(w, F.lit(r"^\p{Lu}[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$"))) | (
        F.regexp_like(w, F.lit(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"))
    )
    return (
        noise
        | (F.size(t) > 5)
        | F.regexp_like(value, F.lit(r"(?U)[():/\\@\d]"))
        | contains_noise(value, lexicon)
        | is_defined_term(value, glossary)
        | F.arrays_overlap(t, stop)
        | F.arrays_overlap(t, strings((*lexicon.strong, *lexicon.weak)))
        | F.arrays_overlap(t, strings(lexicon.institutions))
        | (F.size(F.filter(t, lambda x: F.length(x) >= 3)) < 2)
        | ~F.forall(F.array_remove(F.split(value, r"\s+"), ""), capital)
    )


def looks_like_person(value: Column, glossary: Column | None = None, lexicon: Lexicon = LEXICON) -> Column:
    words = F.array_remove(F.split(value, r"\s+"), "")
    return ~is_person_noise(value, True, glossary, lexicon) & F.size(words).between(2, 5) & F.forall(words, lambda w: F.regexp_like(w, F.lit(r"^[A-Za-z][A-Za-z'.\-]*$")))


def clean_candidate(value: Column) -> Column:
    """A candidate without decoration, footnote marks and a role that ran on after it."""
    marks = " \t.,;:-–—()[]*^&#†‡§¶~"
    value = F.regexp_replace(F.btrim(value, F.lit(marks)), r"(?U)\s+", " ")
    roles = (
        r"(?i)\b(?:company secretary|compliance officer|managing director|joint managing director|executive director|independent director"
        r"|whole[- ]time director|chairman|director|chief financial officer)\b.*$"
    )
    return F.btrim(F.regexp_replace(value, roles, ""), F.lit(" ,;-"))
