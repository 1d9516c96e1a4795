"""Spans as arrays of structs: finding, resolving overlaps and rewriting, in native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string,entity_type:string,detector:string,priority:int,ord:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


_BUILT: dict[tuple, Column] = {}


def built(key: tuple, make: Callable[[], Column]) -> Column:
    """A column that is built once in a Spark process: the calls that build a large one take seconds. Equal keys are equal columns."""
    key = (id(SparkContext._gateway), *key)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: Column, pattern: Column | str, last_group: bool = False) -> Column:
    """array<struct<start, end, text, whole_end>> of a regex's matches, offsets in code points.

    With ``last_group``, the span is group 1, which must end where the match
    ends. Patterns never match the empty string. Rows without a match, the most,
    cost one test.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    whole, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)

    def located(found: Column, parts: Column, values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            end = acc["at"] + F.length(F.get(parts, i)) + F.length(F.get(found, i))
            value = F.get(values, i)
            span = F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("text"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])

    values = F.regexp_extract_all(text, pattern, F.lit(1)) if last_group else whole
    made = let(whole, lambda f: let(between, lambda p: let(values, lambda v: located(f, p, v))))
    return F.when(F.regexp_like(text, pattern), made).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def typed(found: Column, entity: str, detector: str, priority: int, ord_: int) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["text"].alias("text"), F.lit(entity).alias("entity_type"),
            F.lit(detector).alias("detector"), F.lit(priority).alias("priority"), F.lit(ord_).alias("ord"),
        ),
    )


def resolve_overlaps(spans: Column) -> Column:
    """Spans that don't overlap, by start: higher priority wins, then the longer, the earlier, the detector's order."""
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct((-s["priority"]).alias("p"), (s["start"] - s["end"]).alias("l"), s["start"].alias("s"), s["ord"].alias("o"), s.alias("x"))))

    def take(kept: Column, r: Column) -> Column:
        x = r["x"]
        return F.when(F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(x)))

    chosen = F.aggregate(ranked, no_spans(), take)
    return F.when(F.size(spans) == 0, no_spans()).otherwise(F.array_sort(chosen))


def apply_spans(text: Column, edits: Column) -> Column:
    """The text with each (start, end, replacement) of the edits in place of its span; the rest is untouched.

    Of spans that overlap, all of what they cover goes: their replacements
    follow each other with a space between, but those inside of earlier ones
    have nothing left to replace.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        gap = F.when(e["start"] < acc["at"], F.lit(" ")).otherwise(F.substring(text, acc["at"] + 1, e["start"] - acc["at"]))
        after = F.struct(e["end"].alias("at"), F.concat(acc["out"], gap, e["replacement"]).alias("out"))
        return F.when((e["start"] < acc["at"]) & (e["end"] <= acc["at"]), acc).otherwise(after)

    ordered = F.array_sort(edits)
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(edits) == 0, text).otherwise(F.aggregate(ordered, start, step, rest))
