"""Scores of predicted spans against gold, gold offsets and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.spans import matches

#: The types that get a row of their own in reports.
REPORTED = ("PERSON", "ORG", "EMAIL", "PHONE", "ADDRESS", "DIN", "WEBSITE")


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1 (rounded to 4 places, 0 where undefined) and support."""
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), (tp + fn).alias("support")]


def outcomes(pairs: DataFrame, strict: bool) -> DataFrame:
    """(stratum, entity_type, tp, fp, fn) of pairs (stratum, block_index, gold, predicted), arrays of spans.

    Each gold span, in order, takes the first free prediction of its type that
    equals it (strict) or overlaps it; what is left over is false.
    """

    def hit(g: Column, p: Column) -> Column:
        same = (g["start"] == p["start"]) & (g["end"] == p["end"]) if strict else (p["start"] < g["end"]) & (g["start"] < p["end"])
        return (g["entity_type"] == p["entity_type"]) & same

    numbered = F.transform("predicted", lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["entity_type"].alias("entity_type"), i.alias("i")))
    start = F.struct(numbered.alias("free"), F.array().cast("array<struct<entity_type:string,kind:string>>").alias("out"))

    def step(acc: Column, g: Column) -> Column:
        first = F.try_element_at(F.filter(acc["free"], lambda p: hit(g, p)), F.lit(1))
        result = F.struct(g["entity_type"].alias("entity_type"), F.when(first.isNull(), "fn").otherwise("tp").alias("kind"))
        free = F.when(first.isNull(), acc["free"]).otherwise(F.filter(acc["free"], lambda p: p["i"] != first["i"]))
        return F.struct(free.alias("free"), F.concat(acc["out"], F.array(result)).alias("out"))

    finish = lambda acc: F.concat(acc["out"], F.transform(acc["free"], lambda p: F.struct(p["entity_type"].alias("entity_type"), F.lit("fp").alias("kind"))))
    rows = pairs.select("stratum", F.explode(F.aggregate("gold", start, step, finish)).alias("r")).select("stratum", "r.*")
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    return rows.groupBy("stratum", "entity_type").agg(count("tp"), count("fp"), count("fn"))


def score_spans(pairs: DataFrame, strict: bool, by_stratum: bool = False) -> DataFrame:
    """A row for each reported type, and MICRO_AVG over all types; MACRO_AVG is the mean of the reported rows."""
    keys = ["stratum"] if by_stratum else []
    counts = outcomes(pairs, strict)
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    typed = counts.where(F.col("entity_type").isin(*REPORTED)).groupBy(*keys, "entity_type").agg(*sums)
    micro = counts.groupBy(*keys).agg(*sums).withColumn("entity_type", F.lit("MICRO_AVG")).na.fill(0)
    rows = typed.unionByName(micro).select(*keys, "entity_type", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
    means = [F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")]
    macro = rows.where("entity_type <> 'MICRO_AVG'").groupBy(*keys).agg(*means, F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")
    return rows.unionByName(macro.withColumn("entity_type", F.lit("MACRO_AVG")), allowMissingColumns=True)


def score_characters(pairs: DataFrame) -> DataFrame:
    """The confusion of characters inside and outside spans, over pairs (text, gold, predicted)."""

    def covered(spans: str) -> Column:
        inside = F.filter(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.least(s["end"], F.length("text")).alias("b"))), lambda s: s["a"] < s["b"])
        return F.array_distinct(F.flatten(F.transform(inside, lambda s: F.sequence(s["a"], s["b"] - 1))))

    rows = pairs.select(F.length("text").alias("n"), covered("gold").alias("g"), covered("predicted").alias("p"))
    both = F.size(F.array_intersect("g", "p"))
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(a) for a, c in (("tp_chars", both), ("fp_chars", F.size("p") - both), ("fn_chars", F.size("g") - both), ("total", F.col("n")))])
    tp, fp, fn = F.col("tp_chars"), F.col("fp_chars"), F.col("fn_chars")
    tn = F.col("total") - tp - fp - fn
    return sums.select("tp_chars", "fp_chars", "fn_chars", tn.alias("tn_chars"), F.round(F.coalesce(F.try_divide(tp + tn, F.col("total")), F.lit(0.0)), 6).alias("accuracy"), *prf(tp, fp, fn)[:3])


def gold_offsets(blocks: DataFrame, annotations: DataFrame) -> DataFrame:
    """(block_index, start, end, text, entity_type): every occurrence of each annotated surface; a missing one is an error."""
    pattern = F.concat(F.lit(r"\Q"), F.replace("surface", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    found = annotations.join(blocks.select("block_index", F.col("text").alias("body")), "block_index", "left").withColumn("m", matches(F.coalesce("body", F.lit("")), pattern))
    checked = F.when(F.size("m") > 0, F.col("m")).otherwise(F.raise_error(F.concat(F.lit("annotation not in its block: "), F.col("block_index").cast("string"))))
    return found.select("block_index", "entity_type", F.explode(checked).alias("m")).select("block_index", "m.start", "m.end", "m.text", "entity_type")


def stratified_sample(rows: DataFrame, strata: list[tuple[str, int, int, int]], key: str = "block_index", seed: int = 42, exclude: DataFrame | None = None) -> DataFrame:
    """Exactly min(count, size) rows of each stratum (name, low, high, count) of the key, by a hash of seed and key.

    The first stratum that holds a key counts, so later ones can be the rest.
    """
    if exclude is not None:
        rows = rows.join(exclude.select(key).distinct(), key, "left_anti")
    order, taken, parts = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256), F.lit(False), []
    for label, low, high, count in strata:
        inside = (F.col(key) >= low) & (F.col(key) < high)
        # A sorted limit keeps the first rows in each task, so no task gathers a stratum.
        parts.append(rows.where(inside & ~taken).withColumn("stratum", F.lit(label)).orderBy(order, key).limit(count))
        taken = taken | inside
    return reduce(DataFrame.unionByName, parts)


#: The two designs of the gold sample, as (stratum, first block, end, count). Later strata exclude what
#: earlier ones hold, so the body is what lies outside the reserved ranges.
DESIGNS = {
    "v1": [("front_matter", 0, 700, 45), ("governance", 3550, 3900, 45), ("body", 0, 1 << 31, 40)],
    "v2": [("front_matter", 0, 700, 25), ("mid_document", 700, 3550, 150), ("governance", 3550, 3900, 25)],
}


def counts_by_type(spans: DataFrame, *keys: str) -> DataFrame:
    """Rows (..., entity_type) counted by type, and by further columns."""
    return spans.groupBy(*keys, "entity_type").agg(F.count(F.lit(1)).alias("spans"))


def gold_blocks(sample: DataFrame, blocks: DataFrame, annotations: DataFrame) -> DataFrame:
    """(block_index, stratum, block_id, text, entities): the sampled blocks with all occurrences of their annotated surfaces.

    An annotation of a block outside the sample, or that its block lacks, is an error.
    """
    outside = annotations.join(sample.select("block_index"), "block_index", "left_anti").select("block_index").first()
    if outside:
        raise ValueError(f"annotated block {outside[0]} is not in the sample")
    spans = gold_offsets(blocks, annotations).groupBy("block_index").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text", "entity_type"))).alias("entities"))
    kept = sample.select("block_index", "stratum").join(blocks.select("block_index", "block_id", "text"), "block_index").join(spans, "block_index", "left")
    none = F.array().cast("array<struct<start:int,end:int,text:string,entity_type:string>>")
    return kept.select("block_index", "stratum", "block_id", "text", F.coalesce("entities", none).alias("entities"))


def gold_pairs(gold: DataFrame, detected: DataFrame) -> DataFrame:
    """(stratum, block_id, text, gold, predicted): gold blocks beside what was detected in them, by block index."""
    found = detected.select("block_index", F.col("spans").alias("predicted"))
    return gold.join(found, "block_index", "left").select("stratum", "block_id", "text", F.col("entities").alias("gold"), F.coalesce("predicted", F.array()).alias("predicted"))


def audit_references(pairs: DataFrame) -> DataFrame:
    """(block, kind, type, source_sha256, length) of spans without an exact counterpart: 'missed' and 'spurious', no text."""

    def apart(own: str, other: str, kind: str) -> DataFrame:
        same = lambda x, y: (x["start"] == y["start"]) & (x["end"] == y["end"]) & (x["entity_type"] == y["entity_type"])
        rows = pairs.select("block_id", F.explode(F.filter(own, lambda x: ~F.exists(other, lambda y: same(x, y)))).alias("s"))
        return rows.select(F.col("block_id").alias("block"), F.lit(kind).alias("kind"), F.col("s.entity_type").alias("type"), F.sha2("s.text", 256).alias("source_sha256"), F.length("s.text").alias("length"))

    return apart("gold", "predicted", "missed").unionByName(apart("predicted", "gold", "spurious"))


def evaluate(gold: DataFrame, detected: DataFrame) -> dict[str, DataFrame]:
    """The reports of a detection over whole documents, held against gold blocks: strict, relaxed, by_stratum, characters and errors."""
    pairs = gold_pairs(gold, detected)
    return {
        "strict": score_spans(pairs, True), "relaxed": score_spans(pairs, False), "by_stratum": score_spans(pairs, False, True),
        "characters": score_characters(pairs), "errors": audit_references(pairs),
    }


def report_table(scores: DataFrame, title: str) -> str:
    """A Markdown table of scores: a bounded number of types."""
    rows = scores.orderBy("entity_type").collect()
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    names = scores.columns
    lines = [f"### {title}", "", f"| {' | '.join(names)} |", f"|{' --- |' * len(names)}", *[f"| {' | '.join(cell(r[n]) for n in names)} |" for r in rows]]
    return "\n".join(lines) + "\n"
