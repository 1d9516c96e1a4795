"""Quality rules with host-level verdicts, in native DataFrame expressions only.

Rules measure each document. Their failures are aggregated by host; each host's
failure rate is shrunk with a beta prior fitted to all hosts by moments; hosts
whose shrunk rate is over a limit are rejected, and the verdict is joined back
to their documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import aside, let, spaced, stored, words

WINDOW = 8


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_percent: int = 30
    #: Characters of ``[#*$%&|<>]`` for each 100 words.
    max_symbol_percent: int = 10
    #: Repeated lines for each 100 lines that have a word.
    max_dup_line_percent: int = 50
    #: Hosts whose shrunk failure rate is over this are rejected.
    max_host_rate: float = 0.5


def repeat_words(tokens: Column) -> Column:
    """Words covered by WINDOW-word windows that occur twice or more."""

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))

        def repeated(s: Column) -> Column:
            triples = F.arrays_zip(
                s.alias("x"),
                F.concat(nothing, F.slice(s, 1, F.size(s) - 1)).alias("before"),
                F.concat(F.slice(s, 2, F.size(s)), nothing).alias("after"),
            )
            twice = F.filter(
                triples,
                lambda t: F.coalesce(t["x"]["h"] == t["before"]["h"], F.lit(False)) | F.coalesce(t["x"]["h"] == t["after"]["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(twice, lambda t: t["x"]["i"]))

        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            let(ordered, repeated),
            start,
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    def joined(hashes: Column, step: int) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))

    def distinct_or_covered(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered(hashes))

    def of(ones: Column) -> Column:
        # Hashes of 2, 4 and 8 words from each position, by doubling.
        eights = let(joined(ones, 1), lambda twos: let(joined(twos, 2), lambda fours: joined(fours, 4)))
        windows = F.slice(eights, 1, F.size(ones) - (WINDOW - 1))
        return F.when(F.size(ones) < WINDOW + 1, F.lit(0).cast("bigint")).otherwise(let(windows, distinct_or_covered))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns and ``m``, a struct of the rules' measurements.

    Null text counts as empty. Windows are compared by 64-bit hashes of the
    hashes of their words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bare = body
    for symbol in "#*$%&|<>":
        bare = F.replace(bare, F.lit(symbol), F.lit(""))

    lines = F.filter(F.split(body, "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))

    def of(plain: Column) -> Column:
        return F.struct(
            F.length(F.replace(plain, F.lit(" "), F.lit(""))).cast("bigint").alias("word_chars"),
            (F.length(body) - F.length(bare)).cast("bigint").alias("n_symbols"),
            let(lines, lambda ls: F.struct(F.size(ls).cast("bigint").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("dup"))).alias("lines"),
            let(words(plain), lambda ws: F.struct(F.size(ws).cast("bigint").alias("n"), repeat_words(ws).alias("repeat"))).alias("words"),
        )

    return docs.withColumn("m", let(spaced(F.col(text)), of))


def judge(docs: DataFrame, host: str = "source", text: str = "text", rules: QualityRules = QualityRules(), drop: tuple[str, ...] = ()) -> DataFrame:
    """Documents with ``m``, ``base_failed``, ``doc_failed``, ``host_rate``, ``host_ok`` and ``kept``.

    ``drop`` names columns to leave out of the result, as the text of a report.
    A document is kept if it fails no rule and its host is not rejected. A null
    host is a host of its own. With no documents there are no rows. If all hosts
    have the same rate, the prior has the weight of one document for each
    document, at least; ties at the limit keep the host. Columns of the input
    that clash with the new ones are replaced.

    Documents are measured once, and stored in the shared folder with the columns
    that the caller reads. Hosts are aggregated with map-side sums, so a hot host
    costs a row for each task. Their table is joined back by Spark's choice of join.
    Rows are judged one by one, so repeated ones stay and count twice for their
    host; texts are measured whole, however long.
    """
    new = ["m", "base_failed", "doc_failed", "host_rate", "host_ok", "kept"]
    docs, back = aside(docs.drop(*[c for c in docs.columns if c.lower() in new or c in drop and c not in (host, text)]), host, text)
    m = F.col("m")
    base = (m["words"]["n"] < rules.min_words) | (100 * m["words"]["repeat"] > rules.max_repeat_percent * m["words"]["n"])
    soft = (100 * m["n_symbols"] > rules.max_symbol_percent * m["words"]["n"]) | (
        100 * m["lines"]["dup"] > rules.max_dup_line_percent * m["lines"]["n"]
    )
    measured = measure(docs, text)
    measured = stored(measured.drop(*[c for c in drop if c in (host, text)]).withColumn("base_failed", base).withColumn("doc_failed", F.col("base_failed") | soft))
    hosts = host_rates(measured.select(F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("_host"), "doc_failed"))
    # Stored, so that its size is known: a small table is broadcast without dealing the documents out by host.
    hosts = stored(hosts.select("_host", "host_rate", (F.col("host_rate") <= rules.max_host_rate).alias("host_ok")))
    named = measured.withColumn("_host", F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")))
    return back(named.join(hosts, "_host", "left").drop("_host").withColumn("kept", ~F.col("doc_failed") & F.col("host_ok")))


def host_rates(failures: DataFrame) -> DataFrame:
    """(_host, n, failed, host_rate) from (_host, doc_failed).

    The beta prior comes from the mean and variance of the hosts' raw rates by
    moments; its weight stays between 1 and 1000 documents.
    """
    hosts = failures.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("doc_failed").cast("int")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("var"))
    weight = F.when(F.col("var") <= 0, F.lit(1000.0)).otherwise(F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1)
    prior = prior.select("mean", F.greatest(F.lit(1.0), F.least(F.lit(1000.0), weight)).alias("weight"))
    # The prior is one row, whatever the input: its broadcast has a fixed size.
    return hosts.crossJoin(F.broadcast(prior)).select(
        "_host", "n", "failed", ((F.col("failed") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("host_rate")
    )
