"""Quality rules whose failures are judged by host.

Every document gets rule metrics from column functions alone. Failures are summed by host, each
rate is shrunk towards the rate of all hosts by a beta prior fitted to the hosts, and the verdict
of a host (bad for a rule where the shrunken rate passes `host_limit`) is joined back: a document
is rejected if it fails a base rule, or an extra rule for which its host is bad.

Defined cases: a null text has no words and fails; a null host is a host of its own; hosts with few
documents follow the prior; repeated rows are judged row by row and count once each for their host;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import SPACE, SPACE_RE
from driftline.operators.groups import lookup_groups
from driftline.session import cut

SYMBOLS = "#*$%&|<>"
WINDOW = 8
RULES = ("few_words", "repeated", "symbols", "dup_lines")
EXTRA = ("symbols", "dup_lines")


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    host_limit: float = 0.5


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def rule_metrics(docs: DataFrame, keep=("doc_id", "source")) -> DataFrame:
    """Word, symbol, line and repetition counts of every whole text, beside the kept columns."""
    text = F.coalesce("text", F.lit(""))
    first = docs.select(*keep, text.alias("_text")).withColumn(
        "_words", F.filter(F.split("_text", SPACE_RE), lambda w: w != "")).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda x: _without(x, SPACE) > 0))
    n = F.size("_words")
    counted = first.select(
        *keep, n.cast("long").alias("n_words"), _without(F.col("_text"), SPACE).cast("long").alias("word_chars"),
        (F.length("_text") - _without(F.col("_text"), SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                                        lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).alias("_hash"))
    # Windows sorted by content: equal ones are neighbours. Most texts have none and skip the sort.
    some = F.size(F.array_distinct("_hash")) < F.size("_hash")
    ordered = counted.withColumn("_sorted", F.when(some, F.array_sort(
        F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twice(x, k):
        near = lambda j: F.coalesce(F.get("_sorted", j)["h"] == x["h"], F.lit(False))
        return near(k - 1) | near(k + 1)

    starts = F.array_sort(F.transform(F.filter("_sorted", twice), lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")))["n"]
    return ordered.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_hash", "_sorted")


def rule_failures(metrics: DataFrame, limits: Limits) -> DataFrame:
    """One boolean column per rule."""
    c = F.col
    return metrics.withColumns({
        "few_words": c("n_words") < limits.min_words,
        "repeated": 100 * c("n_repeat_words") > limits.max_repeat_percent * c("n_words"),
        "symbols": 100 * c("n_symbols") > limits.max_symbol_percent * c("word_chars"),
        "dup_lines": 100 * c("n_dup_lines") > limits.max_dup_line_percent * c("n_lines"),
    })


def host_verdicts(failures: DataFrame, limits: Limits, host="source") -> DataFrame:
    """Per host: documents `n`, and per rule the failures, the shrunken rate and the verdict.

    The prior of a rule has the mean of all documents and the spread of the hosts' rates (method of
    moments); it weighs at least 2 and at most 1,000 documents.
    """
    hosts = failures.groupBy(host).agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    moments = hosts.agg(F.struct(*[F.struct(
        F.coalesce(F.sum(r) / F.sum("n"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(F.col(r) / F.col("n")), F.lit(0.0)).alias("var")).alias(r) for r in RULES])).scalar()
    out = hosts.withColumn("_m", moments)
    for r in RULES:
        mean, var = F.col("_m")[r]["mean"], F.col("_m")[r]["var"]
        weight = F.when(var > 0, F.greatest(F.lit(2.0), F.least(F.lit(1000.0), mean * (1 - mean) / var - 1))).otherwise(1000.0)
        rate = (F.col(r) + mean * weight) / (F.col("n") + weight)
        out = out.withColumns({f"{r}_rate": rate, f"{r}_bad": rate >= limits.host_limit})
    return out.drop("_m")


def apply_rules(docs: DataFrame, limits=Limits(), key="doc_id", host="source") -> DataFrame:
    """Metrics and verdict (`base_failed`, `kept`) of every row; no text is moved."""
    failures = cut(rule_failures(rule_metrics(docs, (key, host)), limits).withColumn(host, F.coalesce(host, F.lit(""))))
    verdicts = cut(host_verdicts(failures, limits, host)).select(host, "n", *[f"{r}_bad" for r in EXTRA])
    judged = lookup_groups(failures, verdicts, [host])
    by_host = F.lit(False)
    for r in EXTRA:
        by_host = by_host | (F.col(r) & F.coalesce(f"{r}_bad", F.lit(False)))
    base = F.col("few_words") | F.col("repeated")
    return judged.select("*", base.alias("base_failed"), (~base & ~by_host).alias("kept"))


def reject_by_rules(docs: DataFrame, limits=Limits()) -> DataFrame:
    """The rows of `docs` with all columns that pass. Rules run once and their flags are written
    beside the rows; only rows that fail an extra rule are moved to meet the verdict on their host."""
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_row"), F.coalesce("source", F.lit("")).alias("_host"), "text")
    flagged = cut(rule_failures(rule_metrics(rows, ("_row", "_host")), limits).select("_row", "_host", *RULES))
    verdicts = cut(host_verdicts(flagged.select("_host", *RULES), limits, "_host")).select(
        "_host", "n", *[f"{r}_bad" for r in EXTRA])
    passed = flagged.filter(~F.col("few_words") & ~F.col("repeated"))
    extra, bad = F.lit(False), F.lit(False)
    for r in EXTRA:
        extra = extra | F.col(r)
        bad = bad | (F.col(r) & F.coalesce(f"{r}_bad", F.lit(False)))
    suspects = lookup_groups(passed.filter(extra), verdicts, ["_host"]).filter(~bad)
    kept = passed.filter(~extra).select("_row").unionAll(suspects.select("_row"))
    return kept.select(*[F.col("_row")[c].alias(c) for c in names])
