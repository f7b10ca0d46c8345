"""Quality rules by host, native throughout.

Each document is counted and tested by a few rules. Failures are aggregated by host (the
``source`` column), and each host's failure rates are shrunk towards the rate over all
hosts with a beta prior whose strength the spread of the hosts' rates gives (method of
moments). A host whose shrunk rate of some rule is high is rejected with all documents, a
host where hardly any document fails is trusted, and elsewhere a document stands for itself.

All counts are array and string functions on whole texts; hosts are reduced map-side.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import fresh, stage

LEAST_WORDS = 50
HOST_REJECTED = 0.5
HOST_TRUSTED = 0.01
RULES = ("symbols", "repeated_lines", "repeated_words", "word_length")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def with_counts(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts; a null text has no words.

    ``n_repeat_words`` sorts a text's 3-word windows together with their places, marks those
    equal to a neighbour and adds up the words they cover; only texts with some equal windows
    are sorted.
    """
    text, words, lines, grams, placed, found = fresh(
        documents.select(*keep), "text0", "words0", "lines0", "grams0", "placed0", "found0"
    )
    c = F.col
    df = documents.select(*keep, F.coalesce(c("text"), F.lit("")).alias(text))
    df = df.select(
        *keep,
        text,
        F.array_remove(F.split(c(text), r"[\x20\x09-\x0D]+"), "").alias(words),
        F.filter(F.split(c(text), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
    )
    df = df.select(
        *keep,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(words) > 3,
            F.transform(
                F.slice(words, 1, F.size(words) - 2),
                lambda word, i: F.concat_ws(" ", word, F.get(c(words), i + 1), F.get(c(words), i + 2)),
            ),
        ).alias(grams),
    )
    counts = [name for name in COUNTS if name != "n_repeat_words"]
    df = df.select(
        *keep,
        *counts,
        F.when(
            F.size(F.array_distinct(grams)) < F.size(grams),
            F.sort_array(F.transform(grams, lambda gram, i: F.struct(gram.alias("gram"), i.alias("at")))),
        ).alias(placed),
    )
    equal = lambda x, i: x["gram"].eqNullSafe(F.get(c(placed), i)["gram"])
    df = df.select(
        *keep,
        *counts,
        F.sort_array(
            F.transform(
                F.filter(c(placed), lambda x, i: equal(x, i - 1) | equal(x, i + 1)), lambda x: x["at"]
            )
        ).alias(found),
    )
    covered = F.aggregate(
        c(found),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total")),
        lambda acc, at: F.struct(
            at.alias("last"), (acc["total"] + F.least(F.lit(3), at - acc["last"])).alias("total")
        ),
        lambda acc: acc["total"],
    )
    return df.select(*keep, *counts, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * n)


def rule_failures() -> dict[str, Column]:
    """Whether a document fails each rule; all in whole numbers.

    One or two repeated lines are no failure: short pages repeat a heading.
    """
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "symbols": 10 * F.col("n_symbols") > chars,
        "repeated_lines": (F.col("n_dup_lines") > 2) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "repeated_words": 100 * F.col("n_repeat_words") > 30 * n,
        "word_length": (chars > 15 * n) | (chars < 2 * n),
    }


def host_verdicts(counted: DataFrame, host: str) -> DataFrame:
    """(host, verdict): ``reject``, ``trust`` or ``mixed``; documents without host are one host.

    The prior of a rule: mean m over all documents, strength m (1 - m) / v - 1 within 1 and
    10,000, where v is the spread of the hosts' rates beyond what chance gives.
    """
    fails = rule_failures()
    hosts = counted.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), *(F.sum(fails[rule].cast("long")).alias(rule) for rule in RULES)
    )
    means = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n").alias("n"), *(F.sum(rule).alias(rule) for rule in RULES)
    ).first()
    total = max(means["n"] or 0, 1)
    mean = {rule: (means[rule] or 0) / total for rule in RULES}
    spread = hosts.agg(
        *(F.sum(F.col("n") * F.pow(F.col(rule) / F.col("n") - mean[rule], 2)).alias(rule) for rule in RULES)
    ).first()
    rates = []
    for rule in RULES:
        m, chance = mean[rule], mean[rule] * (1 - mean[rule])
        beyond = max((spread[rule] or 0) / total - chance * means["hosts"] / total, 1e-9)
        strength = min(max(chance / beyond - 1, 1.0), 10_000.0)
        rates.append((F.col(rule) + m * strength) / (F.col("n") + strength))
    worst = reduce(lambda a, b: F.greatest(a, b), rates)
    verdict = F.when(worst > HOST_REJECTED, "reject").when(worst < HOST_TRUSTED, "trust").otherwise("mixed")
    return hosts.select("host", verdict.alias("host_verdict"))


def judge(documents: DataFrame, keep: list[str], host: str = "source") -> DataFrame:
    """The columns ``keep`` of every document with counts, base_failed, host_verdict and kept.

    Rows are staged once in the shared folder, so texts are read a single time. Repeated rows
    count each. ``keep`` has to name ``host``; columns of these names in it are not allowed.
    """
    counted = stage(with_counts(documents, keep), "counted", "zstd")
    verdicts = host_verdicts(counted, host)
    failed = reduce(or_, rule_failures().values())
    kept = (
        ~base_failed()
        & (F.col("host_verdict") != "reject")
        & ((F.col("host_verdict") == "trust") | ~failed)
    )
    joined = counted.join(verdicts, F.col(host).eqNullSafe(F.col("host")), "left").drop("host")
    return joined.select("*", base_failed().alias("base_failed"), kept.alias("kept"))


def drop_rejected(documents: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, with their columns as they were, whatever their names."""
    plain = [f"c{i}" for i in range(len(documents.columns))]
    renamed = documents.toDF(*plain)
    at = {name: plain[documents.columns.index(name)] for name in ("text", host)}
    named = renamed.withColumn("text", F.col(at["text"]))
    judged = judge(named, plain, at[host])
    return judged.where("kept").select(*plain).toDF(*documents.columns)
