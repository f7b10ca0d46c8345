"""URL filters: rules first, then the ratio of two character models, native throughout.

URLs that a rule decides are the examples: two smoothed Markov models of variable order, of
allowed and of blocked URLs, are counted from all of them. A model of order k mixes its
counts with the model of order k - 1,

    p_k(c | context) = (n(context c) + KAPPA * p_(k-1)(c | shorter context)) / (n(context) + KAPPA)

and a context counts only if it was seen ``LEAST`` times. The log ratio of both models is a sum over orders of
one weight for the context and one for the context with its character, both 0 if never
seen. The weights are joined by their own key, order by order, to the distinct grams of all
URLs, so each gram has its exact value however many there are. The score is divided by the length; the threshold is
the one that tells allowed from blocked examples best, with both kinds weighing the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import stage

#: Longest rule first decides; a rule is (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ORDER = 5
KAPPA = 4.0
LEAST = 3
PAD = "\x02"
ANY = "\x01"
BIN = 0.002
MOST_BINS = 5000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The parts after the first ``://``; both empty without it or for a null."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path together, and its verdict; null if none."""
    rule = verdict = F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, name + start).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _padded(url: Column) -> Column:
    return F.concat(F.lit(PAD * (ORDER - 1)), url, F.lit(PAD))


def _bucket(key: Column) -> Column:
    """A key's whole hash, which no two keys share; scores need none, tests compare by it."""
    return F.xxhash64(key)


def count_grams(examples: DataFrame) -> DataFrame:
    """(gram, a, b): how often each run of ``ORDER`` characters ends a step, by verdict.

    ``examples`` has ``url`` and ``verdict``. The characters before a URL are padding.
    """
    grams = examples.select("verdict", F.explode(_grams(F.col("url"))).alias("gram"))
    allowed = (F.col("verdict") == "allow").cast("long")
    return grams.groupBy("gram").agg(F.sum(allowed).alias("a"), F.sum(1 - allowed).alias("b"))


def fit_weights(examples: DataFrame) -> DataFrame:
    """(key, weight) of all contexts and grams of the two models.

    The key of a context is its characters and ``ANY``. Lower orders add up the counts of the
    longest grams, so the examples are read once; the tables are small and staged.
    """
    longest = stage(count_grams(examples), "grams")
    totals = longest.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.countDistinct(F.right("gram", F.lit(1))).alias("kinds")).first()
    kinds = max(totals["kinds"] or 0, 1)
    below = None
    weights = None
    for order in range(1, ORDER + 1):
        grams = longest.groupBy(F.right("gram", F.lit(order)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        before = F.substr(F.col("gram"), F.lit(1), F.lit(order - 1))
        contexts = grams.groupBy(before.alias("context")).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
        contexts = contexts.where(F.col("na") + F.col("nb") >= LEAST)
        shift = F.log((F.col("nb") + KAPPA) / (F.col("na") + KAPPA))
        joined = grams.join(contexts, before == F.col("context"), "left")
        if below is None:
            joined = joined.withColumns({"qa": F.lit(1.0 / kinds), "qb": F.lit(1.0 / kinds)})
        else:
            joined = joined.join(below, F.right("gram", F.lit(order - 1)) == F.col("shorter"))
        used = F.col("na").isNotNull()
        mixed = lambda n, m, q: F.when(used, (F.col(n) + KAPPA * F.col(q)) / (F.col(m) + KAPPA)).otherwise(F.col(q))
        solved = stage(
            joined.select(
                "gram", mixed("a", "na", "qa").alias("pa"), mixed("b", "nb", "qb").alias("pb"),
                F.when(used, F.log(mixed("a", "na", "qa") / mixed("b", "nb", "qb")) - F.log(F.col("qa") / F.col("qb")) - shift).alias("weight"),
            ),
            "model",
        )
        found = solved.where("weight IS NOT NULL").select(F.col("gram").alias("key"), "weight")
        found = found.unionByName(contexts.select(F.concat("context", F.lit(ANY)).alias("key"), shift.alias("weight")))
        weights = found if weights is None else weights.unionByName(found)
        below = solved.select(F.col("gram").alias("shorter"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
    return weights


def _grams(url: Column) -> Column:
    """The runs of ``ORDER`` characters that end at each character of a URL and at its end."""
    text = _padded(url)
    return F.transform(
        F.sequence(F.lit(1), F.length(text) - (ORDER - 1)), lambda i: F.substr(text, i, F.lit(ORDER))
    )


def gram_steps(grams: DataFrame, weights: DataFrame) -> DataFrame:
    """(of, step) of each distinct ``gram``: what its character adds, all orders together.

    Orders build on the shorter one, so that a key meets only the grams that differ in their
    first or last character.
    """
    below = None
    for order in range(1, ORDER + 1):
        ends = grams.select(F.right("gram", F.lit(order)).alias("of")).distinct()
        context = F.concat(F.substr(F.col("of"), F.lit(1), F.lit(order - 1)), F.lit(ANY))
        own = weights.select(F.col("key").alias("k"), F.col("weight").alias("w"))
        before = weights.select(F.col("key").alias("ck"), F.col("weight").alias("cw"))
        joined = ends.join(own, F.col("of") == F.col("k"), "left").join(before, context == F.col("ck"), "left")
        step = F.coalesce("w", F.lit(0.0)) + F.coalesce("cw", F.lit(0.0))
        if below is not None:
            joined = joined.join(below, F.right("of", F.lit(order - 1)) == F.col("shorter"))
            step = step + F.col("rest")
        solved = stage(joined.select("of", step.alias("step")), "steps")
        below = solved.select(F.col("of").alias("shorter"), F.col("step").alias("rest"))
    return solved


def url_scores(urls: DataFrame, weights: DataFrame) -> DataFrame:
    """(url, score) of each distinct URL: the log ratio of both models, a character."""
    distinct = urls.select("url").distinct()
    steps = distinct.select("url", F.explode(_grams(F.col("url"))).alias("gram"))
    values = gram_steps(stage(steps.select("gram").distinct(), "url-grams"), weights)
    valued = steps.join(values, F.col("gram") == F.col("of"))
    summed = valued.groupBy("url").agg(F.sum("step").alias("total"))
    return summed.select("url", (F.col("total") / F.greatest(F.length("url"), F.lit(1))).alias("score"))


def calibrated_threshold(scored: DataFrame) -> float:
    """The score from which on URLs are allowed, in the middle of the best bins.

    Only counts by bin, at most ``2 * MOST_BINS + 1``, are compared. Without examples of both
    verdicts it is the lowest or highest score, so that the one verdict known holds.
    """
    slot = F.greatest(F.least(F.floor(F.col("score") / BIN), F.lit(MOST_BINS)), F.lit(-MOST_BINS))
    bins = scored.where("rule_verdict IS NOT NULL").groupBy(slot.alias("bin")).agg(
        F.sum((F.col("rule_verdict") == "allow").cast("long")).alias("a"),
        F.sum((F.col("rule_verdict") == "block").cast("long")).alias("b"),
    )
    under = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    wrong = bins.select(
        "bin",
        F.sum("a").over(every).alias("all_a"),
        F.sum("b").over(every).alias("all_b"),
        F.coalesce(F.sum("a").over(under), F.lit(0)).alias("lost"),
        F.coalesce(F.sum("b").over(under), F.lit(0)).alias("caught"),
        F.lag("bin").over(Window.orderBy("bin")).alias("previous"),
    )
    error = F.col("lost") / F.col("all_a") + 1 - F.col("caught") / F.col("all_b")
    best = wrong.where("all_a > 0 AND all_b > 0").orderBy(error, "bin").first()
    if best is None:
        blocked = scored.where("rule_verdict = 'block'").limit(1).count()
        return float("inf") if blocked else float("-inf")
    previous = best["bin"] if best["previous"] is None else best["previous"]
    return (best["bin"] + previous + 1) / 2 * BIN


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page.

    A null URL is modelled as empty. Repeated rows count each.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))
    examples = ruled.where("rule_verdict IS NOT NULL").select("url", F.col("rule_verdict").alias("verdict"))
    table = stage(fit_weights(examples), "weights")
    scores = url_scores(ruled, table).withColumnRenamed("url", "of")
    scored = stage(ruled.join(scores, F.col("url") == F.col("of")).drop("of"), "scored")
    threshold = calibrated_threshold(scored)
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"), "score"
    )
