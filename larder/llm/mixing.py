"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, how often it should appear. The rates stay as near as possible
(in bounded relative entropy, so never above ``MOST``) to one base rate for all, under the
constraint that the words of each source add up to its target. The dual of that problem has
one multiplier a source; the rate of a document of ``size`` words is

    MOST / (1 + exp(-(theta + lambda_source * size / mean size of the source)))

Newton steps, safeguarded by bisection, solve the dual. Each step is one aggregation by
source over the histogram of sizes. Rates are then rounded to whole copies: a document's
hash decides who is rounded up first, and a threshold of each source, found by refining
weighted quantiles, makes the copies' words meet the target to within half a document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import WORD, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
STEPS = 200
TOLERANCE = 1e-7
WORST_MISS = 1e-4
BINS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, documents, target) from rows (source, size, n).

    Sources in code point order, null last, weigh ``WEIGHTS`` in turn. Targets are the level
    of a water filling: weight times level, at most ``MOST`` times the source.
    """
    sources = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents")
    )
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn % len(WEIGHTS) + 1).cast("int"))
    cap = F.col("source_size") * MOST
    weighed = sources.withColumn("weight", weight).withColumn("full_at", cap / F.col("weight"))
    everything = Window.partitionBy()
    by_level = Window.orderBy("full_at", "weight", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) * SHARE - filled) / F.sum("weight").over(behind)
    levelled = weighed.withColumn("level", level).withColumn("place", F.row_number().over(by_level))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(everything)
    levelled = levelled.withColumn("final", first["level"])
    target = F.least(cap.cast("double"), F.col("weight") * F.coalesce("final", "full_at"))
    return levelled.select("source", "source_size", "documents", target.alias("target"))


def _rate(slope: Column, z: Column) -> Column:
    """The tilted rate; a slope of null stands for infinity."""
    theta = math.log(SHARE / (MOST - SHARE))
    tilt = F.least(F.greatest(theta + slope * z, F.lit(-700.0)), F.lit(700.0))
    return F.when(slope.isNull(), float(MOST)).otherwise(MOST / (1 + F.exp(-tilt)))


def _solve(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, mean, slope): the multipliers of the dual."""
    reached = F.col("target") >= MOST * F.col("source_size") * (1 - 1e-9)
    state = targets.select(
        "source",
        "source_size",
        "target",
        (F.col("source_size") / F.col("documents")).alias("mean"),
        F.when(~reached, F.lit(0.0)).alias("slope"),
        F.lit(-1e6).alias("low"),
        F.lit(1e6).alias("high"),
        F.lit(1.0).alias("miss"),
    )
    state = stage(state, "multipliers")
    for _ in range(STEPS):
        named = state.withColumnRenamed("source", "of")
        joined = histogram.join(named, F.col("source").eqNullSafe(F.col("of")))
        z = F.col("size") / F.col("mean")
        rate = _rate(F.col("slope"), z)
        words = F.col("size") * F.col("n")
        sums = joined.where("slope IS NOT NULL").groupBy("of").agg(
            F.sum(words * rate).alias("taken"),
            F.sum(words * z * rate * (1 - rate / MOST)).alias("curve"),
        )
        excess = F.col("taken") - F.col("target")
        low = F.when(excess < 0, F.col("slope")).otherwise(F.col("low"))
        high = F.when(excess > 0, F.col("slope")).otherwise(F.col("high"))
        newton = F.col("slope") - excess / F.greatest(F.col("curve"), F.lit(1e-300))
        between = (newton > low) & (newton < high)
        wide = (high - low) > 1e5
        fallback = F.when(wide, F.col("slope") - F.signum(excess) * (1 + F.abs("slope"))).otherwise((low + high) / 2)
        near = F.abs(newton - F.col("slope")) <= 2 * (1 + F.abs("slope"))
        moved = state.join(
            sums.withColumnRenamed("of", "by"), F.col("source").eqNullSafe(F.col("by")), "left"
        ).select(
            "source",
            "source_size",
            "target",
            "mean",
            F.when(F.col("taken").isNull(), F.col("slope"))
            .when(excess == 0, F.col("slope"))
            .when(between & near, newton)
            .otherwise(fallback)
            .alias("slope"),
            F.coalesce(low, "low").alias("low"),
            F.coalesce(high, "high").alias("high"),
            F.coalesce(F.abs(excess) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0)).alias("miss"),
        )
        state = stage(moved, "multipliers")
        miss = state.agg(F.max("miss")).first()[0] or 0.0
        if miss < TOLERANCE:
            break
    else:
        if miss > WORST_MISS:
            raise RuntimeError(f"a source is {miss:.1e} of its target off after {STEPS} steps")
    return state.select("source", "source_size", "target", "mean", "slope")


def _certain(rate: Column) -> Column:
    """Copies that a rate gives for sure; a rate of ``MOST`` leaves its last copy to the threshold."""
    return F.least(F.floor(rate), F.lit(MOST - 1)).cast("long")


def _turn(doc_id: Column, size: Column, rate: Column) -> Column:
    """When a document is rounded up: smaller comes first, from -1 to 1."""
    steps = 1 << 40
    u = F.pmod(F.xxhash64(doc_id, size), F.lit(steps)) / steps
    return u - (rate - _certain(rate))


def plan_mixture(sizes: DataFrame) -> DataFrame:
    """The plan of each source from rows (doc_id, source, size): target, multiplier, threshold.

    ``sizes`` is read several times, so it should be a stored table.
    """
    histogram = stage(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    solved = _solve(histogram, source_targets(histogram))
    rated = sizes.join(
        solved.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))
    )
    rate = _rate(F.col("slope"), F.col("size") / F.col("mean"))
    rated = rated.select("of", "doc_id", "size", "target", rate.alias("rate")).select(
        "of",
        "doc_id",
        "size",
        "target",
        (_certain(F.col("rate")) * F.col("size")).alias("certain"),
        _turn(F.col("doc_id"), F.col("size"), F.col("rate")).alias("turn"),
    )
    rated = stage(rated.where("size > 0"), "rated")
    need = rated.groupBy("of").agg(
        (F.first("target") - F.sum("certain")).alias("need"),
        F.lit(-1.0).alias("start"),
        F.lit(2.0).alias("width"),
    )
    for _ in range(2):
        need = stage(need, "thresholds")
        inside = rated.join(need.withColumnRenamed("of", "by"), F.col("of").eqNullSafe(F.col("by")))
        step = F.col("width") / BINS
        bin_ = F.floor((F.col("turn") - F.col("start")) / step)
        binned = (
            inside.where((F.col("turn") >= F.col("start")) & (F.col("turn") < F.col("start") + F.col("width")))
            .groupBy("of", "need", "start", "width", bin_.alias("bin"))
            .agg(F.sum("size").alias("words"))
        )
        upto = Window.partitionBy("of").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        summed = binned.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        narrowed = (
            summed.where("before <= need")
            .groupBy("of")
            .agg(F.max_by(F.struct("need", "start", "width", "bin", "before"), "bin").alias("x"))
            .select(
                "of",
                (F.col("x.need") - F.col("x.before")).alias("need"),
                (F.col("x.start") + F.col("x.bin") * F.col("x.width") / BINS).alias("start"),
                (F.col("x.width") / BINS).alias("width"),
            )
        )
        none = need.join(narrowed.select(F.col("of").alias("by")), F.col("of").eqNullSafe(F.col("by")), "left_anti")
        need = narrowed.unionByName(none.withColumn("width", F.lit(0.0)))
    need = stage(need, "thresholds")
    inside = rated.join(need.withColumnRenamed("of", "by"), F.col("of").eqNullSafe(F.col("by"))).where(
        (F.col("turn") >= F.col("start")) & (F.col("turn") < F.col("start") + F.col("width"))
    )
    order = Window.partitionBy("of").orderBy("turn", "doc_id", "size")
    last = (
        inside.withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("sum") - F.col("size") / 2 <= F.col("need"))
        .groupBy("of")
        .agg(F.max(F.struct("turn", "doc_id", "size")).alias("last"))
    )
    bounds = need.join(
        last.withColumnRenamed("of", "by"), F.col("of").eqNullSafe(F.col("by")), "left"
    ).select("of", "start", "last")
    return stage(
        solved.join(bounds, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "mixture"
    )


def with_copies(documents: DataFrame, plan: DataFrame, doc_id: str, source: str, size: str, copies: str) -> DataFrame:
    """The rows with the number of copies the plan gives each, and the plan's columns."""
    named = plan.withColumnRenamed("source", "plan_source")
    joined = documents.join(named, F.col(source).eqNullSafe(F.col("plan_source")), "left")
    rate = _rate(F.col("slope"), F.col(size) / F.col("mean"))
    turn = _turn(F.col(doc_id), F.col(size), rate)
    own = F.struct(turn.alias("turn"), F.col(doc_id).alias("doc_id"), F.col(size).alias("size"))
    up = (turn < F.col("start")) | (F.col("last").isNotNull() & (own <= F.col("last")))
    extra = F.when((F.col(size) > 0) & F.coalesce(up, F.lit(False)), 1).otherwise(0)
    whole = F.when(F.col(size) > 0, _certain(rate) + extra).otherwise(1)
    return joined.withColumn(copies, whole.cast("int")).drop("plan_source", "mean", "slope", "start", "last")


def mix(documents: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every document.

    A null or empty text has size 0 and one copy, a null source is a source of its own, and
    repeated rows count each. Without any words all targets are 0.
    """
    sizes = stage(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return with_copies(sizes, plan_mixture(sizes), "doc_id", "source", "size", "copies").select(
        "doc_id", "size", "source_size", "target", "copies"
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mixture itself: the rows of ``documents``, each as often as its copies say.

    Documents without words stay once.
    """
    plain = [f"c{i}" for i in range(len(documents.columns))]
    place = lambda name: f"c{documents.columns.index(name)}"
    renamed = documents.toDF(*plain).withColumn("size", word_count(F.col(place("text"))))
    sizes = renamed.select(F.col(place("doc_id")).alias("doc_id"), F.col(place("source")).alias("source"), "size")
    plan = plan_mixture(stage(sizes, "sizes"))
    counted = with_copies(renamed, plan, place("doc_id"), place("source"), "size", "copies")
    repeated = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.select(*plain).toDF(*documents.columns)
