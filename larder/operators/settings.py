"""Stock-minimum settings: validation and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import moment
from larder.functions.predicates import Moment
from larder.operators.merging import (
    assign_ids,
    highest_id,
    last_per_key,
    merge_by_key,
    unknown_rows,
)


def stock_minimum_validate(edits: DataFrame) -> DataFrame:
    """Marks each edit; a target below the minimum is not accepted."""
    return edits.withColumn(
        "accepted", ~F.coalesce(F.col("target_qty") < F.col("min_qty"), F.lit(False))
    )


def stock_minimum_upsert(
    stock_minimum: DataFrame, edits: DataFrame, as_of: Moment = None, arrival: str | None = None
) -> DataFrame:
    """The settings table after the accepted edits; adds ``action``.

    Of several accepted edits of a product the last by ``arrival`` stands.
    """
    accepted = stock_minimum_validate(edits).where("accepted").withColumnRenamed(
        "product_id", "product"
    )
    settings, keys, now = ("min_qty", "target_qty", "period_days"), ["product"], moment(as_of)
    order = [arrival] if arrival else []
    changes = last_per_key(accepted.select("product", *settings, *order), keys, arrival)
    new = unknown_rows(stock_minimum, changes, keys).withColumn("updated_at", now)
    if "id" in stock_minimum.columns:
        new = assign_ids(new, highest_id(stock_minimum), F.col("product"))
    return merge_by_key(
        stock_minimum,
        changes,
        keys,
        update={name: F.col(f"c.{name}") for name in settings} | {"updated_at": now},
        new_rows=new,
    )
