"""External-to-local product mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import moment
from larder.functions.predicates import Moment
from larder.operators.merging import last_per_key, merge_by_key, unknown_rows
from larder.operators.products import ACTIVE

# Item categories that need a local product, and the label suffix.
MAPPED_CATEGORIES = ("sorvetes", "acai")
INACTIVE_SUFFIX = " (inativo)"


def needs_mapping(category: Column) -> Column:
    return F.lower(category).isin(*MAPPED_CATEGORIES)


def product_mapping_list(mapping: DataFrame, product: DataFrame) -> DataFrame:
    """Mappings with the description of the local product."""
    names = product.select(
        F.col("id").alias("local_product_id"), F.col("description").alias("local_product_desc")
    )
    return mapping.join(names, "local_product_id", "left").select(
        "external_product_id", "external_name", "local_product_id", "local_product_desc"
    )


def product_mapping_upsert(
    mapping: DataFrame, edits: DataFrame, as_of: Moment = None, arrival: str | None = None
) -> DataFrame:
    """The mapping after edits; a NULL local id is a value too.

    Of several edits of an external id the last by ``arrival`` stands.
    """
    now, keys = moment(as_of), ["external_product_id"]
    edits = last_per_key(edits, keys, arrival)
    return merge_by_key(
        mapping,
        edits,
        keys,
        update={
            "external_name": F.col("c.external_name"),
            "local_product_id": F.col("c.local_product_id"),
            "updated_at": now,
        },
        new_rows=unknown_rows(mapping, edits, keys).withColumn("updated_at", now),
    )


def mapping_sync(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Items with missing local ids filled from the mapping; set ids never change."""
    mapped = mapping.where(F.col("local_product_id").isNotNull()).select(
        "external_product_id", F.col("local_product_id").alias("mapped_id")
    )
    return items.join(mapped, "external_product_id", "left").select(
        *[
            F.coalesce("local_product_id", "mapped_id").alias(name)
            if name == "local_product_id"
            else F.col(name)
            for name in items.columns
        ],
        (F.col("local_product_id").isNull() & F.col("mapped_id").isNotNull()).alias("filled"),
    )


def mapping_sync_count(synced: DataFrame) -> DataFrame:
    """How many items a sync filled."""
    return synced.agg(F.count_if("filled").alias("updated"))


def local_products(product: DataFrame) -> DataFrame:
    """One product per label; inactive ones carry a suffix, the last in list order wins."""
    suffix = F.when(F.col("status") == ACTIVE, F.lit("")).otherwise(F.lit(INACTIVE_SUFFIX))
    return (
        product.select(
            "id", "description", "status", F.concat("description", suffix).alias("label")
        )
        .groupBy("label")
        .agg(F.max(F.struct("status", "description", "id")).alias("last"))
        .select("label", "last.id", "last.description", "last.status")
    )


def unmapped_products(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct ordered products of the mapped categories without a local product.

    A left join and a NULL test, not an anti join: a mapping whose local id is
    NULL leaves its product unmapped.
    """
    ordered = (
        items.where(needs_mapping(F.col("external_category")))
        .select("external_product_id", "external_product_name", "external_category")
        .distinct()
    )
    known = mapping.select("external_product_id", "local_product_id")
    return (
        ordered.join(known, "external_product_id", "left")
        .where(F.col("local_product_id").isNull())
        .drop("local_product_id")
    )
