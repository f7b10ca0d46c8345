"""The product list: overview, filters, flag changes and new products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import contains_text, strip
from larder.operators.merging import assign_ids, highest_id, last_per_key
from larder.operators.stock import CLOSED, OPEN

# Product status ids, display modes and stored exclusion reasons.
ACTIVE, INACTIVE = 1, 2
MODES = ("Todos", "Apenas ativos", "Apenas inativos", "Excluidos de calculos")
PLACEHOLDER_REASON = "Produto placeholder (Vazio/Balde) — excluido de calculos"
NEW_PLACEHOLDER_REASON = "Cadastrado como placeholder"


def products_config(
    product: DataFrame,
    positions: DataFrame,
    status: DataFrame,
    exclude: DataFrame,
    history: DataFrame,
) -> DataFrame:
    """Every product with its positions, boxes, last movement and exclusion flag.

    Positions and history are each reduced to one row per product first. Distinct
    positions are counted in two steps, per position and then per product: that is one
    shuffle by both columns, where three distinct counts would triple the rows.
    """
    codes = status.select(F.col("id").alias("status"), "status_code")
    held = (
        positions.select("product", F.col("id").alias("position"), "status")
        .join(codes, "status", "left")
        .groupBy("product", "position")
        .agg(
            F.bool_or(F.col("status_code") == OPEN).alias("open"),
            F.bool_or(F.col("status_code") == CLOSED).alias("closed"),
        )
        .groupBy(F.col("product").alias("id"))
        .agg(
            F.count("position").alias("total_positions"),
            F.count_if(F.col("open") & F.col("position").isNotNull()).alias("open_qty"),
            F.count_if(F.col("closed") & F.col("position").isNotNull()).alias("closed_qty"),
        )
    )
    moved = history.groupBy(F.col("product").alias("id")).agg(
        F.max("change_date").alias("last_movement")
    )
    marked = exclude.select(F.col("product_id").alias("id"), F.lit(True).alias("marked"))
    none = F.lit(0).cast("bigint")
    return (
        product.join(held, "id", "left")
        .join(moved, "id", "left")
        .join(marked, "id", "left")
        .select(
            "id",
            F.col("description").alias("product_desc"),
            "product_type",
            F.col("status").alias("status_id"),
            F.coalesce("total_positions", none).alias("total_positions"),
            F.coalesce("open_qty", none).alias("open_qty"),
            F.coalesce("closed_qty", none).alias("closed_qty"),
            "last_movement",
            F.col("marked").isNotNull().alias("excluir_calculos"),
        )
    )


def is_active(status_id: Column) -> Column:
    return status_id.eqNullSafe(F.lit(ACTIVE))


def products_metrics(config: DataFrame) -> DataFrame:
    """Products in all, active, inactive and outside the calculations."""
    active = is_active(F.col("status_id"))
    return config.agg(
        F.count("*").alias("total"),
        F.count_if(active).alias("ativos"),
        F.count_if(~active).alias("inativos"),
        F.count_if("excluir_calculos").alias("excluidos"),
    )


def products_filtered(
    config: DataFrame, search: str | None = None, mode: str = MODES[0]
) -> DataFrame:
    """Search by name combined with one of the four display modes."""
    if mode not in MODES:
        raise ValueError(f"unknown display mode {mode!r}, expected one of {MODES}")
    flagged = config.withColumn("ativo", is_active(F.col("status_id")))
    wanted = {
        MODES[0]: F.lit(True),
        MODES[1]: F.col("ativo"),
        MODES[2]: ~F.col("ativo"),
        MODES[3]: F.col("excluir_calculos"),
    }[mode]
    return flagged.where(contains_text(F.col("product_desc"), search) & wanted)


def product_flags_diff(config: DataFrame, edits: DataFrame) -> DataFrame:
    """Products whose active or exclusion flag differs from the edited one."""
    before = config.select(
        "id", is_active(F.col("status_id")).alias("was_ativo"),
        F.col("excluir_calculos").alias("was_excluido"),
    )
    compared = edits.select("id", "ativo", "excluir_calculos").join(before, "id")
    return compared.select(
        "id",
        "ativo",
        "excluir_calculos",
        (~F.col("ativo").eqNullSafe(F.col("was_ativo"))).alias("ativo_changed"),
        (~F.col("excluir_calculos").eqNullSafe(F.col("was_excluido"))).alias("excluir_changed"),
    ).where("ativo_changed OR excluir_changed")


def product_flags_counts(diff: DataFrame) -> DataFrame:
    """How many products a set of flag edits turns on and off."""
    return diff.agg(
        F.count_if(F.expr("ativo_changed AND ativo")).alias("ativados"),
        F.count_if(F.expr("ativo_changed AND NOT ativo")).alias("desativados"),
        F.count_if(F.expr("excluir_changed AND excluir_calculos")).alias("excluidos"),
        F.count_if(F.expr("excluir_changed AND NOT excluir_calculos")).alias("incluidos"),
    )


def _last_flags(edits: DataFrame, flag: str, arrival: str | None) -> DataFrame:
    """The flag each product was edited to last."""
    order = [arrival] if arrival else []
    return last_per_key(edits.select("id", flag, *order), ["id"], arrival)


def product_status_update(
    product: DataFrame, edits: DataFrame, arrival: str | None = None
) -> DataFrame:
    """The product table with the status of each edited product set, by its last edit."""
    wanted = _last_flags(edits, "ativo", arrival).select(
        "id", F.when(F.col("ativo"), ACTIVE).otherwise(INACTIVE).alias("new_status")
    )
    return product.join(wanted, "id", "left").select(
        *[
            F.coalesce("new_status", "status").alias("status") if name == "status" else F.col(name)
            for name in product.columns
        ]
    )


def product_exclude_apply(
    exclude: DataFrame,
    edits: DataFrame,
    reason: str | None = PLACEHOLDER_REASON,
    arrival: str | None = None,
) -> DataFrame:
    """The exclusion table after edits: true adds or rewords a row, false removes it.

    Of several edits of a product the last by ``arrival`` stands.
    """
    edits = _last_flags(edits, "excluir_calculos", arrival)
    kept = exclude.join(edits.select(F.col("id").alias("product_id")), "product_id", "left_anti")
    added = edits.where("excluir_calculos").select(
        F.col("id").alias("product_id"), F.lit(reason).cast("string").alias("reason")
    )
    return kept.select("product_id", "reason").unionByName(added)


def product_insert(product: DataFrame, new_rows: DataFrame, system_user: int = 1) -> DataFrame:
    """Rows to append to the product table, with their new ids.

    ``new_rows.seq`` numbers the requests. A blank name or description drops the
    request; ``excluir`` stays on the row for ``exclusions_of_new``.
    """
    cleaned = new_rows.select(
        "seq",
        strip(F.col("product_name")).alias("product_name"),
        strip(F.col("description")).alias("description"),
        "product_type",
        F.lit(ACTIVE).alias("status"),
        F.when(F.col("product_size") != "", strip(F.col("product_size"))).alias("product_size"),
        F.when(F.col("sort_order") > 0, F.col("sort_order")).alias("sort_order"),
        F.lit(system_user).alias("system_user"),
        F.coalesce("excluir", F.lit(False)).alias("excluir"),
    ).where("product_name <> '' AND description <> ''")
    numbered = assign_ids(cleaned, highest_id(product), F.col("seq"))
    return numbered.select(
        "id", "product_name", "description", "product_type", "status", "product_size",
        "sort_order", "system_user", "excluir",
    )


def exclusions_of_new(inserted: DataFrame) -> DataFrame:
    """Exclusion rows for new products that were entered as placeholders."""
    return inserted.where("excluir").select(
        F.col("id").alias("product_id"), F.lit(NEW_PLACEHOLDER_REASON).alias("reason")
    )
