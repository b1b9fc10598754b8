"""Partial updates: which change holds a unique value, and what the last change of each field leaves."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.collation import compared
from tarmac.plans.combine import asked_for
from tarmac.plans.lookup import lookup

ORDER = ("change_ts", "change_id")


def key() -> Column:
    return F.struct(*ORDER)


def with_conflict(
    checked: DataFrame, valid: Column, base: DataFrame, entity: str, value: str, collation: str | None = None
) -> DataFrame:
    """Add ``conflict``: the new ``value`` belongs to another entity, in ``base`` or through an earlier valid change.

    A value held in ``base`` stays taken for all others even if its holder gives it up in the same batch. Values are
    compared by ``collation``, byte by byte without one.
    """
    checked = checked.withColumn("_value", compared(F.col(value), collation))
    claims = checked.where(valid & F.col("_value").isNotNull()).groupBy("_value")
    first = claims.agg(F.min(F.struct(*ORDER, entity)).alias("_first"))
    held = (
        asked_for(base.select(entity, compared(F.col(value), collation).alias("_value")), checked, "_value")
        .groupBy("_value")
        .agg(F.min(entity).alias("_low"), F.max(entity).alias("_high"))
    )
    holders = (
        first.unionByName(held, allowMissingColumns=True)
        .groupBy("_value")
        .agg(F.first("_first", True).alias("_first"), F.max("_low").alias("_low"), F.max("_high").alias("_high"))
    )
    others_claim = (F.col("_first")[entity] != F.col(entity)) & (
        F.struct(*[F.col("_first")[c].alias(c) for c in ORDER]) < key()
    )
    in_base = (F.col("_low") != F.col(entity)) | (F.col("_high") != F.col(entity))
    conflict = F.when(F.col("_low").isNotNull(), in_base).otherwise(F.coalesce(others_claim, F.lit(False)))
    return (
        lookup(checked, holders, ["_value"], "change_id")
        .withColumn("conflict", conflict)
        .drop("_value", "_first", "_low", "_high")
    )


def apply_last(base: DataFrame, accepted: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """``base`` with the last accepted value of each field, where ``has_<field>`` says a change gives it."""
    last = accepted.groupBy(entity).agg(
        F.max("change_ts").alias("_updated"),
        *[F.max_by(F.struct(f), F.when(F.col(f"has_{f}"), key())).alias(f"_new_{f}") for f in fields],
    )
    values = {f: F.when(F.col(f"_new_{f}").isNotNull(), F.col(f"_new_{f}")[f]).otherwise(F.col(f)) for f in fields}
    if "updated_at" in base.columns:
        values["updated_at"] = F.coalesce("_updated", "updated_at")
    return base.join(last, entity, "left").withColumns(values).select(base.columns)
