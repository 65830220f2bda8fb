"""Bounded tables: upserts, evictions and deletions as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, key: str, replace: bool = True) -> DataFrame:
    """All rows, one per key: incoming ones replace others, or only fill gaps."""
    keep, add = (existing.join(incoming.select(key), key, "left_anti"), incoming) if replace else (existing, incoming.join(existing.select(key), key, "left_anti"))
    return keep.unionByName(add, allowMissingColumns=True)


def keep_newest(rows: DataFrame, scope: list[str], order: list[Column], most: int) -> DataFrame:
    """The first most rows of each scope."""
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def within_bytes(rows: DataFrame, scope: list[str], order: list[Column], size: Column, most: int, protected: Column | None = None) -> DataFrame:
    """Rows that stay when the last ones of a scope go until its bytes fit; protected
    rows stay and count first."""
    first = F.lit(0) if protected is None else F.when(protected, 0).otherwise(1)
    total = F.sum(size).over(Window.partitionBy(*scope).orderBy(first, *order).rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("_bytes", total).withColumn("_free", first)
    return kept.where((F.col("_bytes") <= most) | ((F.col("_free") == 0) & F.lit(protected is not None))).drop("_bytes", "_free")


def delete_messages(variants: DataFrame, deleted: DataFrame) -> DataFrame:
    """Variants (offer_id, source_id, message_ids) without those that hold a deleted
    message (source_id, message_id). An offer without variants is gone with them."""
    hit = variants.select("offer_id", "source_id", F.explode("message_ids").alias("message_id")).join(deleted, ["source_id", "message_id"], "left_semi")
    return variants.join(hit.select("offer_id", "source_id").distinct(), ["offer_id", "source_id"], "left_anti")


def unseen(offers: DataFrame, shown: DataFrame, user: str = "user_id") -> DataFrame:
    """Offers by user with no alias among those that the user was shown."""
    aliases = offers.select(user, "offer_id", F.explode("aliases").alias("alias"))
    hit = aliases.join(shown.select(user, F.explode("aliases").alias("alias")).distinct(), [user, "alias"], "left_semi")
    return offers.join(hit.select(user, "offer_id").distinct(), [user, "offer_id"], "left_anti")


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, counted as bags: side, and the columns."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
