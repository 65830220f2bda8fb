"""Entities under a stream of new, edited and deleted offers.

The state is two Parquet tables whose partitions are batches: `offers` (the last state of
each offer with its keys and entity, deletions too) and `merged` (entities as last merged,
and entities that are gone). A batch adds what it changes and leaves the rest alone; one
that is repeated writes its partition again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.entities import merge_entities, with_identity
from quarry.operators.graph import stored
from quarry.operators.resolve import resolve

#: What names an offer.
NAME = ["source_id", "id"]


def _last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def _last_changes(changes: DataFrame, order: list[str]) -> DataFrame:
    """The last change of each offer. Only names and order are sorted; whole rows are read
    again for those that stay, however many changes an offer has."""
    last = changes.groupBy(*NAME).agg(F.max(F.struct(*order)).alias("_order"))
    last = stored(last.select(*[F.col(c).alias(f"_{c}") for c in NAME], "_order"), "last")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in NAME] + [F.col(c).eqNullSafe(F.col(f"_order.{c}")) for c in order]
    # changes of one name may agree in their order
    return _last(changes.join(last, reduce(lambda a, b: a & b, same), "left_semi"), NAME, order)


def _written(spark: SparkSession, target: str, part: str, before: int) -> DataFrame | None:
    """The partitions of earlier batches, if there are any."""
    if before <= 0:
        return None
    return spark.read.option("mergeSchema", "false").parquet(f"{target}/{part}").where(F.col("batch") < before)


def current_offers(spark: SparkSession, target: str, before: int = 1 << 30) -> DataFrame:
    """The offers that stand, each with keys and entity."""
    return _last(_written(spark, target, "offers", before), NAME, ["batch"]).where("NOT deleted").drop("batch")


def current_entities(spark: SparkSession, target: str, before: int = 1 << 30) -> DataFrame:
    """The entities that stand, as merge_entities gives them."""
    return _last(_written(spark, target, "merged", before), ["entity"], ["batch"]).where("NOT gone").drop("batch", "gone")


def _bound(rows: DataFrame) -> DataFrame:
    """(name, key): everything by which an offer may be bound to another, refused or not."""
    keys = F.concat("strong", "weak", "weak_later")
    return rows.select(F.struct(*NAME).alias("name"), F.explode(keys).alias("key"))


def _reached(first: DataFrame, bound: DataFrame) -> DataFrame:
    """Names of all offers that keys lead to from the names in first, step by step; each
    step follows what is new only."""
    found = frontier = stored(first.distinct(), "touched")
    while True:
        keys = bound.join(frontier, "name", "left_semi").select("key").distinct()
        step = bound.join(keys, "key", "left_semi").select("name").distinct().join(found, "name", "left_anti")
        frontier = stored(step, "touched")
        if not frontier.limit(1).count():
            return found
        found = found.union(frontier)


def apply_offer_changes(changes: DataFrame, number: int, target: str, order: list[str]) -> None:
    """Takes a batch of changes into the state under target.

    changes: an offer's columns (see operators.entities), deleted (true takes the offer
    away) and the columns of order. Of an offer's changes the last by order counts, whatever
    batch brings it: deletions are kept, so an older edit that comes late changes nothing.

    Offers that no chain of keys connects can't influence each other. So only offers that
    such a chain connects with a changed one, in its old or its new state, are resolved and
    merged again: a deletion may take entities apart, or lift the contradiction that kept
    others asunder. The result is that of all offers at once, however they were batched.
    """
    spark = changes.sparkSession
    # keys are worked out for the changes that count only
    fresh = stored(with_identity(_last_changes(changes.drop("batch"), order)), "changes")
    written = _written(spark, target, "offers", number)
    if written is None:
        changed, before = fresh, fresh.limit(0).withColumn("entity", F.lit(None).cast("long"))
    else:
        before = _last(written, NAME, ["batch"]).drop("batch")
        newer = before.select(*NAME, F.struct(*order).alias("_known"))
        changed = stored(fresh.join(newer, NAME, "left").where(F.col("_known").isNull() | (F.struct(*order) > F.col("_known"))).drop("_known"), "changed")
    names = changed.select(F.struct(*NAME).alias("name"))
    old = stored(before.where("NOT deleted"), "before")
    bound = _bound(old).union(_bound(changed.where("NOT deleted")))
    reached = _reached(names, stored(bound.distinct(), "bound"))
    unchanged = old.withColumn("name", F.struct(*NAME)).join(reached, "name", "left_semi").join(names, "name", "left_anti").drop("name")
    columns = [c for c in fresh.columns]
    rows = stored(unchanged.select(*columns).unionByName(changed.where("NOT deleted").select(*columns)), "again")

    entities = stored(resolve(rows), "entities")
    gone = changed.where("deleted").select(*columns).withColumn("entity", F.lit(None).cast("long"))
    rows.join(entities, "ordinal").select(*columns, "entity").unionByName(gone).write.mode("overwrite").parquet(f"{target}/offers/batch={number}")
    merged = merge_entities(rows.drop("deleted", *[c for c in order if c not in OWN]), entities).withColumn("gone", F.lit(False))
    left = old.withColumn("name", F.struct(*NAME)).join(reached, "name", "left_semi").select("entity").distinct().join(entities, "entity", "left_anti")
    merged.unionByName(left.withColumn("gone", F.lit(True)), allowMissingColumns=True).write.mode("overwrite").parquet(f"{target}/merged/batch={number}")


#: Columns of an offer that may also order its changes.
OWN = ("ordinal", "id", "source_id", "posted_at", "updated_at", "collected_at")


def keep_entities(target: str, order: list[str]):
    """For writeStream.foreachBatch: see apply_offer_changes."""

    def run(batch: DataFrame, number: int) -> None:
        apply_offer_changes(batch, number, target, order)

    return run
