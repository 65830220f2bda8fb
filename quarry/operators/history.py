"""Latest rows, price histories and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective_time(*moments: Column, fallback: Column) -> Column:
    """The latest of the moments that are known, else the fallback."""
    return F.coalesce(F.greatest(*moments) if len(moments) > 1 else moments[0], fallback)


def epoch_time(value: Column) -> Column:
    """A moment from seconds or milliseconds since 1970: below 1e12 counts as seconds."""
    return F.when(F.abs(value) < 1e12, F.timestamp_seconds(value)).otherwise(F.timestamp_millis(value))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order; later columns break ties. One shuffle by key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def newest(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows of each key, the newest by order (a bounded history)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def price_changes(observations: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Consecutive observations of a key whose prices differ: direction, previous,
    current, delta and percent of the previous price."""
    before = F.lag("price").over(Window.partitionBy(*keys).orderBy(*order))
    rows = observations.withColumn("previous", before).where((F.col("previous") != F.col("price")) & F.col("previous").isNotNull())
    delta = F.col("price") - F.col("previous")
    return rows.select(
        *keys,
        *order,
        F.when(delta > 0, "up").otherwise("down").alias("direction"),
        "previous",
        F.col("price").alias("current"),
        delta.alias("delta"),
        F.when(F.col("previous") != 0, delta / F.col("previous") * 100).alias("percent"),
    )


def current_price(observations: DataFrame, entity: list[str], source: str, order: list[str]) -> DataFrame:
    """The lowest of each source's last price: two partial aggregations, no window."""
    last = observations.groupBy(*entity, source).agg(F.max_by("price", F.struct(*order)).alias("price"))
    return last.groupBy(*entity).agg(F.min("price").alias("price"), F.min_by(source, F.struct("price", source)).alias(source))


def merge_attributes(rows: DataFrame, entity: str, order: list[str], latest: list[str], unions: list[str]) -> DataFrame:
    """One row per entity: for columns in latest the last value that is not null, for
    those in unions all distinct values, sorted."""
    at = F.struct(*order)
    return rows.groupBy(entity).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in latest],
        *[F.array_sort(F.collect_set(c)).alias(c) for c in unions],
    )
