"""Source inventories: caps, schedules, outcomes, coverage and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_by_cohort(sources: DataFrame, cohort: str, popularity: str, key: str, cap: int) -> DataFrame:
    """The most popular sources of each cohort; ties by key."""
    place = F.row_number().over(Window.partitionBy(cohort).orderBy(F.col(popularity).desc_nulls_last(), key))
    return sources.withColumn("place", place).where(F.col("place") <= cap)


def refresh_order(sources: DataFrame, states: DataFrame, offers: DataFrame, key: str, now: str, max_age: str) -> DataFrame:
    """Sources with fresh (their state's collection, else any of their offers, is young)
    and their place in the order: stale first, then the oldest attempt, then by key."""
    end = F.lit(now).cast("timestamp_ntz")
    young = lambda c: F.coalesce((F.col(c) <= end) & (F.col(c) >= end - F.expr(f"interval {max_age}")), F.lit(False))
    live = offers.where(young("collected_at")).select(key).distinct().withColumn("has_offers", F.lit(True))
    rows = sources.join(states, key, "left").join(live, key, "left")
    fresh = F.when(F.col("state_at").isNotNull(), young("state_at")).otherwise(F.coalesce("has_offers", F.lit(False)))
    return rows.withColumn("fresh", fresh).orderBy("fresh", F.col("attempted_at").asc_nulls_first(), key)


def outcome_summary(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counts of statuses and the flags that follow from them."""
    ok = F.col("status").isin("offers", "empty")
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.every(~ok).alias("all_failed"),
        F.some(F.col("status") == "incomplete").alias("incomplete"),
    )


def field_coverage(offers: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """For each source and field: rows, rows that know it, rows with a positive value."""
    stats = [F.struct(F.lit(f).alias("field"), F.count(f).alias("known"), F.count_if(F.col(f) > 0).alias("positive")) for f in fields]
    wide = offers.groupBy(by).agg(F.count("*").alias("total"), F.array(*stats).alias("stats"))
    return wide.select(by, "total", F.inline("stats"))


def by_first_alias(left: DataFrame, key: str, aliases: Column, right: DataFrame, alias: str) -> DataFrame:
    """left with the row of right that its first known alias names; null where none does."""
    pairs = left.select(key, F.posexplode(aliases).alias("_at", alias)).join(right, alias)
    others = [c for c in right.columns if c != alias]
    first = pairs.groupBy(key).agg(F.min_by(F.struct(alias, *others), "_at").alias("_hit"))
    return left.join(first, key, "left").select(*left.columns, F.col(f"_hit.{alias}").alias(alias), *[F.col(f"_hit.{c}").alias(c) for c in others])


def completeness(inventory: DataFrame, by: str) -> DataFrame:
    """What is outstanding by group: complete if there are sources and all are done."""
    done = F.col("state") == "complete"
    return inventory.groupBy(by).agg(
        F.count("*").alias("sources"),
        F.array_sort(F.collect_list(F.when(~done & F.col("enabled"), F.col("source_id")))).alias("outstanding"),
        F.count_if(~F.col("enabled")).alias("left_out"),
        (F.count_if(F.col("enabled")) > 0).alias("_any"),
        (F.count_if(F.col("enabled") & ~done) == 0).alias("_all"),
    ).withColumn("complete", F.col("_any") & F.col("_all")).drop("_any", "_all")


def precision_recall(pairs: DataFrame, *by: str) -> DataFrame:
    """From expected and actual (booleans): counts, precision and recall, null for 0 / 0."""
    tp, fp, fn = (F.count_if(e & a) for e, a in ((F.col("expected"), F.col("actual")), (~F.col("expected"), F.col("actual")), (F.col("expected"), ~F.col("actual"))))
    out = pairs.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def audit(baseline: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Gates (key, passed) of two runs side by side: change tells what became of each."""
    both = baseline.select(key, F.col("passed").alias("before")).join(candidate.select(key, F.col("passed").alias("after")), key, "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "missing").when(F.col("before") & ~F.col("after"), "regression").when(~F.col("before") & F.col("after"), "improvement").otherwise("same")
    return both.withColumn("change", change)
