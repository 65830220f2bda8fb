"""Sources: what they hold, what they have done, how they depend on each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import stored


def source_holdings(sources: DataFrame, offers: DataFrame, counted: dict[str, Column]) -> DataFrame:
    """source_id, offers and one column for each of counted (how many of its offers fit).

    sources: source_id, aliases; offers: offer_id, source_ids and what counted names. An
    offer belongs to each source one of whose ids it names, once, however many ids they
    share. Sources without offers have zeros. Both sides are joined by id, and what an
    offer and a source share is made distinct before it is counted."""
    ids = lambda first, more: F.array_distinct(F.array_compact(F.concat(first, F.coalesce(more, F.array().cast("array<string>")))))
    left = sources.select("source_id", F.explode(ids(F.array("source_id"), F.col("aliases"))).alias("key"))
    facts = [F.coalesce(test, F.lit(False)).cast("int").alias(name) for name, test in counted.items()]
    right = offers.select("offer_id", *facts, F.explode(F.array_distinct(F.array_compact("source_ids"))).alias("key"))
    pairs = left.join(right, "key").groupBy("source_id", "offer_id").agg(*[F.max(name).alias(name) for name in counted])
    sums = pairs.groupBy("source_id").agg(F.count("*").alias("offers"), *[F.sum(name).alias(name) for name in counted])
    return sources.select("source_id").distinct().join(sums, "source_id", "left").na.fill(0, ["offers", *counted])


#: Outcomes of an attempt that bring nothing to remember, and those that show
#: a source as it is.
FLEETING, SEEN = ("pending", "cancelled"), ("offers", "empty")


def collection_states(attempts: DataFrame, keys: list[str], details: list[str], degraded_after: int = 2) -> DataFrame:
    """keys, status, attempted_at, collected_at, details, failures, state.

    attempts: keys, attempted_at, seq (tells attempts of one moment apart), status,
    history_complete and details. The last attempt gives the status; a detail that it
    doesn't state keeps its last known value. collected_at is when a source was last seen
    whole. failures counts the attempts since then; from degraded_after on a source is
    degraded, without any complete attempt it is new, else current. Fleeting outcomes count
    nothing. Attempts may come in any order: all is an aggregation, summed where rows are.
    """
    rows = attempts.where(~F.col("status").isin(*FLEETING)).withColumn("at", F.struct("attempted_at", "seq"))
    whole = F.col("status").isin(*SEEN) & F.coalesce("history_complete", F.lit(True))
    out = rows.groupBy(*keys).agg(
        F.max_by("status", "at").alias("status"),
        F.max("attempted_at").alias("attempted_at"),
        F.max(F.when(whole, F.col("at"))).alias("seen"),
        *[F.max_by(d, F.when(F.col(d).isNotNull(), F.col("at"))).alias(d) for d in details],
    )
    since = rows.join(out.select(*keys, "seen"), keys).where(F.col("seen").isNull() | (F.col("at") > F.col("seen"))).groupBy(*keys).agg(F.count("*").alias("failures"))
    out = out.join(since, keys, "left").na.fill(0, ["failures"])
    state = F.when(F.col("failures") >= degraded_after, "degraded").when(F.col("seen").isNull(), "new").otherwise("current")
    return out.select(*keys, "status", "attempted_at", F.col("seen.attempted_at").alias("collected_at"), *details, "failures", state.alias("state"))


def degraded_through(states: DataFrame, depends: DataFrame) -> DataFrame:
    """source_id, state, through: a source that is not degraded itself, but depends on one
    that is, whatever the steps between, is `affected` through the smallest such source.

    states: source_id, state; depends: source_id, on. A join per step; each follows only
    those whose cause has just changed, so cycles end."""
    cause = stored(states.where("state = 'degraded'").select("source_id", F.col("source_id").alias("through")), "causes")
    frontier = cause
    while True:
        step = frontier.withColumnRenamed("source_id", "on").join(depends, "on").groupBy("source_id").agg(F.min("through").alias("step"))
        new = stored(step.join(cause, "source_id", "left").where(F.col("through").isNull() | (F.col("step") < F.col("through"))).select("source_id", F.col("step").alias("through")), "causes")
        if not new.limit(1).count():
            break
        cause = stored(cause.join(new, "source_id", "left_anti").unionByName(new), "causes")
        frontier = new
    out = states.join(cause, "source_id", "left")
    return out.select("source_id", F.when(F.col("state") == "degraded", "degraded").when(F.col("through").isNotNull(), "affected").otherwise(F.col("state")).alias("state"), F.when(F.col("state") != "degraded", F.col("through")).alias("through"))


def match_known(candidates: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """candidate_id, source_id, matched_by: the known source that each candidate is.

    candidates: candidate_id and a column for each of keys, strongest first; known:
    source_id, priority and the same columns as lists. The strongest key that leads
    anywhere decides; among its sources the one with the smallest priority, then id.
    Candidates without a match have nulls. One pair of joins for all keys together."""
    sides = []
    for place, key in enumerate(keys):
        sides.append((candidates.select("candidate_id", F.lit(place).alias("place"), F.lower(F.col(key).cast("string")).alias("key")), known.select("source_id", "priority", F.lit(place).alias("place"), F.explode(F.transform(key, lambda k: F.lower(k.cast("string")))).alias("key"))))
    left, right = sides[0]
    for a, b in sides[1:]:
        left, right = left.unionAll(a), right.unionAll(b)
    right = right.where("key <> ''").groupBy("place", "key").agg(F.min(F.struct("priority", "source_id")).alias("best"))
    best = left.where("key <> ''").join(right, ["place", "key"]).groupBy("candidate_id").agg(F.min(F.struct("place", "best")).alias("m"))
    named = F.element_at(F.lit(list(keys)), F.col("m.place") + 1)
    return candidates.select("candidate_id").join(best, "candidate_id", "left").select("candidate_id", F.col("m.best.source_id").alias("source_id"), F.when(F.col("m").isNotNull(), named).alias("matched_by"))


def merge_discoveries(known: DataFrame, matched: DataFrame, order: list[str], latest: list[str], lists: list[str]) -> DataFrame:
    """One row a source: what is known, then what discoveries say of it, folded in order.

    known and matched (candidates with source_id) have the columns of latest and lists and
    of order; known rows sort before all discoveries. For latest the last value that is
    not null counts, lists are unions, sorted. Candidates without a source found one of
    their own: their source_id is `new:` and the candidate's. The result depends neither
    on how rows lie nor on how many runs brought them: what a run has merged is known to
    the next, and merging the same again changes nothing."""
    cols = ["source_id", *order, *latest, *lists]
    rows = known.select(*cols, F.lit(0).alias("_late")).unionByName(matched.withColumn("source_id", F.coalesce("source_id", F.concat(F.lit("new:"), F.col("candidate_id").cast("string")))).select(*cols, F.lit(1).alias("_late")))
    at = F.struct("_late", *order)
    return rows.groupBy("source_id").agg(
        *[F.max(c).alias(c) for c in order],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in latest],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast(known.schema[c].dataType)))))).alias(c) for c in lists],
        F.count("*").alias("rows"),
    )


def option_groups(subscriptions: DataFrame, options: Column) -> DataFrame:
    """group, options, users, subscriptions: who asks the same is served by one search.
    options: canonical JSON (functions.records); rows without options belong to no group.
    Users are counted once, and counted before they meet."""
    rows = subscriptions.withColumn("options", options).where("options IS NOT NULL").groupBy("options", "user_id").agg(F.count("*").alias("n"))
    out = rows.groupBy("options").agg(F.count("user_id").alias("users"), F.sum("n").alias("subscriptions"))
    return out.select(F.sha2("options", 256).alias("group"), "options", "users", "subscriptions")
