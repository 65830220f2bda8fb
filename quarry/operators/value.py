"""Comparable values of quotes, and rankings with a report of what was left out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nights that a billing period stands for (fixed values).
NIGHTS = {"night": 1, "week": 7, "month": 30, "year": 365}
VALUE_KEYS = {"property": "total_vnd", "bedroom": "price_per_bedroom_vnd", "room": "price_per_room_vnd", "bed": "price_per_bed_vnd"}


@dataclass(frozen=True)
class SearchOptions:
    """What a search may ask for. Ranges map a column to (least, most), either or both None."""

    cheapest: bool = False
    limit: int = 10
    sort_by: str | None = None
    comparison_basis: str | None = None
    comparison_period: str | None = None
    stay_nights: int | None = None
    include_unavailable: bool = False
    types: tuple[str, ...] = ()
    ranges: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.comparison_basis not in (None, *VALUE_KEYS):
            raise ValueError("unknown comparison basis")
        if self.sort_by not in (None, *VALUE_KEYS.values()):
            raise ValueError("unknown value sort")
        if self.comparison_period not in (None, "quoted", *NIGHTS):
            raise ValueError("unknown comparison period")
        if self.stay_nights is not None and not 1 <= self.stay_nights <= 3650:
            raise ValueError("stay_nights is 1 to 3650")

    @property
    def key(self) -> str:
        return self.sort_by or VALUE_KEYS.get(self.comparison_basis or "property")

    @property
    def converted(self) -> bool:
        return self.stay_nights is not None or self.comparison_period not in (None, "quoted")

    @property
    def comparable(self) -> bool:
        return bool(self.sort_by or self.cheapest or self.stay_nights or self.comparison_period or self.comparison_basis or any(k.endswith("_vnd") for k in self.ranges))


def convert_to_vnd(offers: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds price_vnd: whole dong, halves up; null where the currency has no rate.

    The rate table has one row per currency, so it is broadcast.
    """
    joined = offers.join(F.broadcast(rates), "currency", "left")
    vnd = F.when(F.col("currency") == "VND", F.floor(F.col("amount") + 0.5)).otherwise(F.floor(F.col("amount") * F.col("rate") + 0.5))
    return joined.withColumn("price_vnd", vnd.cast("long")).drop("rate")


def denominator(name: str) -> Column:
    """The attribute if there is one, else the first labelled field if it is all digits."""
    label = F.try_element_at(F.try_element_at("labeled_fields", F.lit(name)), F.lit(1))
    return F.coalesce(F.col(name), F.when(label.rlike(r"^\d+$"), label.try_cast("double")))


def compare_value(offers: DataFrame, options: SearchOptions | None = None) -> DataFrame:
    """Adds total_vnd, price_per_{bedroom,room,bed}_vnd, {bedrooms,rooms,beds}_known and
    exclusions. A quote for one unit gives that unit's value alone; a property's quote is
    divided by counts that are whole and positive; units are never mixed."""
    options = options or SearchOptions()
    quoted = F.create_map(*[F.lit(x) for kv in NIGHTS.items() for x in kv])
    known = F.col("period").isin(*NIGHTS)
    good = F.coalesce(F.col("price_vnd") > 0, F.lit(False))
    quote = F.col("price_vnd").cast("double")
    if options.converted:
        nights = options.stay_nights or NIGHTS[options.comparison_period]
        quote = F.when(known, F.col("price_vnd") * F.lit(nights) / F.try_element_at(quoted, F.col("period")))
    unit_quote = F.when(good, quote)
    total = F.when(F.col("basis") == "property", unit_quote)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("basis") != "property", F.concat(F.lit("quote-per-"), "basis")),
            F.when(~good, "missing-positive-rent"),
            F.when(~known, "unknown-billing-period") if options.converted else F.lit(None).cast("string"),
        )
    )
    out = offers.withColumn("total_vnd", total).withColumn("exclusions", reasons)
    for name, unit in (("bedrooms", "bedroom"), ("rooms", "room"), ("beds", "bed")):
        count = denominator(name)
        valid = F.coalesce((count > 0) & (count == F.floor(count)), F.lit(False))
        out = out.withColumn(f"{name}_known", valid).withColumn(f"price_per_{unit}_vnd", F.when(F.col("basis") == unit, unit_quote).when(valid, F.col("total_vnd") / count))
    return out


def in_range(value: Column, least, most) -> Column:
    """Missing values are outside any range; no bounds hold for all."""
    tests = [value >= least] * (least is not None) + [value <= most] * (most is not None)
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def named_filters(options: SearchOptions) -> Column:
    out = F.lower("kind").isin(*[t.lower() for t in options.types]) if options.types else F.lit(True)
    for name, (least, most) in options.ranges.items():
        out = out & in_range(denominator(name) if name in ("rooms", "bedrooms", "beds") else F.col(name), least, most)
    return out


def judged(offers: DataFrame, options: SearchOptions) -> DataFrame:
    """offers with their values, accepted (boolean) and reasons (array) under options.

    Bases and periods are counted over all candidates: more than one vetoes every row,
    unless the options say how to compare. The counts are one row, broadcast.
    """
    valued = compare_value(offers, options)
    if not options.comparable:
        return valued.withColumn("accepted", named_filters(options)).withColumn("reasons", F.array().cast("array<string>"))
    key = F.col(options.key)
    right_basis = F.col("basis") == options.comparison_basis if options.comparison_basis else F.lit(True)
    mixed = valued.where(key.isNotNull() & right_basis).agg(F.count_distinct("basis").alias("n_bases"), F.count_distinct("period").alias("n_periods"))
    rows = valued.crossJoin(F.broadcast(mixed))
    mixed_basis = F.lit(False) if options.comparison_basis else F.col("n_bases") > 1
    mixed_period = F.col("n_periods") > 1 if not options.stay_nights and options.comparison_period in (None, "quoted") else F.lit(False)
    fits = key.isNotNull() & right_basis & ~mixed_basis & ~mixed_period
    named = named_filters(options)
    unusable = F.array_compact(F.array(*[F.when(~F.col(f"{n}_known"), f"unusable-{n}-denominator") for n in ("bedrooms", "rooms", "beds")]))
    reasons = (
        F.when(fits & named, F.array().cast("array<string>"))
        .when(fits, unusable)
        .when(~right_basis, F.array(F.lit("outside-comparison-basis")))
        .when(mixed_basis, F.array(F.lit("mixed-quote-bases-require-comparison-basis")))
        .when(mixed_period, F.array(F.lit("mixed-billing-periods-require-comparison-policy")))
        .otherwise(F.concat("exclusions", F.array(F.lit(f"missing-{options.key}"))))
    )
    return rows.withColumn("accepted", fits & named).withColumn("reasons", reasons).drop("n_bases", "n_periods")


def ranked(offers: DataFrame, options: SearchOptions) -> DataFrame:
    """The first options.limit accepted rows: by value, or newest first; ties by id.

    Spark keeps a heap of limit rows in each task (TakeOrderedAndProject)."""
    order = [F.col(options.key).asc(), F.col("id")] if options.comparable else [F.col("collected_at").desc_nulls_last(), F.col("id")]
    return judged(offers, options).where("accepted").orderBy(*order).limit(options.limit)


def excluded(offers: DataFrame, options: SearchOptions) -> DataFrame:
    """id and reasons of rows that are left out for a reason."""
    return judged(offers, options).where(~F.col("accepted") & (F.size("reasons") > 0)).select("id", "reasons")
