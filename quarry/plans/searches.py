"""Queries over listings: values, rankings, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import filters, value
from quarry.operators.value import SearchOptions
from quarry.sources.listing import LISTING_SQL, fx, listings

NOW = "1998-01-01 00:00:00"


def priced(spark, sf_dir):
    return value.convert_to_vnd(listings(spark, sf_dir), fx(spark))


def fx_convert(spark, sf_dir):
    return priced(spark, sf_dir).groupBy("currency", "period").agg(F.count("*").alias("n"), F.count("price_vnd").alias("n_priced"), F.sum("price_vnd").alias("total"))


def value_metrics(spark, sf_dir):
    cols = ["id", "total_vnd", "price_per_bedroom_vnd", "price_per_room_vnd", "price_per_bed_vnd"]
    out = value.compare_value(priced(spark, sf_dir))
    return out.select("id", *[F.round(c, 4).alias(c) for c in cols[1:]], "bedrooms_known", F.concat_ws(",", "exclusions").alias("exclusions"))


def stay_totals(spark, sf_dir):
    out = value.compare_value(priced(spark, sf_dir), SearchOptions(stay_nights=15))
    return out.select("id", F.round("total_vnd", 4).alias("total_vnd"), F.concat_ws(",", "exclusions").alias("exclusions"))


def available(spark, sf_dir):
    return priced(spark, sf_dir).where(F.col("price_vnd").isNotNull() & filters.is_available("1997-10-03 00:00:00"))


def cheapest_topk(spark, sf_dir):
    options = SearchOptions(cheapest=True, limit=20, stay_nights=30, comparison_basis="property", types=("apartment", "villa"), ranges={"rooms": (1, 3)})
    return value.ranked(available(spark, sf_dir), options).select("id", "kind", "city", "price_vnd", F.round("total_vnd", 4).alias("total_vnd"))


def cheapest_per_bed(spark, sf_dir):
    options = SearchOptions(limit=15, stay_nights=7, comparison_basis="property", sort_by="price_per_bed_vnd")
    return value.ranked(available(spark, sf_dir), options).select("id", F.round("price_per_bed_vnd", 4).alias("price_per_bed_vnd"))


def newest_topk(spark, sf_dir):
    return value.ranked(available(spark, sf_dir), SearchOptions(limit=25)).select("id", "collected_at")


def value_exclusions(spark, sf_dir):
    options = SearchOptions(stay_nights=30, comparison_basis="property", ranges={"rooms": (2, None)})
    out = value.excluded(priced(spark, sf_dir), options)
    return out.groupBy(F.concat_ws(",", "reasons").alias("reasons")).agg(F.count("*").alias("n"))


def mixed_vetoes(spark, sf_dir):
    out = value.excluded(priced(spark, sf_dir), SearchOptions(cheapest=True))
    return out.groupBy(F.concat_ws(",", "reasons").alias("reasons")).agg(F.count("*").alias("n"))


def availability_filter(spark, sf_dir):
    return available(spark, sf_dir).groupBy("source_type", "city").agg(F.count("*").alias("n"))


def query_filter(spark, sf_dir):
    return listings(spark, sf_dir, parts=False, places=False).where(filters.for_query(F.array("search_query"), "DA NANG ")).select("id", "search_query")


def key_value_filters(spark, sf_dir):
    rows = listings(spark, sf_dir)
    wanted = {"kind": "VIL", "rooms": 2, "available_now": True, "city": "TI"}
    return rows.where(filters.matches_filters(dict(rows.dtypes), wanted)).select("id", "city")


def label_filter(spark, sf_dir):
    rows = listings(spark, sf_dir, places=False).drop("rooms")
    return rows.where(filters.matches_filters(dict(rows.dtypes), {"rooms": "7", "beds": 3})).select("id")


def message_filter(spark, sf_dir):
    return listings(spark, sf_dir).where((F.col("source_type") != "telegram") | filters.message_matches(F.concat_ws(" ", "title", "city"), "Án  1")).groupBy("source_type").agg(F.count("*").alias("n"))


def freshness(spark, sf_dir):
    rows = listings(spark, sf_dir, parts=False, places=False)
    return rows.groupBy(filters.is_fresh(F.col("collected_at"), NOW, "30 days").alias("fresh"), filters.in_window(F.col("posted_at"), NOW).alias("in_window")).agg(F.count("*").alias("n"))


VALUED = """,
valued AS (
  SELECT *, CASE WHEN price_vnd > 0 THEN {quote} END AS unit_quote,
         coalesce(bedrooms > 0 AND bedrooms = floor(bedrooms), false) AS bedrooms_known,
         coalesce(rooms, rooms_label::DOUBLE) AS room_count
  FROM priced
),
v AS (
  SELECT *, CASE WHEN basis = 'property' THEN unit_quote END AS total_vnd,
         concat_ws(',', CASE WHEN basis <> 'property' THEN 'quote-per-' || basis END,
                   CASE WHEN NOT coalesce(price_vnd > 0, false) THEN 'missing-positive-rent' END) AS exclusions
  FROM valued
),
u AS (
  SELECT *, CASE WHEN basis = 'bedroom' THEN unit_quote WHEN bedrooms_known THEN total_vnd / bedrooms END AS price_per_bedroom_vnd,
         CASE WHEN basis = 'room' THEN unit_quote ELSE total_vnd / room_count END AS price_per_room_vnd,
         CASE WHEN basis = 'bed' THEN unit_quote WHEN beds > 0 THEN total_vnd / beds END AS price_per_bed_vnd
  FROM v
)
"""
PLAIN = LISTING_SQL + VALUED.format(quote="price_vnd::DOUBLE")
STAY = lambda n: LISTING_SQL + VALUED.format(quote=f"price_vnd * {n} / CASE period WHEN 'night' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 ELSE 365 END")
AVAILABLE = "price_vnd IS NOT NULL AND (source_type <> 'telegram' OR posted_at >= TIMESTAMP '1997-10-03') AND NOT review_required AND coalesce(availability <> 'unavailable', true) AND coalesce(available_now, true)"

SQL = {
    "fx_convert": LISTING_SQL + "SELECT currency, period, count(*) AS n, count(price_vnd) AS n_priced, sum(price_vnd)::BIGINT AS total FROM priced GROUP BY ALL",
    "value_metrics": PLAIN + "SELECT id, round(total_vnd, 4) AS total_vnd, round(price_per_bedroom_vnd, 4) AS price_per_bedroom_vnd, round(price_per_room_vnd, 4) AS price_per_room_vnd, round(price_per_bed_vnd, 4) AS price_per_bed_vnd, bedrooms_known, exclusions FROM u",
    "stay_totals": STAY(15) + "SELECT id, round(total_vnd, 4) AS total_vnd, exclusions FROM u",
    "cheapest_topk": STAY(30) + f"SELECT id, kind, city, price_vnd, round(total_vnd, 4) AS total_vnd FROM u WHERE {AVAILABLE} AND basis = 'property' AND total_vnd IS NOT NULL AND kind IN ('apartment', 'villa') AND room_count BETWEEN 1 AND 3 ORDER BY u.total_vnd, id LIMIT 20",
    "cheapest_per_bed": STAY(7) + f"SELECT id, round(price_per_bed_vnd, 4) AS price_per_bed_vnd FROM u WHERE {AVAILABLE} AND basis = 'property' AND price_per_bed_vnd IS NOT NULL ORDER BY u.price_per_bed_vnd, id LIMIT 15",
    "newest_topk": LISTING_SQL + f"SELECT id, collected_at FROM priced WHERE {AVAILABLE} ORDER BY collected_at DESC, id LIMIT 25",
    "value_exclusions": STAY(30) + """SELECT reasons, count(*) AS n FROM (SELECT CASE
      WHEN basis <> 'property' THEN 'outside-comparison-basis'
      WHEN total_vnd IS NULL THEN concat_ws(',', nullif(exclusions, ''), 'missing-total_vnd')
      WHEN room_count >= 2 THEN ''
      ELSE concat_ws(',', CASE WHEN NOT bedrooms_known THEN 'unusable-bedrooms-denominator' END, CASE WHEN NOT beds > 0 THEN 'unusable-beds-denominator' END) END AS reasons FROM u) WHERE reasons <> '' GROUP BY reasons""",
    "mixed_vetoes": PLAIN + """SELECT reasons, count(*) AS n FROM (SELECT CASE
      WHEN (SELECT count(DISTINCT basis) FROM u WHERE total_vnd IS NOT NULL) > 1 THEN 'mixed-quote-bases-require-comparison-basis'
      WHEN (SELECT count(DISTINCT period) FROM u WHERE total_vnd IS NOT NULL) > 1 THEN 'mixed-billing-periods-require-comparison-policy'
      WHEN total_vnd IS NULL THEN concat_ws(',', nullif(exclusions, ''), 'missing-total_vnd') ELSE '' END AS reasons FROM u) WHERE reasons <> '' GROUP BY reasons""",
    "availability_filter": LISTING_SQL + f"SELECT source_type, city, count(*) AS n FROM priced WHERE {AVAILABLE} GROUP BY ALL",
    "query_filter": LISTING_SQL + "SELECT id, search_query FROM listing WHERE search_query = '' OR lower(trim(search_query)) = 'da nang'",
    "key_value_filters": LISTING_SQL + "SELECT id, city FROM listing WHERE contains(lower(kind), 'vil') AND rooms = 2 AND available_now AND contains(lower(city), 'ti')",
    "label_filter": LISTING_SQL + "SELECT id FROM listing WHERE contains(rooms_label, '7') AND beds = 3",
    "message_filter": LISTING_SQL + "SELECT source_type, count(*) AS n FROM listing WHERE source_type <> 'telegram' OR (contains(lower(title || ' ' || city), 'an') AND contains(title || ' ' || city, '1')) GROUP BY ALL",
    "freshness": LISTING_SQL + "SELECT collected_at <= TIMESTAMP '1998-01-01' AND collected_at >= TIMESTAMP '1997-12-02' AS fresh, posted_at >= TIMESTAMP '1997-10-03' AS in_window, count(*) AS n FROM listing GROUP BY ALL",
}

QUERIES = {f.__name__: f for f in (fx_convert, value_metrics, stay_totals, cheapest_topk, cheapest_per_bed, newest_topk, value_exclusions, mixed_vetoes, availability_filter, query_filter, key_value_filters, label_filter, message_filter, freshness)}
