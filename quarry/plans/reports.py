"""Queries for reports: the cached ranking, overlays of page states, merged sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import listing_text as T
from quarry.operators import filters, value
from quarry.plans.searches import AVAILABLE
from quarry.sources.listing import LISTING_SQL, fx, listings, side_by_side, table

NOW = "1998-01-01 00:00:00"


def cached_report(spark, sf_dir):
    """The cheapest monthly dong quotes for whole properties in one city."""
    rows = value.convert_to_vnd(listings(spark, sf_dir), fx(spark))
    fits = (F.col("city") == "NATION_3") & (F.col("currency") == "VND") & (F.col("period") == "month") & (F.col("basis") == "property") & (F.col("price_vnd") >= 5000)
    return rows.where(fits & filters.is_available("1997-10-03 00:00:00")).orderBy("price_vnd", "id").limit(20).select("id", "price_vnd")


def detail_overlay(spark, sf_dir):
    """Orders as offers, with what the youngest page seen within six days said of them; of
    equally young ones the first in the table. Pages that say nothing don't count; on one day
    those without a line number are the youngest."""
    offers = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "available").alias("availability"))
    pages = table(spark, sf_dir, "lineitem").where("l_partkey IS NOT NULL").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("seen"), F.element_at(F.array(F.lit("Listing has expired"), F.lit("already rented"), F.lit("Available now"), F.lit("see photos")), (F.col("l_partkey") % 4 + 1).cast("int")).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    young = pages.where(filters.is_fresh(F.col("seen"), NOW, "6 days"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("seen"), F.desc_nulls_first("l_linenumber"), "file", "row"))
    last = young.withColumn("place", place).where("place = 1").select("l_orderkey", "text")
    state = T.detail_status(F.col("text"), F.lit(None).cast("timestamp_ntz"), NOW)
    joined = offers.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("state", F.when(F.col("text").isNotNull(), state))
    stated = F.when(F.col("state").isin("expired", "rented"), "unavailable").when(F.col("state") == "active", "available").when(F.col("state") == "unknown", "unknown").otherwise(F.col("availability"))
    return joined.select("o_orderkey", "state", stated.alias("availability"))


def source_merge(spark, sf_dir):
    """Sources that share a handle: the last known title, all aliases, the greatest
    audience; what was disabled once stays so."""
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("handle"), "c_custkey", "c_name", "c_mktsegment", (F.col("c_custkey") % 37 > 0).alias("enabled"), "c_acctbal")
    out = rows.groupBy("handle").agg(
        F.max_by("c_name", F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey"))).alias("title"),
        F.concat_ws(",", F.array_sort(F.collect_set("c_mktsegment"))).alias("focuses"),
        F.max("c_acctbal").alias("audience"),
        F.every("enabled").alias("enabled"),
        F.count("*").alias("n"),
    )
    return out.withColumn("capability", F.when(F.col("enabled"), "supported").otherwise("disabled"))


def result_scores(spark, sf_dir):
    """A score of each result by its place in the list it came from, the first of a name
    counting; lists are numbered without gaps."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    rows = side_by_side(rows, "l_orderkey")
    lists = Window.partitionBy("l_orderkey")
    placed = rows.withColumn("place", F.row_number().over(lists.orderBy("l_linenumber", "l_suppkey"))).withColumn("n", F.count("*").over(lists))
    return placed.groupBy("l_orderkey", "l_suppkey").agg((F.max("n") - F.min("place") + 1).alias("score"))


SQL = {
    "cached_report": LISTING_SQL + f"SELECT id, price_vnd FROM priced WHERE city = 'NATION_3' AND currency = 'VND' AND period = 'month' AND basis = 'property' AND price_vnd >= 5000 AND {AVAILABLE} ORDER BY price_vnd, id LIMIT 20",
    "detail_overlay": """WITH p AS (SELECT l_orderkey, arg_max(l_partkey % 4, (l_shipdate, l_linenumber)) AS k FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-12-26' AND TIMESTAMP '1998-01-01' GROUP BY 1)
      SELECT o_orderkey, ['expired', 'rented', 'active', 'unknown'][k + 1] AS state, CASE WHEN k IS NULL THEN CASE WHEN o_orderstatus = 'F' THEN 'available' END ELSE ['unavailable', 'unavailable', 'available', 'unknown'][k + 1] END AS availability FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""",
    "source_merge": """SELECT c_custkey % 40 AS handle, arg_max(c_name, c_custkey) FILTER (c_custkey % 3 > 0) AS title, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS focuses, max(c_acctbal) AS audience, bool_and(c_custkey % 37 > 0) AS enabled, count(*) AS n,
      CASE WHEN bool_and(c_custkey % 37 > 0) THEN 'supported' ELSE 'disabled' END AS capability FROM customer GROUP BY 1""",
    "result_scores": """WITH p AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, l_suppkey, max(n) - min(place) + 1 AS score FROM p GROUP BY 1, 2""",
}
QUERIES = {n: globals()[n] for n in SQL}
