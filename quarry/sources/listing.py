"""Listings, exchange rates and price observations derived from the supplied tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.graph import stored

#: Dong for one unit of a currency; the rouble has no rate on purpose.
RATES = {"VND": 1.0, "USD": 25000.0, "EUR": 27000.0, "GBP": 31000.0}

#: Rows of a partition that is sorted, about.
PART_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """For costly work on each row: rows of fewer files than cores are dealt to all cores
    (a file of one row group is one task); larger tables stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def side_by_side(rows: DataFrame, *keys: str) -> DataFrame:
    """For windows and sorts by keys: rows of equal keys in one partition, of about
    PART_ROWS rows however large the table is, so that no task sorts more."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, -(-rows.count() // PART_ROWS)), *keys)


def each_once(rows: DataFrame, keys: list[str], name: str, value: Column) -> DataFrame:
    """rows with value, a costly expression of keys alone, as column name. Where rows repeat
    their keys four times or more (posts that appear again and again) it is worked out once
    for each distinct key and joined; else row by row."""
    n, different = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*keys))).first()
    if different * 4 > n:
        return rows.withColumn(name, value)
    known = stored(rows.select(*keys).distinct().withColumn(name, value), "values")
    known = known.select(name, *[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(known, same, "left").drop(*[f"_{k}" for k in keys])


def fx(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(RATES.items()), "currency string, rate double")


def listings(spark: SparkSession, sf_dir: str, parts: bool = True, places: bool = True) -> DataFrame:
    """One listing per line item; categories follow from its keys. Without parts there are
    no title, rooms and labelled fields, without places no city, and no join for them."""
    df = table(spark, sf_dir, "lineitem")
    if parts:
        df = df.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    if places:
        # 25 nations
        nation = F.broadcast(table(spark, sf_dir, "nation"))
        df = df.join(table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    pick = lambda key, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))
    number = F.col("l_partkey") % 7
    return df.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_suppkey").alias("source_id"),
        pick("l_suppkey", "telegram", "web", "official-web").alias("source_type"),
        *([F.col("n_name").alias("city")] if places else []),
        pick("l_partkey", "apartment", "house", "villa", "room").alias("kind"),
        *([F.col("p_name").alias("title")] if parts else []),
        F.col("l_extendedprice").alias("amount"),
        pick("l_orderkey", "VND", "USD", "EUR", "GBP", "RUB").alias("currency"),
        pick("l_linenumber", "month", "month", "night", "week", "year").alias("period"),
        pick("l_quantity", "property", "property", "property", "bedroom", "room", "bed", "person").alias("basis"),
        F.when(number == 0, None).when(number == 1, -1.0).when(number == 2, 1.5).otherwise(number - 3).cast("double").alias("bedrooms"),
        *([F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 5).cast("double").alias("rooms"), F.create_map(F.lit("rooms"), F.array(F.col("p_size").cast("string"))).alias("labeled_fields")] if parts else []),
        (F.col("l_linenumber") % 4).cast("double").alias("beds"),
        F.when(F.col("l_returnflag") == "R", "unavailable").when(F.col("l_returnflag") == "A", "available").alias("availability"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity") > 5).alias("available_now"),
        (F.col("l_linenumber") == 7).alias("review_required"),
        F.col("l_shipdate").alias("posted_at"),
        F.expr("l_shipdate + make_interval(0, 0, 0, l_linenumber)").alias("collected_at"),
        pick("l_orderkey", "", "Da Nang", " da nang ", "Hue").alias("search_query"),
    )


#: The same relation for DuckDB, as the first part of a WITH clause.
LISTING_SQL = """
WITH fx(currency, rate) AS (VALUES ('VND', 1.0::DOUBLE), ('USD', 25000.0), ('EUR', 27000.0), ('GBP', 31000.0)),
listing AS (
  SELECT l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR AS id, l_suppkey AS source_id,
         ['telegram', 'web', 'official-web'][l_suppkey % 3 + 1] AS source_type, n_name AS city,
         ['apartment', 'house', 'villa', 'room'][l_partkey % 4 + 1] AS kind, p_name AS title,
         l_extendedprice AS amount, ['VND', 'USD', 'EUR', 'GBP', 'RUB'][l_orderkey % 5 + 1] AS currency,
         ['month', 'month', 'night', 'week', 'year'][l_linenumber % 5 + 1] AS period,
         ['property', 'property', 'property', 'bedroom', 'room', 'bed', 'person'][l_quantity::INT % 7 + 1] AS basis,
         CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN -1.0 WHEN 2 THEN 1.5 ELSE l_partkey % 7 - 3 END::DOUBLE AS bedrooms,
         CASE WHEN p_size % 5 > 0 THEN p_size % 5 END::DOUBLE AS rooms, (l_linenumber % 4)::DOUBLE AS beds,
         p_size::VARCHAR AS rooms_label,
         CASE l_returnflag WHEN 'R' THEN 'unavailable' WHEN 'A' THEN 'available' END AS availability,
         CASE WHEN l_linestatus = 'F' THEN l_quantity > 5 END AS available_now, l_linenumber = 7 AS review_required,
         l_shipdate AS posted_at, l_shipdate + to_days(l_linenumber) AS collected_at,
         ['', 'Da Nang', ' da nang ', 'Hue'][l_orderkey % 4 + 1] AS search_query
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
),
priced AS (
  SELECT listing.*, CASE WHEN currency = 'VND' THEN floor(amount + 0.5) ELSE floor(amount * rate + 0.5) END::BIGINT AS price_vnd
  FROM listing LEFT JOIN fx USING (currency)
)
"""
