"""Queries over histories, retention and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import history, retention, sources
from quarry.sources.listing import LISTING_SQL, listings, table

NOW = "2024-01-20 00:00:00"


def observations(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("source"), F.floor("o_totalprice").alias("price"), F.col("o_orderdate").alias("seen_at"), F.col("o_orderkey").alias("seq"))


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def price_changes(spark, sf_dir):
    out = history.price_changes(observations(spark, sf_dir), ["entity", "source"], ["seen_at", "seq"])
    return out.withColumn("percent", F.round("percent", 6))


def current_price(spark, sf_dir):
    return history.current_price(observations(spark, sf_dir), ["entity"], "source", ["seen_at", "seq"])


def latest_per_key(spark, sf_dir):
    return history.latest_per_key(events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts")


def bounded_history(spark, sf_dir):
    rows = history.newest(observations(spark, sf_dir), ["entity"], ["seen_at", "seq"], 4)
    return rows.groupBy("entity").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("seen_at", "seq"))), lambda x: x["seq"].cast("string"))).alias("seqs"))


def merged_attributes(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("entity", F.concat_ws("/", "city", "title"))
    out = history.merge_attributes(rows, "entity", ["posted_at", "id"], ["bedrooms", "availability"], ["kind", "source_type"])
    return out.select("entity", "bedrooms", "availability", *[F.concat_ws(",", c).alias(c) for c in ("kind", "source_type")])


def effective_chronology(spark, sf_dir):
    rows = events(spark, sf_dir)
    edited = F.when(F.col("event_id") % 3 == 0, F.expr("ts + interval 1 day"))
    posted = F.when(F.col("event_id") % 5 > 0, F.col("ts"))
    at = history.effective_time(edited, posted, fallback=F.lit("2023-01-01 00:00:00").cast("timestamp_ntz"))
    return rows.groupBy("event_type").agg(F.min(at).alias("first"), F.max(at).alias("last"))


def epoch_dates(spark, sf_dir):
    n = F.col("event_id") * 100000 + 1
    return events(spark, sf_dir).select("event_id", F.unix_millis(history.epoch_time(n)).alias("ms"), F.unix_millis(history.epoch_time(n * 1000)).alias("ms_of_ms"))


def append_merge(spark, sf_dir):
    old = events(spark, sf_dir).where("event_id % 3 <> 0").select("event_id", F.lit("old").alias("origin"), "value")
    new = events(spark, sf_dir).where("event_id % 2 = 0").select("event_id", F.lit("new").alias("origin"), "value")
    return retention.upsert(old, new, "event_id")


def insert_if_absent(spark, sf_dir):
    old = events(spark, sf_dir).where("event_id % 3 <> 0").select("event_id", F.lit("old").alias("origin"))
    return retention.upsert(old, events(spark, sf_dir).where("event_id % 2 = 0").select("event_id", F.lit("new").alias("origin")), "event_id", replace=False)


def keep_newest(spark, sf_dir):
    return retention.keep_newest(events(spark, sf_dir), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 10).select("user_id", "event_id")


def byte_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return retention.within_bytes(docs, ["source"], [F.col("doc_id").desc()], F.col("n_chars"), 60000, F.col("doc_id") % 10 == 0).select("doc_id", "source")


def variants(spark, sf_dir):
    return events(spark, sf_dir).select(F.concat(F.lit("o"), (F.col("event_id") % 97).cast("string")).alias("offer_id"), F.col("user_id").alias("source_id"), "event_id").groupBy("offer_id", "source_id").agg(F.collect_list(F.col("event_id").cast("string")).alias("message_ids"))


def delete_by_message(spark, sf_dir):
    gone = events(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").alias("source_id"), F.col("event_id").cast("string").alias("message_id"))
    return retention.delete_messages(variants(spark, sf_dir), gone).select("offer_id", "source_id", F.size("message_ids").cast("long").alias("n"))


def unseen_antijoin(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.col("event_id").alias("offer_id"), F.array(F.col("event_id"), F.col("event_id") + 1).alias("aliases"), "event_type")
    return retention.unseen(rows.where("event_type = 'view'"), rows.where("event_type = 'click'")).select("user_id", "offer_id")


def bag_difference(spark, sf_dir):
    pick = lambda kind: events(spark, sf_dir).where(F.col("event_type") == kind).select("user_id")
    return retention.same_rows(pick("view"), pick("click")).groupBy("side", "user_id").agg(F.count("*").alias("n"))


def source_rank_caps(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("cohort"), "s_acctbal")
    return sources.cap_by_cohort(rows, "cohort", "s_acctbal", "s_suppkey", 2).select("s_suppkey", "cohort", "place")


def refresh_schedule(spark, sf_dir):
    users = events(spark, sf_dir).select("user_id").distinct()
    states = events(spark, sf_dir).where("event_type = 'purchase' AND value > 50").groupBy("user_id").agg(F.max("ts").alias("state_at"), F.min("ts").alias("attempted_at"))
    offers = events(spark, sf_dir).where("event_type = 'view'").select("user_id", F.col("ts").alias("collected_at"))
    return sources.refresh_order(users, states, offers, "user_id", NOW, "6 hours").select("user_id", "fresh", "attempted_at")


def outcome_summary(spark, sf_dir):
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "offers", "view", "empty", "error", "failed", "purchase", "incomplete", "signup", "timeout")]), F.col("event_type"))
    return sources.outcome_summary(events(spark, sf_dir).withColumn("status", status), "user_id")


def field_coverage(spark, sf_dir):
    return sources.field_coverage(listings(spark, sf_dir, places=False), "source_id", ["bedrooms", "rooms", "beds"])


def inventory_first_match(spark, sf_dir):
    left = table(spark, sf_dir, "supplier").select("s_suppkey")
    right = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("alias"), "c_mktsegment")
    return sources.by_first_alias(left, "s_suppkey", F.array(F.col("s_suppkey") * 2, F.col("s_suppkey") * 3, F.col("s_suppkey") + 1), right, "alias")


def completeness(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cohort"), F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") % 4 > 0).alias("enabled"), F.when(F.col("s_acctbal") > 0, "complete").otherwise("degraded").alias("state"))
    out = sources.completeness(rows, "cohort")
    return out.withColumn("outstanding", F.concat_ws(",", F.transform("outstanding", lambda x: x.cast("string"))))


def precision_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    out = sources.precision_recall(rows.select("lang", (F.col("quality") == 1).alias("expected"), (F.col("n_chars") > 1000).alias("actual")), "lang")
    return out.select("lang", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def audit_full_outer(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    before = rows.where("doc_id % 3 > 0").select("doc_id", (F.col("quality") == 1).alias("passed"))
    after = rows.where("doc_id % 5 > 0").select("doc_id", (F.col("toxic") == 0).alias("passed"))
    return sources.audit(before, after, "doc_id").groupBy("change").agg(F.count("*").alias("n"))


OBS = "WITH obs AS (SELECT o_custkey AS entity, o_orderpriority AS source, floor(o_totalprice)::BIGINT AS price, o_orderdate AS seen_at, o_orderkey AS seq FROM orders) "
SQL = {
    "price_changes": OBS + """SELECT entity, source, seen_at, seq, CASE WHEN price > previous THEN 'up' ELSE 'down' END AS direction, previous, price AS current, price - previous AS delta,
      round((price - previous) / previous * 100, 6) AS percent FROM (SELECT *, lag(price) OVER (PARTITION BY entity, source ORDER BY seen_at, seq) AS previous FROM obs) WHERE previous <> price""",
    "current_price": OBS + """SELECT entity, min(price) AS price, arg_min(source, (price, source)) AS source FROM
      (SELECT entity, source, arg_max(price, (seen_at, seq)) AS price FROM obs GROUP BY entity, source) GROUP BY entity""",
    "latest_per_key": "SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "bounded_history": OBS + "SELECT entity, string_agg(seq::VARCHAR, ',' ORDER BY seen_at, seq) AS seqs FROM (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY entity ORDER BY seen_at DESC, seq DESC) <= 4) GROUP BY entity",
    "merged_attributes": LISTING_SQL + """SELECT city || '/' || title AS entity, arg_max(bedrooms, (posted_at, id)) FILTER (bedrooms IS NOT NULL) AS bedrooms,
      arg_max(availability, (posted_at, id)) FILTER (availability IS NOT NULL) AS availability, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kind, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS source_type FROM listing GROUP BY 1""",
    "effective_chronology": """SELECT event_type, min(eff) AS first, max(eff) AS last FROM (SELECT event_type, coalesce(greatest(CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY END, CASE WHEN event_id % 5 > 0 THEN ts END), TIMESTAMP '2023-01-01') AS eff FROM events) GROUP BY 1""",
    "epoch_dates": """SELECT event_id, (event_id * 100000 + 1) * 1000 AS ms, CASE WHEN (event_id * 100000 + 1) * 1000 < 1000000000000 THEN (event_id * 100000 + 1) * 1000000 ELSE (event_id * 100000 + 1) * 1000 END AS ms_of_ms FROM events""",
    "append_merge": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS origin, value FROM events WHERE event_id % 2 = 0 OR event_id % 3 <> 0",
    "insert_if_absent": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'old' ELSE 'new' END AS origin FROM events WHERE event_id % 2 = 0 OR event_id % 3 <> 0",
    "keep_newest": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10",
    "byte_budget": "SELECT doc_id, source FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id % 10 > 0, doc_id DESC ROWS UNBOUNDED PRECEDING) AS b FROM documents) WHERE b <= 60000 OR doc_id % 10 = 0",
    "delete_by_message": """SELECT 'o' || (event_id % 97) AS offer_id, user_id AS source_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) FILTER (event_type = 'error') = 0""",
    "unseen_antijoin": """SELECT user_id, event_id AS offer_id FROM events v WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = v.user_id AND abs(c.event_id - v.event_id) <= 1)""",
    "bag_difference": """WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b FROM events GROUP BY 1)
      SELECT CASE WHEN a > b THEN 'left' ELSE 'right' END AS side, user_id, abs(a - b) AS n FROM n WHERE a <> b""",
    "source_rank_caps": "SELECT s_suppkey, s_nationkey AS cohort, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier QUALIFY place <= 2",
    "refresh_schedule": """WITH s AS (SELECT user_id, max(ts) AS state_at, min(ts) AS attempted_at FROM events WHERE event_type = 'purchase' AND value > 50 GROUP BY 1),
      o AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-19 18:00:00' AND TIMESTAMP '2024-01-20')
      SELECT u.user_id, CASE WHEN state_at IS NOT NULL THEN state_at BETWEEN TIMESTAMP '2024-01-19 18:00:00' AND TIMESTAMP '2024-01-20' ELSE o.user_id IS NOT NULL END AS fresh, attempted_at
      FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s USING (user_id) LEFT JOIN o ON o.user_id = u.user_id""",
    "outcome_summary": """SELECT user_id, count(*) AS total, count(*) FILTER (event_type IN ('click', 'view')) AS succeeded, count(*) FILTER (event_type NOT IN ('click', 'view')) AS failed,
      bool_and(event_type NOT IN ('click', 'view')) AS all_failed, bool_or(event_type = 'purchase') AS incomplete FROM events GROUP BY 1""",
    "field_coverage": LISTING_SQL + """SELECT source_id, count(*) AS total, 'bedrooms' AS field, count(bedrooms) AS known, count(*) FILTER (bedrooms > 0) AS positive FROM listing GROUP BY 1
      UNION ALL SELECT source_id, count(*), 'rooms', count(rooms), count(*) FILTER (rooms > 0) FROM listing GROUP BY 1 UNION ALL SELECT source_id, count(*), 'beds', count(beds), count(*) FILTER (beds > 0) FROM listing GROUP BY 1""",
    "inventory_first_match": """SELECT s_suppkey, c_custkey AS alias, c_mktsegment FROM (SELECT s_suppkey, c_custkey, c_mktsegment FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey IN (s_suppkey * 2, s_suppkey * 3, s_suppkey + 1)
      QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY CASE c_custkey WHEN s_suppkey * 2 THEN 0 WHEN s_suppkey * 3 THEN 1 ELSE 2 END) = 1)""",
    "completeness": """SELECT s_nationkey AS cohort, count(*) AS sources, coalesce(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) FILTER (s_suppkey % 4 > 0 AND s_acctbal <= 0), '') AS outstanding, count(*) FILTER (s_suppkey % 4 = 0) AS left_out,
      count(*) FILTER (s_suppkey % 4 > 0) > 0 AND count(*) FILTER (s_suppkey % 4 > 0 AND s_acctbal <= 0) = 0 AS complete FROM supplier GROUP BY 1""",
    "precision_recall": """WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (quality <> 1 AND n_chars > 1000) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 1000) AS fn FROM labels JOIN documents USING (doc_id) GROUP BY 1)
      SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""",
    "audit_full_outer": """WITH b AS (SELECT doc_id, quality = 1 AS p FROM labels WHERE doc_id % 3 > 0), a AS (SELECT doc_id, toxic = 0 AS p FROM labels WHERE doc_id % 5 > 0)
      SELECT CASE WHEN b.p IS NULL THEN 'added' WHEN a.p IS NULL THEN 'missing' WHEN b.p AND NOT a.p THEN 'regression' WHEN NOT b.p AND a.p THEN 'improvement' ELSE 'same' END AS change, count(*) AS n FROM b FULL JOIN a USING (doc_id) GROUP BY 1""",
}

QUERIES = {n: globals()[n] for n in SQL}
