"""Queries over graphs, entities and message streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph, resolve
from quarry.sources.listing import table
from quarry.streaming import messages


def eav_explode(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") > 5).alias("flag"))
    return graph.to_triples(rows, "s_suppkey")


def eav_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return graph.from_triples(graph.to_triples(rows, "s_suppkey"), {"/s_name": "string", "/s_nationkey": "int"})


def orphan_cascade(spark, sf_dir):
    """Orders hang on customers and on the order that closes their ten; customers in debt
    are gone."""
    entities = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    links = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("subject"), F.when(F.col("o_orderkey") % 10 > 0, F.concat(F.lit("o"), (F.col("o_orderkey") - F.col("o_orderkey") % 10).cast("string"))).otherwise(F.concat(F.lit("c"), "o_custkey")).alias("object"))
    return graph.prune_orphans(entities, links)


def cascade_delete(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").where("o_orderkey > 0").select(F.floor(F.col("o_orderkey") / 3).alias("parent"), F.col("o_orderkey").alias("child"))
    return graph.reach(edges, spark.createDataFrame([(7,), (11,)], "id long"))


def strong_components(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.array(F.concat(F.lit("a"), F.floor(F.col("event_id") / 3).cast("string")), F.when(F.col("event_id") % 9 == 2, F.concat(F.lit("b"), F.floor(F.col("event_id") / 18).cast("string"))).otherwise(F.concat(F.lit("own"), "event_id"))).alias("keys"))
    return graph.components(rows, F.col("keys"), "event_id")


def weak_veto(spark, sf_dir):
    """Pairs share a strong key; groups of six share a weak key, vetoed where units differ."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(i.alias("ordinal"), F.array(F.concat(F.lit("s"), F.floor(i / 2).cast("string"))).alias("strong"), F.array(F.concat(F.lit("w"), F.floor(i / 6).cast("string"))).alias("weak"), F.when(F.floor(i / 6) % 3 == 0, F.create_map(F.lit("unit"), F.floor(i / 2).cast("string"))).when(F.floor(i / 6) % 3 == 1, F.create_map(F.lit("unit"), F.lit("same"))).alias("identities"))
    return resolve.resolve(rows)


def message_apply(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 500).alias("message_id"), F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "edit").otherwise("new").alias("type"), "ts", "event_id", "value")
    return messages.current_messages(rows, ["user_id", "message_id"], ["ts", "event_id"], "2024-01-03 00:00:00").select("user_id", "message_id", "event_id", "value")


def album_assembly(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), F.when(F.col("turn") % 3 < 2, F.floor(F.col("turn") / 3)).alias("grouped_id"), F.when(F.col("role") == "user", F.md5("text")).alias("text"), F.concat(F.lit("p"), (F.col("turn") % 2).cast("string")).alias("media"))
    out = messages.albums(rows)
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return out.select("chat_id", "album", *[joined(F.col(c)).alias(c) for c in ("message_ids", "captions", "media")])


def rate_windows(spark, sf_dir):
    return messages.first_of_window(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


def recent_ids(spark, sf_dir):
    """Events of few ids as a stream of four batches; each user remembers four ids."""
    path = graph.shared_path(spark, "recent")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 11).cast("string").alias("id"))
    n = rows.agg(F.max("event_id")).first()[0] or 0
    messages.state_store(spark)
    # the files' times give the order of batches
    for part in range(4):
        rows.where((F.col("event_id") * 4 > n * part) & (F.col("event_id") * 4 <= n * (part + 1)) | (F.lit(part == 0) & (F.col("event_id") * 4 <= 0))).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = messages.admit_recent(stream, "user_id", "id", ["event_id"], 4)
    out.writeStream.format("parquet").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out").select("event_id", "user_id", "admitted")


def stream_dedup(spark, sf_dir):
    """The events table twice through a file stream; every event is admitted once."""
    path = graph.shared_path(spark, "stream")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    rows.unionByName(rows).write.mode("overwrite").parquet(f"{path}/in")
    stream = messages.admit_once(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), "event_id", "ts", "60 days")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out").select("event_id", "value")


SQL = {
    "eav_explode": """SELECT s_suppkey AS record, '/s_name' AS path, 'string' AS kind, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, '/s_nationkey', 'number', s_nationkey::VARCHAR FROM supplier
      UNION ALL SELECT s_suppkey, '/flag', 'boolean', (s_suppkey > 5)::VARCHAR FROM supplier WHERE s_suppkey % 3 > 0""",
    "eav_roundtrip": "SELECT s_suppkey AS record, s_name, s_nationkey FROM supplier",
    "orphan_cascade": """WITH l AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS subject, CASE WHEN o_orderkey % 10 > 0 THEN 'o' || (o_orderkey - o_orderkey % 10) ELSE 'c' || o_custkey END AS object, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) AS ok FROM orders)
      SELECT id, subject, object FROM l WHERE ok AND (starts_with(object, 'c') OR object IN (SELECT id FROM l WHERE ok))""",
    "cascade_delete": "WITH RECURSIVE r(id) AS (SELECT unnest([7, 11])::BIGINT UNION SELECT o_orderkey FROM orders JOIN r ON o_orderkey // 3 = id WHERE o_orderkey > 0) SELECT id FROM r",
    "strong_components": """WITH RECURSIVE k AS (SELECT event_id, 'a' || (event_id // 3) AS key FROM events UNION ALL SELECT event_id, 'b' || (event_id // 18) FROM events WHERE event_id % 9 = 2),
      e AS (SELECT x.event_id AS a, y.event_id AS b FROM k x JOIN k y USING (key)), r(id, ends) AS (SELECT event_id, event_id FROM events UNION SELECT r.id, e.b FROM r JOIN e ON r.ends = e.a)
      SELECT id, min(ends) AS component FROM r GROUP BY 1""",
    "weak_veto": "SELECT event_id AS ordinal, CASE WHEN event_id // 6 % 3 = 0 THEN event_id - event_id % 2 ELSE event_id - event_id % 6 END AS entity FROM events",
    "message_apply": """SELECT user_id, message_id, event_id, value FROM (SELECT *, event_id % 500 AS message_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 500 ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-03'""",
    "album_assembly": """WITH m AS (SELECT conv_id, conv_id * 100 + turn AS id, CASE WHEN turn % 3 < 2 THEN (turn // 3)::VARCHAR ELSE 'm' || (conv_id * 100 + turn) END AS album, CASE WHEN role = 'user' THEN md5(text) END AS text, 'p' || (turn % 2) AS media FROM conversations)
      SELECT conv_id AS chat_id, album, string_agg(id::VARCHAR, ',' ORDER BY id) AS message_ids, coalesce(string_agg(text, ',' ORDER BY id), '') AS captions, string_agg(media, ',' ORDER BY id) AS media FROM m GROUP BY ALL""",
    "rate_windows": """WITH RECURSIVE w(user_id, start) AS (SELECT user_id, min(ts) FROM events GROUP BY 1
        UNION ALL (SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.start + INTERVAL 6 HOURS GROUP BY w.user_id))
      SELECT w.user_id, w.start, count(*) AS n FROM events e ASOF JOIN w ON e.user_id = w.user_id AND e.ts >= w.start GROUP BY ALL""",
    "recent_ids": """WITH RECURSIVE e AS (SELECT user_id, event_id, event_id % 11 AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
      r(user_id, k, event_id, admitted, ring) AS (SELECT user_id, k, event_id, true, [id] FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.k, e.event_id, NOT list_contains(ring, e.id), CASE WHEN list_contains(ring, e.id) THEN ring ELSE list_slice(list_append(ring, e.id), -4, -1) END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
      SELECT event_id, user_id, admitted FROM r""",
    "stream_dedup": "SELECT event_id, value FROM events",
}
QUERIES = {n: globals()[n] for n in SQL}
