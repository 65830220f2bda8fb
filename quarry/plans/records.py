"""Queries over spans of texts, free-form records, and sources with their states."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import records, spans
from quarry.operators import inventory
from quarry.operators.graph import shared_path, stored
from quarry.sources import pages
from quarry.sources.listing import spread, table

SMILE, SCRIPT_A, CAFE, FIVE = "\U0001f642", "\U0001d49c", "Café", "ﬁve"


def text_entities(spark, sf_dir):
    """Turns with links and mentions behind characters of two UTF-16 units; a mention within
    the link comes before it or after it, others cut a character or leave the text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    url = F.concat(F.lit("https://x.example/"), "conv_id")
    text = F.concat(F.lit(SMILE), "role", F.lit(" "), url, F.lit(f"\n{SCRIPT_A} next @name"))
    entity = lambda kind, offset, length, link=None: F.struct(F.lit(kind).alias("type"), F.lit(offset).cast("long").alias("offset") if isinstance(offset, int) else offset.cast("long").alias("offset"), F.lit(length).cast("long").alias("length") if isinstance(length, int) else length.cast("long").alias("length"), (F.lit(None).cast("string") if link is None else link).alias("url"))
    at = F.length("role") + 3
    link, mention = entity("messageEntityUrl", at, F.length(url)), entity("mention", at + 8, 5)
    rest = F.array(entity("text_link", 0, 2, F.concat(F.lit("https://l.example/"), "turn")), entity("url", 1, 3), entity("email", at, 9999), entity("bold", 3, 1), entity("text_link", 3, 1, F.lit("javascript:x")), entity("messageEntityMention", at + F.length(url) + 9, 5))
    given = F.concat(F.when(F.col("turn") % 2 == 0, F.array(link, mention)).otherwise(F.array(mention, link)), rest)
    found = rows.select("conv_id", "turn", spans.text_entities(text, given).alias("e"))
    line = lambda field: F.array_join(F.transform("e", lambda e: e[field]), "|")
    return found.select("conv_id", "turn", line("type").alias("types"), line("target").alias("targets"), line("context").alias("contexts"))


def folded_spans(spark, sf_dir):
    """Names around a decomposed letter and a ligature: what the folded text finds, as the
    original writes it, and where."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(f" {CAFE} {FIVE} "), "p_name").alias("text"))
    folded = rows.withColumn("folded", spans.lexemes(F.col("text")))
    at = F.position(F.lit("five"), F.col("folded.text")) - 1
    span = spans.source_span(F.col("folded"), at, at + F.lit(4))
    return folded.select("p_partkey", F.length("folded.text").alias("folded_length"), span["start"].alias("start"), span["end"].alias("end"), F.substring(F.col("text"), span["start"] + 1, span["end"] - span["start"]).alias("found"), spans.found_in_source(F.col("text"), "Café").alias("cafe"))


def option_groups(spark, sf_dir):
    """Orders as subscriptions; half of them spell the same options in another order."""
    a = F.format_string('{"city":"%s","filters":{"max":10,"kinds":["a","b"],"min":1},"sort":"%s"}', "o_orderstatus", "o_orderpriority")
    b = F.format_string('{ "sort": "%s", "filters": {"min": 1.0, "kinds": ["a", "b"], "max": 10.0}, "city": "%s" }', "o_orderpriority", "o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subscription_id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 7 == 0, "no json").when(F.col("o_orderkey") % 2 == 0, a).otherwise(b).alias("raw"))
    return inventory.option_groups(rows, records.canonical(F.col("raw"))).select("options", "users", "subscriptions")


def option_overlay(spark, sf_dir):
    """Presets of nations with what a supplier changes of them."""
    base = F.format_string('{"limit":5,"city":"n%d","filters":{"min":1,"max":%d}}', "s_nationkey", "s_nationkey")
    n = F.col("s_suppkey") % 4
    over = F.when(n == 0, None).when(n == 1, F.format_string('{"limit":%d}', "s_suppkey")).when(n == 2, F.format_string('{"filters":{"max":%d,"kind":"room"}}', "s_suppkey")).otherwise('{"sort":"x","filters":{}}')
    return table(spark, sf_dir, "supplier").select("s_suppkey", records.overlay(base, over).alias("options"))


def bounded_records(spark, sf_dir):
    """Documents as raw records: long texts, lists and depths are cut, some hold secrets."""
    deep = F.expr("named_struct('a', named_struct('b', named_struct('c', named_struct('d', 1), 'e', 2)))")
    raw = F.struct(
        F.col("doc_id").alias("id"), "text", F.sequence(F.lit(1), F.lit(30)).alias("list"), deep.alias("deep"), F.array(F.lit(1)).alias("photos"),
        F.when(F.col("source") == "src1", F.struct(F.struct(F.lit("x").alias("Token")).alias("auth"))).alias("login"),
    )
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", records.bounded(F.to_json(raw)).alias("b"))
    part = lambda path: F.get_json_object("b.record", path)
    return rows.select("doc_id", F.col("b.refused").alias("refused"), F.md5(part("$.text")).alias("text_md5"), F.json_array_length(part("$.list")).alias("items"), part("$.deep").alias("deep"), part("$.photos").alias("photos"))


def source_holdings(spark, sf_dir):
    """Suppliers know their own number and, by an alias, the next one's."""
    name = lambda prefix, key: F.concat(F.lit(prefix), key)
    sources = table(spark, sf_dir, "supplier").select(name("s", F.col("s_suppkey")).alias("source_id"), F.array(name("a", F.col("s_suppkey")), name("a", F.col("s_suppkey") + 1), F.lit(None)).alias("aliases"))
    key = F.col("l_suppkey")
    offers = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("offer_id"), F.when(F.col("l_linenumber") == 7, F.array().cast("array<string>")).otherwise(F.array(name("s", key), name("a", key), name("a", key), F.lit(None))).alias("source_ids"), "l_returnflag")
    return inventory.source_holdings(sources, offers, {"returned": F.col("l_returnflag") == "R"})


STATUS = {"click": "offers", "view": "empty", "error": "failed", "purchase": "timeout", "signup": "pending"}


def _attempts(spark, sf_dir):
    status = F.element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), F.col("event_type"))
    return table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).alias("query"), F.col("ts").alias("attempted_at"), F.col("event_id").alias("seq"), status.alias("status"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 5 > 0).alias("history_complete"), F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("pages"))


def collection_states(spark, sf_dir):
    return inventory.collection_states(_attempts(spark, sf_dir), ["user_id", "query"], ["pages"])


def degraded_sources(spark, sf_dir):
    """Each user depends on the one with half the number."""
    states = inventory.collection_states(_attempts(spark, sf_dir), ["user_id"], []).select(F.col("user_id").alias("source_id"), "state")
    depends = states.where("source_id > 0").select("source_id", F.expr("source_id div 2").alias("on"))
    return inventory.degraded_through(states, depends)


def _discoveries(spark, sf_dir):
    name = lambda prefix, key: F.concat(F.lit(prefix), key)
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    known = table(spark, sf_dir, "supplier").select(name("s", s).alias("source_id"), (s % 5).alias("priority"), F.array(name("p", s), name("p", s + 7)).alias("peer"), F.array(name("u", s), name("u", s + 3)).alias("username"), F.lit(0).cast("long").alias("seen"), F.lit("old").alias("title"), F.array(F.lit("seed")).alias("found_in"))
    found = table(spark, sf_dir, "customer").select(c.alias("candidate_id"), F.when(c % 3 == 0, name("p", c % 300)).alias("peer"), F.when(c % 2 == 0, name("U", c % 250)).alias("username"), c.alias("seen"), F.when(c % 4 > 0, F.col("c_name")).alias("title"), F.array(F.col("c_mktsegment")).alias("found_in"))
    return known, found


def discovery_match(spark, sf_dir):
    known, found = _discoveries(spark, sf_dir)
    return inventory.match_known(found, known, ["peer", "username"])


def discovery_merge(spark, sf_dir):
    known, found = _discoveries(spark, sf_dir)
    matched = found.join(inventory.match_known(found, known, ["peer", "username"]).select("candidate_id", "source_id"), "candidate_id")
    out = inventory.merge_discoveries(known, matched, ["seen"], ["title"], ["found_in"])
    return out.withColumn("found_in", F.concat_ws(",", "found_in"))


def _imported(spark, sf_dir):
    """Customers as files of cards in three formats, one folder each; of those that a
    manifest lists some are gone, some have changed since, and some cards are broken."""
    path = shared_path(spark, "pages")
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, (k % 30).alias("file"), (k % 3).alias("kind"), F.col("c_name").alias("title"), F.floor("c_acctbal").cast("string").alias("price"))
    card = (
        F.when(F.col("c_custkey") % 50 == 0, "broken").when(F.col("kind") == 0, F.concat(F.lit('{"id":"'), "c_custkey", F.lit('","title":"'), "title", F.lit('","price":'), "price", F.lit("}")))
        .when(F.col("kind") == 1, F.concat_ws(",", "c_custkey", "title", F.when(F.col("c_custkey") % 20 == 1, "dear").otherwise(F.col("price")))).otherwise(F.concat(F.lit('<li data-id="'), "c_custkey", F.lit('" data-price="'), "price", F.lit('">\n<b>'), "title", F.lit("</b></li>")))
    )
    held = rows.groupBy("file", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", card.alias("card")))), lambda c: c["card"]), "\n").alias("value"))
    held = stored(held.withColumn("value", F.concat(F.when(F.col("kind") == 1, "id,title,price\n").otherwise(""), "value")), "held")
    held.where("file % 10 <> 2").select("file", "value").repartition("file").write.partitionBy("file").text(path)
    format = F.element_at(F.array(F.lit("jsonl"), F.lit("csv"), F.lit("html")), F.col("kind").cast("int") + 1)
    manifest = held.where("file % 10 <> 3").select(F.col("file").cast("string").alias("name"), F.sha2(F.concat(F.when(F.col("file") % 10 == 1, "old ").otherwise(""), "value", F.lit("\n")), 256).alias("sha256"), F.when(F.col("file") == 5, "pdf").otherwise(format).alias("format"), F.concat(F.lit("s"), "file").alias("source_id"))
    return pages.checked_files(pages.files_of(spark, path, r"/file=([^/]+)/"), manifest)


def imported_cards(spark, sf_dir):
    return pages.cards(_imported(spark, sf_dir)).select("name", "source_id", "id", "title", "price", "fault")


def import_report(spark, sf_dir):
    checked = stored(_imported(spark, sf_dir), "checked")
    return pages.import_report(checked, pages.cards(checked))


_ATTEMPT = f"""a AS (SELECT user_id, event_id % 3 AS query, ts, event_id, MAP {STATUS}[event_type] AS status, CASE WHEN event_id % 2 = 0 THEN event_id % 5 > 0 ELSE true END AS whole, CASE WHEN event_id % 4 = 0 THEN event_id END AS pages FROM events WHERE event_type <> 'signup')"""
_MATCH = """k AS (SELECT s_suppkey AS s, s_suppkey % 5 AS priority, 's' || s_suppkey AS source_id FROM supplier),
      f AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 300 END AS peer, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 250 END AS username, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS title, c_mktsegment AS seg FROM customer),
      m AS (SELECT c, source_id, 'peer' AS matched_by, 0 AS place, priority FROM f JOIN k ON peer IN (s, s + 7) UNION ALL SELECT c, source_id, 'username', 1, priority FROM f JOIN k ON username IN (s, s + 3)),
      b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY c ORDER BY place, priority, source_id) = 1)"""
_FILES = """c AS (SELECT c_custkey AS k, c_custkey % 30 AS f, c_custkey % 3 AS kind, c_name, floor(c_acctbal) AS p FROM customer),
      f AS (SELECT DISTINCT f, ['jsonl', 'csv', 'html'][kind + 1] AS format FROM c), s AS (SELECT f, CASE f % 10 WHEN 2 THEN 'missing' WHEN 3 THEN 'unlisted' WHEN 1 THEN 'changed' ELSE CASE WHEN f = 5 THEN 'unknown-format' ELSE 'ok' END END AS state, CASE WHEN f % 10 = 3 THEN NULL WHEN f = 5 THEN 'pdf' ELSE format END AS format FROM f),
      r AS (SELECT c.*, CASE WHEN k % 50 = 0 THEN 'no-card' WHEN kind = 1 AND k % 20 = 1 THEN 'no-price' END AS fault FROM c JOIN s USING (f) WHERE state = 'ok' AND NOT (kind = 2 AND k % 50 = 0))"""
SQL = {
    "imported_cards": f"""WITH {_FILES} SELECT f::VARCHAR AS name, 's' || f AS source_id, CASE WHEN fault IS NULL OR fault = 'no-price' THEN k::VARCHAR END AS id, CASE WHEN fault IS NULL OR fault = 'no-price' THEN c_name END AS title, CASE WHEN fault IS NULL THEN p::DOUBLE END AS price, fault FROM r""",
    "import_report": f"""WITH {_FILES} SELECT s.f::VARCHAR AS name, state, format, count(r.k) - count(r.fault) AS cards, count(r.fault) AS faults FROM s LEFT JOIN r ON r.f = s.f GROUP BY ALL""",
    "text_entities": f"""WITH t AS (SELECT conv_id, turn, role, 'https://x.example/' || conv_id AS url FROM conversations)
      SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'url' ELSE 'mention' END || '|text_link|mention' AS types, CASE WHEN turn % 2 = 0 THEN url ELSE 'x.exa' END || '|https://l.example/' || turn || '|@name' AS targets,
        '{SMILE}' || role || ' ' || CASE WHEN turn % 2 = 0 THEN url ELSE 'https://x.exa' END || '|{SMILE}|{SCRIPT_A} next @name' AS contexts FROM t""",
    "folded_spans": f"""SELECT p_partkey, 2 * length(p_name) + 11 AS folded_length, length(p_name) + 7 AS start, length(p_name) + 10 AS "end", '{FIVE}' AS found, '{CAFE}' AS cafe FROM part""",
    "option_groups": """SELECT '{"city":"' || o_orderstatus || '","filters":{"kinds":["a","b"],"max":10,"min":1},"sort":"' || o_orderpriority || '"}' AS options, count(DISTINCT o_custkey) AS users, count(*) AS subscriptions FROM orders WHERE o_orderkey % 7 > 0 GROUP BY 1""",
    "option_overlay": """SELECT s_suppkey, '{"city":"n' || s_nationkey || '","filters":{' || CASE WHEN s_suppkey % 4 = 2 THEN '"kind":"room","max":' || s_suppkey ELSE '"max":' || s_nationkey END || ',"min":1},"limit":' || CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey ELSE 5 END || CASE WHEN s_suppkey % 4 = 3 THEN ',"sort":"x"' ELSE '' END || '}' AS options FROM supplier""",
    "bounded_records": """SELECT doc_id, CASE WHEN source = 'src1' THEN 'denied:token' END AS refused, CASE WHEN source <> 'src1' THEN md5(left(text, 4096)) END AS text_md5, CASE WHEN source <> 'src1' THEN 20 END AS items, CASE WHEN source <> 'src1' THEN '{"a":{"b":{"e":2}}}' END AS deep, NULL::VARCHAR AS photos FROM documents""",
    "source_holdings": """WITH l AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1)
      SELECT 's' || s_suppkey AS source_id, coalesce(sum(n), 0)::BIGINT AS offers, coalesce(sum(r), 0)::BIGINT AS returned FROM supplier LEFT JOIN l ON l_suppkey IN (s_suppkey, s_suppkey + 1) GROUP BY 1""",
    "collection_states": f"""WITH {_ATTEMPT}, s AS (SELECT user_id, query, max((ts, event_id)) FILTER (status IN ('offers', 'empty') AND whole) AS seen, arg_max(status, (ts, event_id)) AS status, max(ts) AS attempted_at, arg_max(pages, (ts, event_id)) FILTER (pages IS NOT NULL) AS pages FROM a GROUP BY ALL),
      n AS (SELECT user_id, query, count(*) AS failures FROM a JOIN s USING (user_id, query) WHERE seen IS NULL OR (ts, event_id) > seen GROUP BY ALL)
      SELECT user_id, query, status, attempted_at, seen[1] AS collected_at, pages, coalesce(failures, 0) AS failures, CASE WHEN failures >= 2 THEN 'degraded' WHEN seen IS NULL THEN 'new' ELSE 'current' END AS state FROM s LEFT JOIN n USING (user_id, query)""",
    "degraded_sources": f"""WITH RECURSIVE {_ATTEMPT}, s AS (SELECT user_id, max((ts, event_id)) FILTER (status IN ('offers', 'empty') AND whole) AS seen FROM a GROUP BY 1),
      n AS (SELECT user_id, count(*) FILTER (seen IS NULL OR (ts, event_id) > seen) AS failures, any_value(seen) IS NULL AS none FROM a JOIN s USING (user_id) GROUP BY 1), st AS (SELECT user_id, CASE WHEN failures >= 2 THEN 'degraded' WHEN none THEN 'new' ELSE 'current' END AS state FROM n),
      up(id, node) AS (SELECT user_id, user_id FROM st UNION SELECT id, node // 2 FROM up JOIN st ON node = user_id WHERE node > 0), d AS (SELECT id, min(node) AS low FROM up JOIN st ON user_id = node AND state = 'degraded' GROUP BY 1)
      SELECT user_id AS source_id, CASE WHEN state <> 'degraded' AND low IS NOT NULL THEN 'affected' ELSE state END AS state, CASE WHEN state <> 'degraded' THEN low END AS through FROM st LEFT JOIN d ON id = user_id""",
    "discovery_match": f"WITH {_MATCH} SELECT f.c AS candidate_id, source_id, matched_by FROM f LEFT JOIN b ON b.c = f.c",
    "discovery_merge": f"""WITH {_MATCH}, r AS (SELECT source_id, 0 AS seen, 'old' AS title, 'seed' AS seg FROM k UNION ALL SELECT coalesce(source_id, 'new:' || f.c), f.c, title, seg FROM f LEFT JOIN b ON b.c = f.c)
      SELECT source_id, max(seen) AS seen, arg_max(title, seen) FILTER (title IS NOT NULL) AS title, string_agg(DISTINCT seg, ',' ORDER BY seg) AS found_in, count(*) AS rows FROM r GROUP BY 1""",
}
QUERIES = {n: globals()[n] for n in SQL}
