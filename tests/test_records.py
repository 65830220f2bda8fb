"""Spans, records, sources and the ring of ids by small cases."""

import collections
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quarry.functions import records, spans
from quarry.functions.text import stable_hash
from quarry.operators import inventory, offers
from quarry.streaming import messages

ENTITY = "array<struct<type:string,offset:long,length:long,url:string>>"


def units(text):
    return len(text.encode("utf-16-le")) // 2


def test_entities_mean_utf16_units(spark):
    text = "🙂 see\nмой 𝒜 site https://x.co and @name"
    at = lambda part: units(text[: text.index(part)])
    given = [
        ("messageEntityTextUrl", at("𝒜"), 2, "https://t.co"), ("messageEntityTextUrl", at("𝒜") + 1, 2, "https://t.co"), ("url", at("https"), 12, None), ("mention", at("x.co"), 4, None),
        ("mention", at("@name"), 5, None), ("mention", at("@name"), 6, None), ("email", -1, 3, None), ("email", 2, 0, None), ("bold", 3, 2, None), ("text_link", 3, 2, "ftp://x"), ("text_link", 3, 2, None), ("email", None, 2, None),
    ]
    df = spark.createDataFrame([(text, given), (None, given), ("x", None), ("", [])], f"t string, e {ENTITY}")
    got = [r[0] for r in df.select(spans.text_entities(F.col("t"), F.col("e"))).collect()]
    assert [(e.type, e.target, e.context) for e in got[0]] == [("text_link", "https://t.co", "мой 𝒜"), ("url", "https://x.co", "мой 𝒜 site https://x.co"), ("mention", "@name", "мой 𝒜 site https://x.co and @name")]
    assert got[1:] == [[], [], []]


def test_folded_spans_lead_back(spark):
    rnd = random.Random(2)
    parts = ["a", "é", "é", "ﬁ", "½", "Ⅷ", "👨‍👩‍👧", "\r\n", "한", "각", " ", "ｶﾞ", "x́̂"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(60)] + ["plain ascii", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", spans.lexemes(F.col("t")).alias("f")).collect()
    for r in rows:
        if r.t is None:
            assert r.f is None
            continue
        assert r.f.text == "".join(unicodedata.normalize("NFKC", c) for c in spans.regex.findall(r"\X", r.t)) and len(r.f.starts) == len(r.f.ends) == len(r.f.text)
        # the originals of all characters cover the text once
        assert "".join(r.t[a:b] for a, b in dict.fromkeys(zip(r.f.starts, r.f.ends, strict=True))) == r.t
    df = spark.createDataFrame([("Café ﬁve",)], "t string")
    found = lambda p: df.select(spans.found_in_source(F.col("t"), p)).first()[0]
    assert (found("Café"), found("five"), found("iv"), found("nothing")) == ("Café", "ﬁve", "ﬁv", None)


def test_canonical_options_and_overlays(spark):
    same = ['{"b":1.0,"a":{"z":[3,{"y":1,"x":2}],"c":null}}', '{ "a": {"c":null, "z":[3,{"x":2,"y":1.00}]}, "b":1}']
    df = spark.createDataFrame([(t,) for t in [*same, "no", None, '{"a":[2,1]}', '{"a":[1,2]}']], "t string")
    got = [r[0] for r in df.select(records.canonical(F.col("t"))).collect()]
    assert got[0] == got[1] and got[2:4] == [None, None] and got[4] != got[5]
    pairs = [('{"a":1,"filters":{"x":1,"y":2}}', '{"filters":{"y":3},"b":2}'), ('{"a":1}', '{"a":2}'), (None, '{"filters":{"q":[1]}}'), ('{"filters":{"x":1}}', None), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(records.overlay(F.col("a"), F.col("b"))).collect()]
    assert got == ['{"a":1,"b":2,"filters":{"x":1,"y":3}}', '{"a":2}', '{"filters":{"q":[1]}}', '{"filters":{"x":1}}', "{}"]


def test_bounded_records():
    bound = lambda value: records.bounded_record(json.dumps(value))
    deep = {"a": {"b": {"c": {"d": {"e": 1}, "f": 1}}}}
    assert bound(deep) == ('{"a":{"b":{"c":{"f":1}}}}', None)
    record, _ = bound({"text": "x" * 9000, "list": list(range(50)), "photos": [1], "nested": {"raw": 1, "n": None}, "buffer": {"type": "Buffer", "data": [1]}})
    assert json.loads(record) == {"text": "x" * 4096, "list": list(range(20)), "nested": {"n": None}}
    # past the byte budget only core fields stay, and the text halves until it fits
    record, _ = bound({"id": 1, "other": "y" * 4096, "more": "y" * 4096, "caption": "é" * 3000, "text": "é" * 4096})
    kept = json.loads(record)
    assert set(kept) == {"id", "caption", "text"} and len(record.encode()) <= records.BYTES and len(kept["text"]) == 1024
    assert bound({"a": [{"Session": 1}]}) == (None, "denied:session") and bound([1]) == (None, "no-object")
    assert records.bounded_record("{") == (None, "no-json") and records.bounded_record(None) == (None, "no-object") and bound({}) == ("{}", None)


def test_holdings_count_an_offer_once(spark):
    sources = spark.createDataFrame([("a", ["x", "y", "a"]), ("b", None), ("c", [])], "source_id string, aliases array<string>")
    rows = spark.createDataFrame([(1, ["x", "y", "x"], True), (2, ["a"], None), (3, ["b", "y"], True), (4, [], True), (5, None, True)], "offer_id int, source_ids array<string>, good boolean")
    got = {r.source_id: (r.offers, r.good) for r in inventory.source_holdings(sources, rows, {"good": F.col("good")}).collect()}
    assert got == {"a": (3, 2), "b": (1, 1), "c": (0, 0)}


def test_collection_states_in_any_order(spark):
    log = [(1, 1, 0, "offers", None, 5), (1, 2, 0, "failed", None, None), (1, 3, 0, "pending", None, 9), (1, 3, 1, "empty", False, None), (2, 1, 0, "failed", None, None), (3, 1, 0, "timeout", None, 1), (3, 2, 0, "empty", True, None), (4, 1, 0, "cancelled", None, None)]
    for seed in range(2):
        random.Random(seed).shuffle(log)
        df = spark.createDataFrame(log, "source int, attempted_at int, seq int, status string, history_complete boolean, pages int")
        got = {r.source: tuple(r)[1:] for r in inventory.collection_states(df, ["source"], ["pages"]).collect()}
        assert got == {1: ("empty", 3, 1, 5, 2, "degraded"), 2: ("failed", 1, None, None, 1, "new"), 3: ("empty", 2, 2, 1, 0, "current")}


def test_degraded_reaches_dependents_through_cycles(spark):
    states = spark.createDataFrame([(i, "degraded" if i in (5, 2) else "current") for i in range(9)], "source_id int, state string")
    depends = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (6, 7), (7, 6), (3, 6), (6, 3), (0, 0)], "source_id int, on int")
    got = {r.source_id: (r.state, r.through) for r in inventory.degraded_through(states, depends).collect()}
    assert got == {0: ("affected", 2), 1: ("affected", 2), 2: ("degraded", None), 3: ("affected", 5), 4: ("affected", 5), 5: ("degraded", None), 6: ("affected", 5), 7: ("affected", 5), 8: ("current", None)}


def test_discoveries_match_and_merge_in_any_split(spark):
    known = spark.createDataFrame([("s1", 2, ["p1"], ["Ann"], 0, "one", ["seed"]), ("s2", 1, ["p2"], ["ann", ""], 0, "two", ["seed"])], "source_id string, priority int, peer array<string>, username array<string>, seen int, title string, found_in array<string>")
    rows = [(1, "P1", "ann", 1, "first", ["x"]), (2, None, "ANN", 2, None, ["y"]), (3, "p9", "zed", 3, "z", ["x"]), (4, "", "", 4, "w", None), (5, "p1", None, 5, "last", ["x"])]
    found = spark.createDataFrame(rows, "candidate_id int, peer string, username string, seen int, title string, found_in array<string>")
    matched = inventory.match_known(found, known, ["peer", "username"])
    assert {r.candidate_id: (r.source_id, r.matched_by) for r in matched.collect()} == {1: ("s1", "peer"), 2: ("s2", "username"), 3: (None, None), 4: (None, None), 5: ("s1", "peer")}
    every = found.join(matched.select("candidate_id", "source_id"), "candidate_id")
    merge = lambda k, m: inventory.merge_discoveries(k, m, ["seen"], ["title"], ["found_in"]).drop("rows")
    once = {tuple(map(str, r)) for r in merge(known, every).collect()}
    split = merge(merge(known, every.where("candidate_id <= 2")), every)
    assert {tuple(map(str, r)) for r in split.collect()} == once and ("s1", "5", "last", "['seed', 'x']") in once


def test_the_last_ids_by_count_equal_a_plain_ring(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(k, n, str(rnd.randrange(9))) for k in range(3) for n in range(120)]
    messages.state_store(spark)
    df = spark.createDataFrame(rows, "k int, n int, id string")
    for part in range(3):
        df.where(F.col("n").between(part * 40, part * 40 + 39)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = messages.admit_recent(stream, "k", "id", ["n"], 4)
    out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    rings, want = collections.defaultdict(list), {}
    for k, n, i in rows:
        want[k, n] = i not in rings[k]
        rings[k] = (rings[k] + [i])[-4:] if want[k, n] else rings[k]
    assert {(r.k, r.n): r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want and not all(want.values())


@pytest.mark.parametrize("window", ["5 seconds", "1 second"])
def test_windows_open_with_a_first_event(spark, window):
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 2, None]), rnd.randrange(60)) for _ in range(200)] + [(3, None)]
    df = spark.createDataFrame(rows, "k int, s int").select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("at")).repartition(5)
    size, want = int(window.split()[0]), collections.Counter()
    for key in (1, 2, None):
        begin = None
        for s in sorted(s for k, s in rows if k == key and s is not None):
            begin = s if begin is None or s >= begin + size else begin
            want[key, begin] += 1
    got = {(r.k, int((r.start - __import__("datetime").datetime(1970, 1, 1)).total_seconds())): r.n for r in messages.first_of_window(df, "k", "at", window).collect()}
    assert got == want


def test_offers_of_odd_posts(spark):
    kind = "ordinal long, id string, source_id string, source_type string, text string, title string, kind string, location string, url string, official_url string, search_query string, posted_at timestamp_ntz, updated_at timestamp_ntz, amount double, currency string, period string, basis string, contacts struct<phone array<string>, telegram array<string>>, identifiers map<string,string>, photos array<string>"
    empty = [None] * 20
    rows = [(0, *empty[1:]), (1, None, " ", None, "\n\nFlat\nRent 5 million VND/month", *empty[5:]), (2, None, " ", None, "\n\nFlat\nRent 5 million VND/month", *empty[5:]), (3, "x", "s", "web", "Rent 300 RUB", *empty[5:13], 7.0, "EUR", "night", None, *empty[17:])]
    rates = spark.createDataFrame([("VND", 1.0), ("EUR", 2.0)], "currency string, rate double")
    got = {r.ordinal: r for r in offers.normalize_offers(spark.createDataFrame(rows, kind), rates, F.lit("2026-01-01").cast("timestamp_ntz")).collect()}
    assert (got[0].title, got[0].source_id, got[0].kind, got[0].amount, got[0].price_vnd, got[0].photos) == ("Accommodation", "unknown", "accommodation", None, None, [])
    assert got[1].id == got[2].id != got[0].id and got[1].title == "Flat" and got[1].price_vnd == 5_000_000
    assert (got[3].id, got[3].amount, got[3].currency, got[3].price_vnd, got[3].rate_source) == ("x", 7.0, "EUR", 14, "rate-table")


def test_posts_whose_short_hashes_agree_keep_their_own_ids(spark):
    """The 32-bit hashes of both keys (no url, text, no date) are equal."""
    kind = "ordinal long, id string, source_id string, source_type string, text string, title string, kind string, location string, url string, official_url string, search_query string, posted_at timestamp_ntz, updated_at timestamp_ntz, amount double, currency string, period string, basis string, contacts struct<phone array<string>, telegram array<string>>, identifiers map<string,string>, photos array<string>"
    texts = ("Flat ycemyoz", "Flat whranzn")
    keys = spark.createDataFrame([(f"\n{t}\n",) for t in texts], "key string")
    assert keys.select(stable_hash(F.col("key"))).distinct().count() == 1
    rows = spark.createDataFrame([(i, *[None] * 3, t, *[None] * 15) for i, t in enumerate(texts)], kind)
    rates = spark.createDataFrame([("VND", 1.0)], "currency string, rate double")
    ids = offers.normalize_offers(rows, rates, F.lit("2026-01-01").cast("timestamp_ntz")).select("id").distinct()
    assert ids.count() == 2
