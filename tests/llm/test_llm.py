import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, decontam, exact_dedup, jaccard, line_dedup, packing, quality, queries, toxicity, url_filter, warc
from tests.oracle import DATA, same

SQL = queries.oracle_sql()
DOC = "doc_id long, text string, n long, `N_Lines` string"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, queries.queries()[name], SQL[name])


def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, ties, a long text, clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (None, "x y"), (None, None), (5, long), (6, long + " tail"), (7, " \n\t "), (8, "é" * 50)]
    return spark.createDataFrame([(i, t, 0, "z") for i, t in rows], DOC)


def test_exact_duplicates_odd_rows(spark):
    got = exact_dedup.exact_duplicates(odd_docs(spark), keep="max").collect()
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.text_sha256].append(r)
    assert len(got) == 11 and all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in groups.values())
    assert {r.keep_id for r in got if r.doc_id == 1} == {2}
    assert {r.keep_id for r in got if r.doc_id == 3} == {4}
    assert exact_dedup.exact_duplicates(odd_docs(spark).limit(0)).count() == 0
    low = exact_dedup.exact_duplicates(odd_docs(spark), keep="min").where("doc_id = 2").first()
    assert low.keep_id == 1 and not low.kept


def test_fold_events(spark):
    log = [
        (1, 0, "message", 1, "user", "hi"), (1, 1, "delta", 2, "assistant", "he"), (1, 2, "delta", 2, None, "llo"),
        (1, 3, "message", 3, "user", "more"), (1, 4, "regenerate", 2, "assistant", ""), (1, 5, "delta", 2, None, "bye"),
        (1, 6, "edit", 1, "user", "hey"), (1, 7, "message", 4, "user", "x"), (1, 8, "delete", 4, None, None),
        (2, 0, "message", 1, "user", None), (None, None, "message", None, None, "n"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    got = {(r.conv_id, r.message): (r.position, r.role, r.text) for r in chat.fold_events(df).collect()}
    assert got == {(1, 1): (1, "user", "hey"), (1, 2): (5, "assistant", "bye"), (2, 1): (1, "user", ""), (None, None): (1, None, "n")}


def plain_fold(log):
    """The events one after the other, by hand."""
    live = {}
    key = lambda e: (e[1] is not None, e[1] or 0, e[3] is not None, e[3] or 0, e[2], e[5] or "", e[4] is not None, e[4] or "")
    kind_of = lambda k: k if k in ("delta", "edit", "regenerate", "delete") else "message"
    log = [(c, s, kind_of(k), m, r, t) for c, s, k, m, r, t in log]
    for conv in {e[0] for e in log}:
        for at, (_, _, kind, message, role, text) in enumerate(sorted((e for e in log if e[0] == conv), key=key), 1):
            held = live.get((conv, message))
            if kind == "delete":
                live.pop((conv, message), None)
                continue
            if kind == "regenerate" and held:
                for other in [k for k, v in live.items() if k[0] == conv and v[0] >= held[0]]:
                    del live[other]
                held = None
            if held is None:
                held = live[(conv, message)] = [at, None, ""]
            held[1] = role if held[1] is None else held[1]
            held[2] = held[2] + (text or "") if kind == "delta" else text or ""
    return {k: tuple(v) for k, v in live.items()}


def test_fold_of_random_logs_equals_a_plain_loop(spark):
    r = random.Random(9)
    kinds = ["message", "delta", "delta", "edit", "regenerate", "regenerate", "delete", "odd", None]
    log = []
    for conv in [None, *range(60)]:
        for n in range(r.randint(1, 40)):
            log.append((conv, r.choice([None, n, n, n // 2]), r.choice(kinds), r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, "user", "assistant"]), r.choice([None, "", "a", "b", "é"])))
    log += log[:50]  # repeated rows
    df = spark.createDataFrame([(*e, "x", 1) for e in log], "conv_id long, seq long, kind string, message long, role string, text string, CUT string, position int")
    got = {(x.conv_id, x.message): (x.position, x.role, x.text) for x in chat.fold_events(df).collect()}
    assert got == plain_fold(log)
    for known in (chat.fold_events(df.limit(0)), chat.format_chat(chat.fold_events(df.limit(0)))):
        assert known.count() == 0
    assert chat.format_chat(chat.fold_events(df)).count() == len({c for c, _ in got})


def test_a_message_that_comes_again_stands_where_it_began_anew(spark):
    log = [(1, 1, "message", 1, "user", "one"), (1, 2, "message", 2, "user", "two"), (1, 3, "regenerate", 1, "user", "uno"), (1, 4, "message", 3, "user", "three"), (1, 5, "message", 2, "user", "two again"), (1, 6, "regenerate", 2, "user", "dos")]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    assert [x.text for x in chat.fold_events(df).orderBy("position").collect()] == ["uno", "three", "dos"]


def test_chat_of_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "x</s>"), (None, 2, "assistant", None), (2, 5, "assistant", "y")]
    df = spark.createDataFrame([(*r, "m", "f") for r in rows], "conv_id long, turn long, role string, text string, MESSAGE string, formatted string")
    got = {r.conv_id: r for r in chat.chat_query(df).collect()}
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert {k: (r.n_turns, r.loss_chars, r.turns_sha256) for k, r in got.items() if k != -7} == {1: (3, 0, digest(("", ""), ("user", "a"), ("user", "a"))), None: (2, 5, digest(("assistant", "x</s>"), ("assistant", ""))), 2: (1, 1, digest(("assistant", "y")))}


def test_escaping_is_reversible_and_hides_controls(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["<", "s>", "/", "\\", "[INST]", "</s>", "[", "INST]", "a"]) for _ in range(r.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for row in df.select("t", "e", chat.unescape(F.col("e")).alias("back")).collect():
        assert row.back == row.t and not any(c in row.e for c in chat.CONTROLS)


def test_chat_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.chat_query(empty).collect()] == [-7]


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def brute_groups(rows, k=5):
    sets = [frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []) for w in (words(t) for _, t in rows)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    low = collections.defaultdict(list)
    for i in range(len(rows)):
        low[root(i)].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min(low[root(i)])) for i in range(len(rows))]


def near_copies(seed=2, n=260):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(120)]
    rows = []
    for i in range(n):
        kind = i % 4
        if kind == 0:  # a group of near copies of one text
            w = list(base)
            for _ in range(r.randint(0, 7)):
                w[r.randrange(len(w))] = word()
        elif kind == 1:  # a passage that many share, with more or less of their own
            w = passage + [word() for _ in range(r.randint(0, 30))]
        elif kind == 2:
            w = [r.choice("xyz") for _ in range(r.randint(0, 9))]
        else:
            w = [word() for _ in range(60)]
        rows.append((i, " ".join(w)))
    return rows


def test_jaccard_equals_brute_force_on_hot_groups(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.jaccard_components(df, sample_mod=2).collect())
    assert got == sorted(brute_groups(rows))


def test_jaccard_when_names_of_sets_clash(spark):
    rows = near_copies(seed=5, n=200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.jaccard_components(df, sample_mod=2, node_bits=11).collect())
    assert got == sorted(brute_groups(rows))


def test_jaccard_equals_brute_force_on_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in jaccard.jaccard_components(df).collect()) == sorted(brute_groups(rows))


def test_jaccard_odd_rows(spark):
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_components(odd_docs(spark)).collect())
    assert got[(1, 2, 1)] == 2 and got[(2, 2, 1)] == 1 and got[(3, 0, 3)] == 1 and got[(None, 0, None)] == 1 and got[(7, 0, 7)] == 1
    assert got[(5, 977, 5)] == 1 and sum(got.values()) == 11
    assert jaccard.jaccard_components(odd_docs(spark).limit(0)).count() == 0


def judged_by_hand(url, rules):
    """host, path, rule, verdict by trying every rule."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0].lower()
    path = re.match("[^?#]*", rest[len(host) :])[0]
    fits = [(len(h) + len(p), len(h), v == "block", h + p) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, "allow" if best is None or not best[2] else "block"


def test_one_row_of_each_group_of_near_copies_stays(spark):
    text = "one two three four five six seven eight"
    rows = [(1, "clean text of its own here today"), (1, text), (2, text), (3, text + " nine"), (4, None), (4, None), (5, "alone in the wide world now"), (5, "alone in the wide world now"), (None, text), (6, "")]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, T64 int, gone_id string")
    left = jaccard.without_near_copies(df)
    got = collections.Counter((x.doc_id, x.text) for x in left.collect())
    assert left.columns == df.columns
    assert got == collections.Counter([(1, rows[0][1]), (1, text), (4, None), (4, None), (5, rows[6][1]), (6, "")])
    assert jaccard.without_near_copies(df.limit(0)).count() == 0


def test_url_rules_by_hand_in_one_pass_and_in_several(spark, monkeypatch):
    r = random.Random(3)
    urls = [f"http://{'a.' * (i % 3)}h{i}.com/{'en/' * (i % 2)}x{i}?q=//" for i in range(300)] + [None, "no url", "http://H1.com", "x://", "http://h2.comen/x", "http://h2.com", "HTTP://h2.com?x"]
    pages = spark.createDataFrame([(i, u, "a", "b", "c") for i, u in enumerate([*urls, *urls[:20]])], "page_id long, url string, HOST string, first string, Verdict string")
    rules = [(f"h{i}.com", r.choice(["/en/", "/", "", "/x"]), r.choice(["block", "allow"])) for i in range(0, 300, 2)] + [(None, "/", "block"), ("com", None, "block"), ("h2.com", "en", "block"), ("com", "/en/", "block"), ("h4.com", "/", "allow"), ("h4.com", "/", "block")]
    want = collections.Counter((i, *judged_by_hand(u, rules)) for i, u in enumerate([*urls, *urls[:20]]))
    known = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = lambda: collections.Counter((x.page_id, x.host, x.path, x.rule, x.verdict) for x in url_filter.judge_urls(pages, known).collect())
    assert got() == want and url_filter.judge_urls(pages, known).columns == ["page_id", "url", "first", "host", "path", "rule", "verdict"]
    monkeypatch.setattr(url_filter, "MAX_BITS", 800)
    assert url_filter.passes_for(len(rules)) == 3 and got() == want
    assert url_filter.judge_urls(pages.limit(0), known).count() == 0
    assert {x.verdict for x in url_filter.judge_urls(pages, known.limit(0)).collect()} == {"allow"}


def test_line_dedup_keeps_first_and_odd_rows(spark):
    rows = [(i, f"Shared LINE \nown {i}\n\n shared line") for i in range(12)] + [(100, None), (101, ""), (None, "shared line"), (102, "shared line\nshared line")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, N_LINES string, gone_id string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got[3] == ("own 3\n", 4, 2) and got[100] == ("", 1, 0) and got[101] == ("", 1, 0) and got[None] == ("", 1, 1) and got[102] == ("", 2, 2)
    kept = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df, keep_first=True).collect()}
    assert sum("shared line" in (t or "").lower() for t in kept.values()) == 1
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_line_filters_travel_whole_and_stay_exact_when_they_are_full(spark, monkeypatch):
    r = np.random.default_rng(1)
    for n in (0, 5, 32767, 32768, 32769, 900000):
        at = np.sort(r.choice(1 << line_dedup.CHUNK_BITS, n, replace=False))
        assert (line_dedup._positions(line_dedup._sent(at)) == at).all()
    # 200800 lines: a filter of four ranges, then one range of five bits a line
    rows = [(i, "\n".join([*(f"line {i} {j}" for j in range(500)), "common", f"pair {i // 2}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = {i: (502, 1) for i in range(400)}
    got = lambda **how: {x.doc_id: (x.n_lines, x.n_dropped) for x in line_dedup.drop_repeated_lines(df, **how).collect()}
    assert got() == want
    monkeypatch.setattr(line_dedup, "MAX_BITS", 1 << 20)
    assert got() == want and set(got(min_documents=2).values()) == {(502, 2)}


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def check_pieces(pieces, docs):
    coder, by, sequences = tokenizer(), collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for doc_id, texts in docs.items():
        got = collections.Counter()
        for p in by[doc_id]:
            got[(p.start, p.length, p.ids_crc32, p.doc_tokens)] += 1
        assert sum(p.length for p in by[doc_id]) == sum(len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
        if len(texts) == 1:
            ids, at = np.array([*coder.encode(texts[0] or "", add_special_tokens=False).ids, 2], "<u4"), 0
            for p in sorted(by[doc_id], key=lambda p: p.start):
                assert p.start == at and zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
                at += p.length
    for some in sequences.values():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or at & (at - 1) == 0


def test_packing_round_trip(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = {r.doc_id: [r.text] for r in df.collect()}
    check_pieces(packing.packing_query(df, queries.tokenizer_path()).collect(), docs)


def test_packing_odd_rows(spark):
    df = odd_docs(spark)
    docs = collections.defaultdict(list)
    for r in df.collect():
        docs[r.doc_id].append(r.text)
    check_pieces(packing.packing_query(df, queries.tokenizer_path()).collect(), docs)
    assert packing.packing_query(df.limit(0), queries.tokenizer_path()).count() == 0


def test_related_documents_share_sequences(spark):
    """Topics whose words a third of all rows hold; copies stand together."""
    r = random.Random(12)
    topics = [[f"{chr(97 + t)}{''.join(r.choice('aeioubcd') for _ in range(6))}" for _ in range(30)] for t in range(12)]
    common = ["always", "never", "between"]
    docs = [(i, " ".join([*common, *(r.choice(topics[i % 12]) for _ in range(300))])) for i in range(360)]
    pieces = packing.packing_query(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), queries.tokenizer_path()).collect()
    check_pieces(pieces, {i: [t] for i, t in docs})
    by = collections.defaultdict(collections.Counter)
    for p in pieces:
        by[p.sequence_id][p.doc_id % 12] += p.length
    same = sum(max(c.values()) for c in by.values()) / sum(sum(c.values()) for c in by.values())
    assert same > 0.6  # one in twelve by chance


def test_neighbours_are_ranked_by_bm25():
    docs = [np.array(x, np.uint16) for x in ([5, 6, 7], [9, 9, 10], [5, 6, 11], [12])]
    weight = np.ones(1 << 16)
    assert packing.Shard(docs, weight, 3.0).neighbours(0)[:2].tolist() == [0, 2]


def area_under_curve(scores, labels):
    """The chance that a positive row scores above a negative one."""
    yes, no = ([s for s, y in zip(scores, labels, strict=True) if bool(y) == want] for want in (True, False))
    return np.mean([(a > b) + (a == b) / 2 for a in yes for b in no])


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)
    # against the base rate: ranks, and both labels found
    assert area_under_curve([r.score for r in rows], [r.quality for r in rows]) > 0.95
    assert np.mean([r.predicted == 0 for r in rows if r.quality == 0]) > 0.7 and np.mean([r.predicted for r in rows if r.quality == 1]) > 0.9
    train = quality.quality_query(docs, labels)
    assert train.count() == docs.count()


def test_quality_of_whole_texts_and_odd_rows(spark):
    net = quality.fit([b"good words in a row " * 9, b"### %%% $$$ " * 9] * 12, np.array([1, 0] * 12, np.float32), epochs=3)
    scored = quality.score_quality(odd_docs(spark).withColumn("Score", F.lit("s")), net)
    rows = scored.collect()
    assert len(rows) == 11 and scored.columns.count("score") == 1 and all(0 <= r["score"] <= 1 for r in rows)
    text = b"plain words " * 3000
    both = np.frombuffer(text + text + b"###%%%$$$" * 20, np.uint8)
    x = quality.features(both, np.array([0, len(text), len(both)]), net.tables(), net.shift)
    assert not np.allclose(x[0], x[1])  # the end of a long text counts
    one = quality.fit([b"a"], np.array([1.0], np.float32))
    assert 0 < 1 / (1 + np.exp(-one.bias[0])) < 1


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_query(docs, labels).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").where("held_out").collect()
    assert np.mean([r.toxic == r.label for r in rows]) > 0.9
    assert all(0 <= r.expected_severity <= 3 for r in rows)
    assert area_under_curve([r.expected_severity for r in rows], [r.label for r in rows]) > 0.85
    assert np.mean([r.toxic for r in rows if r.label]) > 0.7 and np.mean([r.toxic for r in rows if not r.label]) < 0.05


def test_classifiers_without_labels_or_documents_or_with_one_label(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i}", "x", 1) for i in range(40)] + [(None, None, "x", 1), (7, "", "x", 1)], "doc_id long, text string, SCORE string, Toxic int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    for query in (quality.quality_query, toxicity.toxicity_query):
        assert query(docs, labels).count() == 42
        assert query(docs, labels.limit(0)).count() == 42
        assert query(docs.limit(0), labels).count() == 0


def test_severity_shares_weights_over_rising_cuts(spark):
    r = np.random.default_rng(0)
    hits = r.integers(0, 9, 500)
    x = np.stack([np.log1p(hits), np.zeros(500)], axis=1)
    w, cuts = toxicity.fit(x, np.digitize(hits, [2, 5, 7]))
    assert w[0] > 0 and np.all(np.diff(cuts) > 0)
    model = toxicity.Severity(np.zeros(0, np.uint64), np.zeros(1), np.full(3, 40.0))
    rows = toxicity.score_severity(odd_docs(spark).withColumn("TOXIC", F.lit(5)), model).collect()
    assert len(rows) == 11 and {x["toxic"] for x in rows} == {0}


def test_warc_odd_rows_and_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "x"), (1, "http://a", "x"), (2, None, "x"), (None, "u\r\n", None), (3, "u", ""), (4, "q", "é\r\n\r\n" * 40000)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/w"
    names = warc.write_archives(df, path, roll_bytes=50000)
    names.write.parquet(f"file://{tmp_path}/names")
    got = warc.read_archives(spark, path, spark.read.parquet(f"file://{tmp_path}/names")).collect()
    assert len(got) == 6 and not any(r.error for r in got)
    kinds = collections.Counter((r.record_id, r.record_type, r.refers_to) for r in got)
    assert kinds[("urn:page:1", "revisit", "urn:page:2")] == 2 and kinds[("urn:page:None", "revisit", "urn:page:3")] == 1
    long = next(r for r in got if r.record_id == "urn:page:4")
    assert bytes(long.payload).decode() == rows[-1][2] and long.payload_digest == warc.digest_of(rows[-1][2].encode())
    assert warc.warc_query(df.limit(0)).count() == 0


def test_warc_reader_finds_faults(tmp_path):
    import zstandard

    good = warc.record_bytes("response", "urn:page:1", "u", b"abc", warc.digest_of(b"abc"), None)
    frame = zstandard.ZstdCompressor().compress
    error = lambda data: [r["error"] for r in warc.records_of(data)]
    assert error(frame(good) * 2) == [None, None]
    assert error(frame(good.replace(b"Content-Length: 3", b"Content-Length: 4"))) == ["the block's length is wrong"]
    assert error(frame(good.replace(b"abc\r", b"abd\r"))) == ["the payload's digest is wrong"]
    assert error(frame(good)[:-3]) == ["the frame is cut short"]
    assert error(b"plain bytes here") == ["no frame here"]
    assert error(frame(good) + b"xy")[-1] == "bytes after the last frame"
    assert error(frame(b"no header")) == ["no WARC header"]
    samples = [warc.record_bytes("response", f"urn:page:{i}", f"http://x/{i}", b"payload %d " % i * 30, warc.digest_of(b"payload %d " % i * 30), None) for i in range(300)]
    trained = zstandard.train_dictionary(4096, samples)
    coder = zstandard.ZstdCompressor(dict_data=trained)
    archive = b"".join(coder.compress(s) for s in samples)
    assert error(warc.dictionary_frame(trained.as_bytes()) + archive) == [None] * 300
    packed = warc.dictionary_frame(frame(trained.as_bytes()))
    assert error(packed + archive) == [None] * 300
    assert error(archive)[0].startswith("broken frame")


def test_leaks_of_planted_items(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(3))
    vocabulary = [word() for _ in range(3000)]
    items = [[r.choice(vocabulary) for _ in range(r.randint(18, 50))] for _ in range(12)]
    docs, truth = [], set()
    for i in range(200):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 400))]
        if i % 5 == 0:
            k, at = r.randrange(12), r.randint(0, len(w))
            copy = list(items[k])
            if i % 10 == 0:
                copy[3] = word()
            w[at:at] = copy
            truth.add((i, k))
        docs.append((i, " ".join(w).upper() if i % 3 else ", ".join(w), "c"))
    df = spark.createDataFrame([*docs, (900, None, "c"), (None, "", "c")], "doc_id long, text string, cosine string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    leaks = decontam.find_leaks(df, bench)
    assert {(x.doc_id, x.item_id) for x in leaks.collect()} == truth
    left = decontam.without_leaks(df, leaks)
    assert left.count() == df.count() - len({i for i, _ in truth}) and left.columns == df.columns
    assert decontam.find_leaks(df.limit(0), bench).count() == 0
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0


def brute_leaks(docs, items, verbatim=0.75, paraphrase=0.5):
    """Every passage of every text against every item, without candidates."""
    out = set()
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    number = {w: i for i, w in enumerate(sorted({w for t in [*docs.values(), *items.values()] for w in split(t)}))}
    coded = lambda t: np.array([number[w] for w in split(t)], np.uint64)
    for i, text in docs.items():
        d = coded(text)
        for k, it in items.items():
            x = coded(it)
            n = len(x)
            for first in range(0, max(1, len(d) - decontam.STEP), decontam.STEP):
                region = d[max(0, first - n) : first + decontam.WINDOW + n]
                share = decontam.common_words(x, region) / n
                if share >= verbatim or (share >= paraphrase and decontam.holds(region, x[-min(n, 4) :])):
                    out.add((i, k))
                    break
    return out


def test_leaks_equal_brute_force_for_frequent_short_and_paraphrased_items(spark):
    """A passage in a third of all rows, items of one to five words, copies with words
    changed, left out and put in, copies of which half is left with the answer."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(3))
    vocabulary = [word() for _ in range(2000)]
    items = [[r.choice(vocabulary) for _ in range(n)] for n in (40, 30, 24, 36, 5, 3, 2, 1, 33, 60)]
    items.append([x for x in r.sample(vocabulary, 6) for _ in range(5)])
    docs = {}
    for i in range(240):
        w = [r.choice(vocabulary) for _ in range(r.choice([0, 20, 150, 300]))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = items[0]
        k = i % len(items)
        copy = list(items[k])
        if i % 4 == 1:
            copy = [word() if j % 4 == 3 else x for j, x in enumerate(copy)]
        if i % 4 == 2:
            copy = [x for j, x in enumerate(copy) if j % 5 or j >= len(copy) - 4]
        if i % 4 == 3:
            copy = [y for j, x in enumerate(copy) for y in ([x, word()] if j % 3 == 0 and j < len(copy) - 4 else [word() if j % 3 == 1 and j < len(copy) - 4 else x])]
        if i % 2:
            w[len(w) // 3 : len(w) // 3] = copy
        docs[i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = {k: " ".join(x) for k, x in enumerate(items)}
    want = brute_leaks({i: t for i, t in docs.items() if t}, bench)
    assert sum(k == 0 for _, k in want) >= 80
    assert {(x.doc_id, x.item_id) for x in decontam.find_leaks(df, spark.createDataFrame(list(bench.items()), "item_id long, text string"), second_look=True).collect()} == want
    # the latent space alone, which knows nothing of what frequent words say together
    alone = {(x.doc_id, x.item) for x in decontam.find_leaks(df, spark.createDataFrame(list(bench.items()), "item long, text string"), item_col="item").collect()}
    assert alone <= want and len(alone) >= 0.9 * len(want)


def test_sketch_spans_the_passages_of_all_texts(spark):
    """Against the exact space of the same passages; counts of texts are exact."""
    r = np.random.default_rng(2)
    topics = [[f"t{t}w{i}" for i in range(40)] for t in range(8)]
    texts = [" ".join(r.choice(topics[i % 8], 200)) for i in range(160)] + [None, "", "one"]
    df = spark.createDataFrame([(t or "", i) for i, t in enumerate(texts)], "text string, seed long").repartition(5)
    cells, counts, total = decontam.sketch(df, 64)
    assert total == 163
    words = {w for t in topics for w in t}
    import pyarrow as pa

    place = {w: int(decontam.features_of(h)[0]) for w, (_, h) in zip(sorted(words), decontam.texts_of(pa.array(sorted(words))), strict=True)}
    assert len(set(place.values())) < len(words) or all(counts[place[w]] == sum(w in (t or "").split() for t in texts) for w in words)
    space = decontam.latent_of(cells, np.ones(decontam.FEATURES), 8).embed
    held = [np.linalg.norm(space[[place[w] for w in topic]].sum(axis=0)) / np.sqrt(40) for topic in topics]
    assert min(held) > 0.9  # the direction of each topic lies in the space


def test_leaks_of_items_in_blocks(spark):
    r = random.Random(6)
    vocabulary = [f"word{i}" for i in range(3000)]
    items = [" ".join(r.choice(vocabulary) for _ in range(20)) for _ in range(30)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(60)) + " " + items[i % 30]) for i in range(90)] + [(5, None), (0, "repeated"), (0, "repeated")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (3, items[3])], "item_id long, text string")
    got = [(x.doc_id, x.item_id) for x in decontam.find_leaks(df, bench, block_items=8).collect()]
    assert sorted(got) == sorted((i, i % 30) for i in range(90))
    long = " ".join(r.choice(vocabulary) for _ in range(60000))
    odd = spark.createDataFrame([(1, long + " " + items[4], 7), (1, long + " " + items[4], 7), (None, items[5], 7)], "doc_id long, text string, ITEM int")
    assert sorted(((x.doc_id, x.item_id) for x in decontam.find_leaks(odd, bench).collect()), key=str) == [(1, 4), (None, 5)]


def test_recall_of_paraphrases(spark):
    """A third of the words replaced, the answer kept, cosine as shipped; and nothing that
    a search of all passages with the subsequence doesn't find."""
    r = random.Random(8)
    vocabulary = [f"w{i}x" for i in range(2500)]
    items = {k: " ".join(r.choice(vocabulary) for _ in range(r.randint(24, 50))) for k in range(60)}
    docs = {}
    for i in range(180):
        w = [r.choice(vocabulary) for _ in range(r.randint(30, 200))]
        if i % 3 == 0:
            copy = items[i % 60].split()
            for j in r.sample(range(len(copy) - 4), len(copy) // 3):
                copy[j] = r.choice(vocabulary)
            w[10:10] = copy
        docs[i] = " ".join(w)
    want = brute_leaks(docs, items)
    assert {(i, i % 60) for i in range(0, 180, 3)} <= want
    got = {(x.doc_id, x.item_id) for x in decontam.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == want


def test_the_latent_space_finds_what_an_exact_lookup_finds(spark):
    docs, bench = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "benchmark"))
    found = [{(x.doc_id, x.item_id) for x in decontam.find_leaks(docs, bench, second_look=look).collect()} for look in (False, True)]
    assert len(found[1]) > 20 and found[0] <= found[1] and len(found[0]) >= 0.95 * len(found[1])


def test_sums_past_half_precision_stay_whole():
    for n in (5, decontam.FEATURES):
        values = np.zeros(decontam.FEATURES)
        values[:n] = np.linspace(7e4, 3e5, n)
        batch = decontam._sent(0, 0, values, np.float16 if values.max() <= 6e4 else np.float32)
        assert np.allclose(decontam._cells(0, 1, batch["at"][0].as_py(), batch["held"][0].as_py()), values, rtol=1e-6)


def test_common_subsequence():
    r = np.random.default_rng(3)
    for _ in range(60):
        a, b = (r.integers(0, 6, r.integers(0, 70)).astype(np.uint64) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontam.common_words(a, b) == table[-1, -1]


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = p.quality(spark, docs, DATA).cache()
    assert kept.columns == docs.columns and kept.count() < docs.count()
    cleaned = p.lines(spark, kept, DATA).cache()
    counts = collections.Counter()
    for r in kept.collect():
        counts.update({x.strip(" \t\n\v\f\r").lower() for x in (r.text or "").split("\n")})
    gone = {x for x, n in counts.items() if n >= 10 and x}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if x.strip(" \t\n\v\f\r").lower() not in gone) for r in kept.collect()}
    assert {r.doc_id: r.text for r in cleaned.collect()} == want
    rows = [(r.doc_id, r.text) for r in cleaned.collect()]
    unique = p.near_duplicates(spark, cleaned, DATA).cache()
    assert sorted(r.doc_id for r in unique.collect()) == sorted({c for _, _, c in brute_groups(rows)})
    clean = p.decontaminate(spark, unique, DATA).cache()
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    whole = {r.doc_id: " ".join(re.findall(r"\w+", r.text.lower())) for r in unique.collect()}
    leaked = {d for d, t in whole.items() if any(" ".join(i) in t for i in items)}
    left = {r.doc_id for r in clean.collect()}
    assert not left & leaked and len(whole) - len(left) <= len(leaked) + 2
    check_pieces(p.pack(spark, clean, DATA).collect(), {r.doc_id: [r.text] for r in clean.collect()})


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    from quarry.llm.bytewords import utf8, word_hashes

    texts = ["a b", "", "A  b\tc", "ab", None, "é" * 9 + " x", "word"] * 3
    data, at = utf8(pa.array(texts))
    hashes, bounds = word_hashes(data, at)
    seen = {}
    for i, t in enumerate(texts):
        got = hashes[bounds[i] : bounds[i + 1]].tolist()
        assert len(got) == len(words(t))
        for w, h in zip(words(t), got, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert hashlib.sha256(hashes.tobytes()).hexdigest()


def test_parity_sketches_differ_in_no_more_bits_than_sets_in_tokens():
    rng = np.random.default_rng(4)
    for n, m, shared in ((0, 5, 0), (200, 190, 0), (200, 190, 150), (200, 200, 200), (5000, 4000, 3000)):
        same = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
        left, right = (np.unique(np.concatenate([same, rng.integers(0, 1 << 63, k - shared, dtype=np.uint64)])) for k in (n, m))
        differ = int(np.bitwise_count((jaccard._parity(left) ^ jaccard._parity(right)).view(np.uint64)).sum())
        apart = len(np.setxor1d(left, right))
        assert differ <= apart
        assert apart or differ == 0


def test_packing_takes_only_borders_from_a_sample(spark, monkeypatch):
    """Documents are not told twice, and equal ones are dealt to several partitions."""
    monkeypatch.setattr(packing, "SAMPLED", 10)
    texts = ["the same words again and again"] * 300 + [f"word{i} of text {i % 7}" for i in range(100)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = packing.pack_documents(docs, queries.tokenizer_path(), window=64)
    assert "rangepartitioning" not in out._jdf.queryExecution().toString().lower()
    rows = out.collect()
    held = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == held.get(r.doc_id, 0) and len(r.ids) == 4 * r.length
        held[r.doc_id] = r.start + r.length
    assert sorted(held) == list(range(len(texts))) and all(held[r.doc_id] == r.doc_tokens for r in rows)
    assert len({r.sequence_id >> 40 for r in rows if r.doc_id < 300}) > 1
