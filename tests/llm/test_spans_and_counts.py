"""Alignment, personal data and divergence against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import alignment, divergence, exact_dedup, personal, queries
from quarry.llm.tokens import BYTE_LEVEL
from tests.oracle import DATA

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a  b", "\n x \n  y\t", "<s> <|endoftext|>a</s>", "a▁b", "é é ﬁ①", "x" * 5000, "日本語 テキスト🙂 ", "don't  'll   stop", "\x1c a\x1f b\x85 c  d　 e", "<0x41> A"]


@pytest.fixture(scope="module")
def plain_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_alignment(tools, text):
    """n_a, n_b, groups as written and links of one text, token by token."""
    if not text:
        return 0, 0, "", []
    shown = {i: b for b, i in BYTE_LEVEL.items()}
    a, b = tools[0].encode(" " + text, add_special_tokens=False).ids, tools[1].encode(text)
    a_bytes = [bytes(shown.get(ord(c), ord(c)) for c in tools[0].id_to_token(i)) for i in a]
    b_bytes = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", p)) else p.replace("▁", " ").encode() for p in map(tools[1].id_to_piece, b)]
    if {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
        return 0, 0, "", []
    groups, links, i, j, a_end, b_end = [], [], 0, 0, 0, 0
    left, right = [], []
    while i < len(a) or j < len(b):
        if a_end <= b_end and i < len(a):
            a_end, i = a_end + len(a_bytes[i]), i + 1
            left.append(a[i - 1])
        else:
            b_end, j = b_end + len(b_bytes[j]), j + 1
            right.append(b[j - 1])
        if a_end == b_end:
            groups.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
            links.append((left[-1], right[-1]))
            left, right = [], []
    return len(a), len(b), ";".join(groups), links


def check_alignment(tools, texts, rows):
    plain = {k: plain_alignment(tools, t) for k, t in texts.items()}
    counts = collections.Counter(x for p in plain.values() for x in p[3])
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    assert len(rows) == len(texts)
    for r in rows:
        n_a, n_b, groups, links = plain[r[0]]
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        best = sum(counts[x] == most[x[1]] for x in links)
        assert tuple(r)[1:] == (n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), best, sum(counts[x] for x in links), digest)


def test_alignment_equals_a_plain_loop(spark, plain_tokenizers):
    rnd = random.Random(5)
    alphabet = ["a", "b", " ", "  ", "\n", "é", "<s>", "▁", "'s", "9", "<|endoftext|>", "日", "🙂", "\t", " ", ".", "\x1c", "​"]
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(400)]
    texts = dict(enumerate(texts))
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in texts.items()], "doc_id long, text string, n_a int, `Link_Codes` int").repartition(3)
    check_alignment(plain_tokenizers, texts, alignment.alignment(df, A, B).collect())


def test_alignment_query_equals_a_plain_loop(spark, plain_tokenizers):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    check_alignment(plain_tokenizers, texts, queries.op11_alignment(spark, DATA).collect())


def test_alignment_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.alignment(none, A, B).count() == 0
    rows = alignment.alignment(spark.createDataFrame([(None, "a b"), ("x", "a b"), ("x", "a b"), ("y", None)], "id string, body string"), A, B, "id", "body").collect()
    assert sorted((r.id or "-", r.n_links, r.count_sum) for r in rows) == [("-", 2, 6), ("x", 2, 6), ("x", 2, 6), ("y", 0, 0)]
    groups = alignment.aligned(spark.createDataFrame([(1, "Hello world")], "doc_id int, text string"), A, B, with_groups=True).first().groups
    assert groups.count("|") == 2


def test_pair_sums_meet_salted(spark):
    one = np.array([5 << 32 | 7], "<u8").tobytes()
    links = spark.createDataFrame([(bytearray(one), bytearray(np.array([3], "<u8").tobytes()))] * 50, "link_codes binary, link_counts binary").repartition(20)
    assert [tuple(r) for r in alignment.pair_counts(links).collect()] == [(5 << 32 | 7, 150)]


def test_the_aligner_forgets(monkeypatch, plain_tokenizers):
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    tool = alignment.Aligner(A, B)
    for text in ("some words here", "other words there", "some words here"):
        counts, groups, _ = tool.align([text])
        assert groups == [plain_alignment(plain_tokenizers, text)[2]] and counts[0, 0] == plain_alignment(plain_tokenizers, text)[0]


RULES = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            fits = (
                True,
                kind == 1 and all(int(x) <= 255 for x in m.group().split(".")),
                13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0,
                9 <= len(digits) <= 15,
            )
            if fits[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_plain_rules():
    rnd, found = random.Random(3), 0
    parts = ["a@b.c", "@", "a.b", "1", "22", "333", " ", "-", ".", "+", "+1 (588) 555-1833", "4565410125667261", "4111111111111111", "1.2.3.4", "x", "é", "(", ")", "\n", "+49", "00", "9999999", "256.1.1.1", "0001.2.3.4"]
    for _ in range(20000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        want = plain_spans(text)
        found += len(want)
        assert personal.base_spans(text) == want, text
    assert found > 10000


@pytest.mark.parametrize("text", ["9" * 400_000, "a" * 400_000, "a@" * 200_000, "+1" + " " * 400_000, "1." * 200_000, "(9 " * 150_000, "1:" * 200_000, "<a " * 150_000])
def test_spans_of_long_runs_take_linear_time(text):
    personal.loose_spans(text, personal.base_spans(text))


def written(text, spans):
    return [(s.kind, text[s.start : s.end]) for s in spans]


def test_labelers_teach_loose_forms(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("aeiolnrst") for _ in range(rnd.randint(3, 8)))
    rows, loose = [], {}
    for i in range(600):
        strict = rnd.choice([f"{word()}.{i}@{word()}.com", f"+1 ({rnd.randint(200, 999)}) 555-{i:04}", f"10.{i % 200}.7.9", "4111 1111 1111 1111"])
        rows.append((i, f"{word()} {word()} {strict} {word()}"))
    for i in range(600, 640):
        span = f"({rnd.randint(200, 999)}) 555-{i:04}"
        rows.append((i, f"{word()} call our phone {span} {word()}"))
        loose[i] = span
    for i in range(640, 700):
        rows.append((i, f"{word()} order {rnd.randint(10**15, 10**16 - 1) // 10 * 10 + 1} {word()} on 2024-11-{i % 28 + 1:02} in {rnd.randint(10**7, 10**8)} of {rnd.randint(0, 9)}.{rnd.randint(0, 9)}"))
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    texts = dict(rows)
    got = {r.doc_id: r for r in personal.find_personal(docs).collect()}
    assert all([(s.kind, s.start, s.end) for s in got[i].base] == [(personal.KINDS[k], s, e) for k, s, e in plain_spans(t)] for i, t in rows)
    assert all(written(texts[i], got[i].added) == [("phone", span)] for i, span in loose.items())
    assert not any(got[i].added for i, _ in rows if i not in loose)


def test_reliabilities_of_planted_votes():
    rnd = np.random.default_rng(1)
    truth, right = rnd.random(6000) < 0.4, [0.95, 0.9, 0.85, 0.8, 0.75, 0.7]
    counts = np.zeros((4, personal.PATTERNS))
    votes = np.zeros(len(truth), np.int64)
    for i, share in enumerate(right):
        said = np.where(rnd.random(len(truth)) < share, truth, ~truth)
        votes += np.where(rnd.random(len(truth)) < 0.2, 1, 2 * said) * 3**i
    np.add.at(counts[1], votes, 1)
    told = personal.estimate(counts)
    assert np.abs(told.right[1] - right).max() < 0.03
    assert ((told.chance[1][votes] > 0.5) == truth).mean() > 0.96


def test_personal_odd_rows(spark):
    rows = [(1, None, "x"), (None, "", "x"), (2, "mail a@b.co", "x"), (2, "mail a@b.co", "x"), (3, "🙂 a@b.co, 1.2.3.4", None)]
    got = personal.personal_query(spark.createDataFrame(rows, "doc_id long, text string, `Spans` string")).collect()
    base = "email:2:8,ip:10:17"
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.spans) for r in got) == [(0, 0, 0, ""), (1, 0, 0, ""), (2, 1, 0, "email:5:11"), (2, 1, 0, "email:5:11"), (3, 1, 1, base)]
    assert [r.base_sha256 for r in got if r.doc_id == 3] == [hashlib.sha256(base.encode()).hexdigest()]
    assert personal.personal_query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_personal_query_equals_the_plain_rules(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op12_personal(spark, DATA).collect():
        base = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        shown = [f"{personal.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest() and set(shown) <= set(r.spans.split(",")) | {""}


def plain_divergence(rows, least, top):
    """The contract by plain loops: rows of (lang, source, text)."""
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    rows = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t or ""))) for a, b, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs = [r for r in rows if r[0] == lang]
        seen = collections.Counter(t for _, _, terms in docs for t in set(terms))
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        count = {s: collections.Counter(t for _, x, terms in docs if x == s for t in terms if seen[t] >= least) for s in {r[1] for r in docs}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), collections.Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in count:
            parts = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in count if o != s], "term": [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, i) for i, (item, v) in enumerate(found, 1) if part == "pair" or i <= top}
    return out


@pytest.mark.parametrize("cells", [1 << 22, 9])
def test_divergence_equals_plain_loops(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "PART", 50)
    rnd = random.Random(7)
    words = ["the", "The", "THE", "été", "Été", "zebra", "a1b", "ö", "z", "日本", "🙂", "x_y", "q", "𐐀"]
    rows = [(rnd.choice(["en", "de", None, "en"]), rnd.choice(["s1", "s2", "sé", None, "S3"]), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for _ in range(120)]
    rows += [("fr", "a", "rare"), ("fr", "b", None), ("fr", "b", None), ("it", "alone", ""), (None, None, None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, source string, text string, n int, `Term` string").repartition(3)
    got = divergence.divergence(df, least_docs=5, top=3)
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got.collect()} == plain_divergence(rows, 5, 3)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_shares_of_large_counts_are_exact():
    count, total = np.array([3 * 10**12 + 7, 9 * 10**15 - 1, 2]), np.array([9 * 10**15, 9 * 10**15, 9 * 10**15])
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * c // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]


def test_terms_of_a_long_text_count_one_document(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PART", 64)
    df = spark.createDataFrame([("en", "a", "word other " * 1000)], "lang string, source string, text string")
    assert {(r.term, r.n, r.docs) for r in divergence.term_counts(df).collect()} == {("word", 1000, 1), ("other", 1000, 1)}


def test_runs_meet_in_rounds_by_partition_number(spark):
    """64 partitions and a fan-in of 4: three exchanges, and a key never has more entries
    than the nodes that have not met yet."""
    assert [exact_dedup.rounds_of(n, 4) for n in (2, 4, 5, 16, 64, 65)] == [1, 1, 2, 2, 3, 4]
    rows = spark.range(0, 6400, 1, 64).select(F.col("id"), F.col("id").alias("row"), F.sha2((F.col("id") % 50).cast("string"), 256).alias("digest"), F.lit(2).cast("long").alias("bytes"), F.xxhash64(F.col("id") % 50).alias("second"), F.lit(1).cast("long").alias("n"))
    for keep, want in (("min", lambda k: k), ("max", lambda k: 6350 + k)):
        merged = exact_dedup.tree_merged(rows, keep, 64, 4)
        assert merged._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 3
        got = {r.id % 50: (r.id, r.n) for r in merged.collect()}
        assert got == {k: (want(k), 128) for k in range(50)}
