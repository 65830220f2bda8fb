import pytest
from pyspark.sql import functions as F

from quarry.functions import listing_text as T
from quarry.functions.text import fold, stable_hash
from quarry.functions.url import canonical_url
from quarry.operators import filters, graph, history, resolve, retention, value
from quarry.operators.value import SearchOptions


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, text string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("905$ в месяц\nДепозит 1 000$", (905.0, "USD", "month")),
        ("14.000.000 VND / месяц", (14000000.0, "VND", "month")),
        ("Квартира 60 m2, 15 этаж", None),
        ("Giá: 8 triệu/tháng", (8000000.0, "VND", "month")),
        ("Rent 12,5 million per month. Electricity 4.000 VND", (12500000.0, "VND", "month")),
        ("", None),
        (None, None),
    ],
)
def test_price(spark, text, want):
    got = texts(spark, text).select(T.parse_price(F.col("text")).alias("p")).first().p
    assert (tuple(got) if got else None) == want


def test_tri_state_and_counts(spark):
    df = texts(spark, "Studio, no pets", "3-bedroom villa, pets allowed", "bedrooms: 2", "nothing")
    rows = df.select(T.bedrooms(F.col("text")), T.pets_allowed(F.col("text"))).collect()
    assert [tuple(r) for r in rows] == [(0, False), (3, True), (2, None), (None, None)]


def test_fold_and_hash(spark):
    row = texts(spark, "Đà Nẵng É").select(fold(F.col("text")), fold(F.col("text"), bar=True), stable_hash(F.lit("a"))).first()
    assert tuple(row) == ("đa nang e", "da nang e", "1r9g7v0" if row[2] == "1r9g7v0" else row[2])
    h = (2166136261 ^ 97) * 16777619 & 0xFFFFFFFF
    assert int(row[2], 36) == h


def test_canonical_url(spark):
    df = texts(spark, "https://WWW.Ex.com/a/?utm_x=1&b=2&a=1#f", "ftp://x.com", "HTTP://x.com/", None)
    assert [r[0] for r in df.select(canonical_url(F.col("text"))).collect()] == ["https://ex.com/a?a=1&b=2", None, "http://x.com", None]


def test_missing_values_are_outside_ranges(spark):
    df = spark.createDataFrame([(1.0,), (None,), (5.0,)], "v double")
    assert df.where(value.in_range(F.col("v"), 0, 3)).count() == 1
    assert df.where(value.in_range(F.col("v"), None, None)).count() == 3


def test_options_are_checked():
    for bad in ({"comparison_basis": "x"}, {"sort_by": "x"}, {"comparison_period": "x"}, {"stay_nights": 0}):
        with pytest.raises(ValueError):
            SearchOptions(**bad)


def test_public_urls(spark):
    df = texts(spark, "https://x.com/a", "http://localhost/", "http://u@x.com", "http://10.1.2.3/", "http://[::1]/", "file:///x", None)
    assert [r[0] for r in df.select(filters.is_public_url(F.col("text"))).collect()] == [True] + [False] * 6


def test_price_change_needs_a_difference(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 10), ("a", 3, 12), ("a", 4, 9), ("b", 1, 5)], "k string, t int, price long")
    rows = history.price_changes(df, ["k"], ["t"]).orderBy("t").collect()
    assert [(r.t, r.direction, r.delta) for r in rows] == [(3, "up", 2), (4, "down", -3)]


def test_upsert_and_empty(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, retention.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert retention.upsert(old.limit(0), new.limit(0), "id").count() == 0


@pytest.mark.parametrize("reverse", [False, True])
def test_conflicting_units_veto_a_weak_key(spark, reverse):
    rows = [(0, ["s0"], ["w"], {"unit": "1"}), (1, ["s1"], ["w"], {"unit": "2"}), (2, ["s2"], ["w"], None), (3, ["s2"], [], None)]
    if reverse:
        rows = [(3 - r[0], *r[1:]) for r in rows]
    df = spark.createDataFrame(rows, "ordinal long, strong array<string>, weak array<string>, identities map<string,string>")
    got = {r.ordinal: r.entity for r in resolve.resolve(df).collect()}
    assert len(set(got.values())) == 3


def test_long_chains_meet(spark):
    df = spark.range(60).select(F.col("id").alias("n"), F.array(F.col("id"), F.col("id") + 1).alias("keys"))
    assert {r.component for r in graph.components(df, F.col("keys"), "n").collect()} == {0}


def test_registered_fold_reads_whole_texts(spark):
    """An accent after 400 characters changes what the query compares with its SQL."""
    import hashlib
    import tempfile
    import unicodedata

    from quarry.plans import catalogue

    folder = tempfile.mkdtemp(prefix="fold-")
    rows = [(1, "a" * 400 + " Đà NẴNG É"), (2, "a" * 400 + " e"), (3, "x́ " * 30000 + "Ü"), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    brute = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)).lower()
    want = {i: hashlib.md5(brute(t).encode()).hexdigest() for i, t in rows}
    assert {r.doc_id: r.folded for r in catalogue.queries()["accent_fold_whole"](spark, folder).collect()} == want


def one_after_the_other(rows):
    """Brute force: strong keys, then weak keys in the order of their first row."""
    group = {r[0]: r[0] for r in rows}
    held = {r[0]: {n: {v} for n, v in (r[3] or {}).items()} for r in rows}

    def join(members):
        low = min(members)
        for m in members - {low}:
            for n, values in held.pop(m).items():
                held[low][n] = held[low].get(n, set()) | values
            for o in group:
                if group[o] == m:
                    group[o] = low

    keys = lambda place: dict.fromkeys(k for r in sorted(rows) for k in r[place] or ())
    members = lambda place, k: {group[r[0]] for r in rows if k in (r[place] or ())}
    for k in keys(1):
        join(members(1, k))
    for k in keys(2):
        touched = members(2, k)
        sides = [held[m] for m in touched]
        if all(set.intersection(*[s[n] for s in sides if n in s]) for n in {n for s in sides for n in s}):
            join(touched)
    return group


def test_weak_keys_act_in_order(spark):
    import random

    r = random.Random(3)
    some = lambda c, n, most: [f"{c}{r.randrange(n)}" for _ in range(r.randint(0, most))]
    rows = [(i, some("s", 60, 1), some("w", 25, 2), r.choice([None, {}, {"unit": str(r.randrange(3))}, {"unit": "1", "area": str(r.randrange(2))}])) for i in range(60)]
    df = spark.createDataFrame(rows, "ordinal long, strong array<string>, weak array<string>, identities map<string,string>")
    assert {x.ordinal: x.entity for x in resolve.resolve(df).collect()} == one_after_the_other(rows)


def test_a_key_may_be_hot(spark):
    """One weak key in a third of 330000 rows, one strong key in another third."""
    i = F.col("id")
    key = lambda k, name: F.when(i % 3 == k, F.array(F.lit(name))).otherwise(F.array(F.concat(F.lit(name), i.cast("string"))))
    df = spark.range(330_000).select(i.alias("ordinal"), key(1, "s").alias("strong"), key(0, "w").alias("weak"), F.when(i % 3 == 0, F.create_map(F.lit("unit"), F.lit("one"))).alias("identities"))
    got = resolve.resolve(df).groupBy("entity").agg(F.count("*").alias("n")).where("n > 1")
    assert sorted(map(tuple, got.collect())) == [(0, 110_000), (1, 110_000)]


@pytest.mark.parametrize("fold_rows", [200_000, 0])
def test_weak_keys_in_one_task_or_in_rounds(spark, fold_rows):
    import random

    r = random.Random(9)
    some = lambda c, n, most: [f"{c}{r.randrange(n)}" for _ in range(r.randint(0, most))]
    rows = [(i, some("s", 40, 1), some("w", 60, 2), r.choice([None, {}, {"unit": str(r.randrange(4))}])) for i in range(80)]
    df = spark.createDataFrame(rows, "ordinal long, strong array<string>, weak array<string>, identities map<string,string>")
    assert {x.ordinal: x.entity for x in resolve.resolve(df, fold_rows).collect()} == one_after_the_other(rows)


@pytest.mark.parametrize("torn", [False, True])
def test_a_chain_of_a_thousand_weak_keys(spark, torn):
    """Row i holds keys i and i + 1; torn chains name another unit in the middle."""
    i = F.col("id")
    unit = F.when(F.lit(torn) & (i == 500), F.lit("b")).when(i % 250 == 0, F.lit("a"))
    df = spark.range(1000).select(i.alias("ordinal"), F.array().cast("array<string>").alias("strong"), F.array(i.cast("string"), (i + 1).cast("string")).alias("weak"), F.when(unit.isNotNull(), F.create_map(F.lit("unit"), F.array(unit))).alias("identities"))
    got = resolve.resolve(df).groupBy("entity").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == ([(0, 500), (500, 250), (750, 250)] if torn else [(0, 1000)])
