"""What parsers do once, and that it changes no result."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions import clues, lease
from quarry.functions import listing_text as T
from quarry.functions import pricing as P
from quarry.functions import vocabulary as V
from quarry.plans import texts
from quarry.sources.listing import each_once
from tests.oracle import DATA


def test_words_share_one_look_behind():
    assert V.any_of(("rent", "room", "аренд*", "phòng ngủ")).count("(?<!") == 1


def test_clauses_that_differ_in_numbers_are_searched_once(monkeypatch):
    pattern, calls = P.MONEY, []

    class Counting:
        def finditer(self, text):
            calls.append(text)
            return pattern.finditer(text)

    monkeypatch.setattr(P, "MONEY", Counting())
    got = [P.rent(f"Rent for flat no one saw: {n} USD per week")["amount"] for n in (111, 222, 345)]
    assert got == [111.0, 222.0, 345.0] and len(calls) == 1


def test_digits_of_units_still_count():
    assert P.rent("Price 100 USD/m2") is None and P.rent("Price 100 USD/m7")["amount"] == 100.0


def test_plain_search_misses_no_match(spark):
    words = ("id", "sk*", "мебел*", "phòng ngủ", "wi-fi", "сч[её]т*")
    texts = ["İD 5", "ſKy", "Kid, sKy", "МЕБЕЛЬЮ", "PHÒNG   NGỦ", "Wi-Fi", "Счёт", "grid", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    t = F.col("text")
    got = rows.select(*[T.has(t, (w,)).eqNullSafe(T.has(t, (w,), T.folded(t))) for w in words]).collect()
    assert all(all(r) for r in got)


def test_vietnamese_letters_are_ranges():
    assert len(T.LANGUAGE_SCRIPTS["vi"]) < len(T.VIETNAMESE) and T.LANGUAGE_SCRIPTS["vi"].count("Ạ-ỹ") == 1


def test_repeated_keys_are_worked_out_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        calls.add(1)
        return text and text.upper()

    rows = spark.createDataFrame([(i, ("a", "b", None)[i % 3]) for i in range(90)], "i int, text string")
    got = {(r.i, r.v) for r in each_once(rows, ["text"], "v", told("text")).collect()}
    assert got == {(i, ("A", "B", None)[i % 3]) for i in range(90)} and calls.value == 3
    rows = spark.createDataFrame([(str(i),) for i in range(90)], "text string")
    assert [r for r in each_once(rows, ["text"], "v", told("text")).collect() if r.v != r.text] == [] and calls.value == 93


def _counted(spark, calls, kind, value):
    @F.udf(kind)
    def told(text):
        calls.add(1)
        return value

    return told


def test_equal_posts_are_judged_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    told = _counted(spark, calls, "label string, reason string, eligible boolean", ("offer", "x", True))
    monkeypatch.setattr(T, "post_verdict", lambda text, *more: told(text))
    assert [r.n for r in texts.post_verdicts(spark, DATA).collect()] == [6000] and calls.value <= 24


def test_equal_texts_give_their_attributes_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    told = _counted(spark, calls, "int", 1)
    monkeypatch.setattr(T, "bedrooms", lambda text: told(text))
    assert {r.bedrooms for r in texts.attributes_roundtrip(spark, DATA).collect()} == {1} and calls.value <= 350


def test_equal_texts_give_their_amenities_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    told = _counted(spark, calls, "present array<string>, absent array<string>, shared array<string>", (["pool"], [], []))
    monkeypatch.setattr(T, "amenities", lambda text: told(text))
    assert {r.present for r in texts.amenity_lists(spark, DATA).collect()} == {"pool"} and calls.value <= 350


def test_documents_of_one_file_are_dealt_to_all_cores(spark):
    assert texts.document_language(spark, DATA).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_words_of_a_language_have_letters_of_its_script():
    for name, script in T.LANGUAGE_SCRIPTS.items():
        assert all(re.search(script, word) for word in V.LANGUAGES[name])


def test_null_has_no_language(spark):
    rows = spark.createDataFrame([(None,), ("",), ("Nhà, giá",), ("Аренда house price",)], "text string")
    assert [r[0] for r in rows.select(T.language(F.col("text"))["language"]).collect()] == [None, "unknown", "vi", "ru"]


def test_leases_that_differ_in_numbers_are_searched_once(monkeypatch):
    find, forms = lease._find, []
    monkeypatch.setattr(lease, "_places", lambda form: forms.append(form) or find(form))
    said = [None, *[f"Мин.: min stay {n} months; комиссия {n},5 %; rating 4.{n} ({n}07 reviews)" for n in range(1, 10)]]
    got = lease.terms_of(pa.array(said)[1:]).to_pylist()
    assert [tuple(r.values()) for r in got] == [(n, None, None, None, n + 0.5, 4 + n / 10, n * 100 + 7) for n in range(1, 10)]
    assert len(forms) == 1


def test_lease_terms_are_one_step_of_a_plan(spark):
    """Each text goes through its Arrow function once, however many terms are read."""
    plan = texts.lease_roundtrip(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and len(re.findall(r"terms\(", plan.split("ArrowEvalPython")[1].split("\n")[0])) == 1


def test_lines_that_differ_in_numbers_are_searched_once(monkeypatch):
    find, forms = clues._found, []
    monkeypatch.setattr(clues, "_found", lambda line: forms.append(line) or find(line))
    clues.clues_of(pa.array([f"Deposit that no one saw: {n}\n{n} pets, a house" for n in range(1, 10)]))
    assert forms == ["Deposit that no one saw: 0", "0 pets, a house"]


def test_clues_miss_no_words_and_change_no_result(spark):
    """Words on several lines, in other spellings, inside others, in part and in none."""
    said = ["For\nrent: no\npets", "sold\nout", "sold, not out", "ＰＥＴＳ welcome", "KITCHEN\nwi-fi", "hai\nphòng ngủ", "1 or 2\nbeds", "долларам", "x gps 12.5, 108.1", "water\nnot included", "", None, "Dài", "a flat, an apart­ment"]
    texts_ = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, text string")
    t = F.col("text")
    rows = texts_.withColumn("seen", clues.clues(t))
    both = lambda f: F.to_json(F.struct(f(t, seen=None))) == F.to_json(F.struct(f(t, seen=F.col("seen"))))
    named = [(words, T.has(t, words)) for words in clues._OF_WORDS]
    got = rows.select(
        "i", *[both(f) for f in (T.pets_allowed, T.utilities_included, T.amenities, T.utility_charges, T.bedrooms, T.beds_range, T.availability, T.language, T.location, T.contacts, T.coordinates, T.kind_of)],
        *[T.has(t, words, seen=F.col("seen")).eqNullSafe(found) for words, found in named], *[~found | clues.may(F.col("seen"), words) for words, found in named],
        (T.post_verdict(t)["reason"].eqNullSafe(T.post_verdict(t, seen=F.col("seen"))["reason"])),
    ).collect()
    assert [r.i for r in got if not all(x in (True, None) for x in list(r)[1:])] == []
    assert rows.where(~clues.may(F.col("seen"), clues.PHONE, clues.EMAIL)).count() == 13
