"""Prices and attributes of texts of many shapes; all texts are this library's own."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions import listing_text as T
from quarry.functions.pricing import rent

MILLION = 1_000_000
PRICES = [
    # a rent above other things that are rented out or charged
    ("✅ 640$ в месяц.\n✅ 30$ - Охрана дома\n🏍 Аренда байка от 120к/сутки 1,7млн/месяц", 640, None, "USD", "month"),
    ("➖ Доплата за питомца: 2.000.000 VND / месяц\n💰 СТОИМОСТЬ АРЕНДЫ:\n• 16.000.000 VND / месяц\n• ⚡ Электричество: 4.000 VND / кВт⋅ч\n📶 Wi-Fi — 200 000 VND", 16 * MILLION, None, "VND", "month"),
    ("Стоимость аренды: 17.000.000 VND/месяц\n📎 Дополнительные расходы:\n• Уборка: 500.000 VND/месяц\n• 250.000 VND/месяц", 17 * MILLION, None, "VND", "month"),
    ("Motorbike rental 2 million VND/month\nApartment 9 million VND/month", 9 * MILLION, None, "VND", "month"),
    ("Rent 500$, deposit 300$, 1 bedroom", 500, None, "USD", "month"),
    ("Rent 400$ + 50$ management", 400, None, "USD", "month"),
    # several rents of one home
    ("💰 СТОИМОСТЬ АРЕНДЫ:\n• 1–3 месяца: 18.000.000 VND / месяц\n• 6 месяцев: 15.000.000 VND / месяц", 15 * MILLION, 18 * MILLION, "VND", "month"),
    ("Giá: 8-10 triệu/tháng", 8 * MILLION, 10 * MILLION, "VND", "month"),
    ("Цена аренды:\n2 этаж — 7 млн/мес\n4 этаж — 6,5 млн/мес", 6.5 * MILLION, 7 * MILLION, "VND", "month"),
    ("Rent:\nfloor 3 - 9,000,000 VND/month\nfloor 5 - 8,250,000 VND/month", 8.25 * MILLION, 9 * MILLION, "VND", "month"),
    ("Giá thuê: tầng 1 11tr, tầng 2 9tr / tháng", 9 * MILLION, 11 * MILLION, "VND", "month"),
    ("Rent: level 4 – 14 triệu/tháng", 14 * MILLION, None, "VND", "month"),
    # what is no rent
    ("Квартира 55 m2, 9 этаж, Trần Phú 48", None, None, None, None),
    ("Giá 1500USD/m2", None, None, None, None),
    ("Ищу до 12 млн VND", None, None, None, None),
    # periods, currencies and ways to write
    ("Сутки: 25 $\nМесяц: 400 $", 400, None, "USD", "month"),
    ("✅ 60$ сутки\nот 2 суток", 60, None, "USD", "night"),
    ("• 1.900 USD / месяц", 1900, None, "USD", "month"),
    ("Цена 800 долларов в месяц", 800, None, "USD", "month"),
    ("Rent 380 euro per month", 380, None, "EUR", "month"),
    ("Giá 12tr5/tháng", 12.5 * MILLION, None, "VND", "month"),
    ("Аренда 4,5 тр в месяц", 4.5 * MILLION, None, "VND", "month"),
]


@pytest.mark.parametrize("text,low,high,currency,period", PRICES)
def test_prices(text, low, high, currency, period):
    got = rent(text)
    assert (got and (got["amount"], got["high"], got["currency"], got["period"])) == (low and (low, high, currency, period))


def test_a_number_that_may_go_on_is_no_price():
    assert rent("Rent\n12\n500 000 VND") == {"issues": ["ambiguous-wrapped-money-token"], "options": []}


SCOPES = [
    ("Studio 7 million VND/month, 2 bedroom apartment 12 million VND/month", "studio", 0),
    ("2 bedroom apartment 12 million VND/month\nVilla, 3 bedrooms 30 million VND/month", "apartment", 2),
    ("Villa\n3 bedrooms\n20 million VND/month\nStudio\n6 million VND/month", "studio", 0),
    ("1 bedroom: 9 million VND/month\n3 bedrooms: 8 million VND/month\nApartments", "apartment", 3),
    ("House, 2 bedrooms\nRent:\nfloor 1 - 9 million VND/month\nfloor 2 - 8 million VND/month", "house", 2),
    ("Apartment, 2 bedrooms\n6 months: 9 million VND/month\n12 months: 8 million VND/month", "apartment", 2),
]
FIELDS = [
    ("Сдаётся квартира с 2 спальнями.\nРайон: Север\nЦена: 13,5 млн VND / месяц\nДепозит: 1 месяц\nСвободно с 05/10/26\nКоммунальные платежи оплачиваются отдельно\nМожно с небольшими животными",
     {"kind": "apartment", "place": "Север", "amount": 13.5 * MILLION, "bedrooms": 2, "deposit_months": 1, "from": datetime.date(2026, 10, 5), "utilities": False, "pets": True}),
    ("Аренда квартиры, 3 спальни. Цена: 16 млн VND/месяц. Депозит: 20 млн VND. Контракт: 6 месяцев.", {"amount": 16 * MILLION, "bedrooms": 3, "deposit": 20 * MILLION, "deposit_months": None, "minimum": 6}),
    ("Сдаётся квартира с тремя спальнями. 450$ в месяц. Депозит в размере месячного платежа. Электричество и вода по счётчикам.", {"amount": 450, "bedrooms": 3, "deposit_months": 1, "utilities": False}),
    ("Сдаётся дом. Доступно с 27.9. Стоимость аренды: 19 млн донгов/месяц. 2 спальни, 2 санузла.", {"kind": "house", "from": datetime.date(2026, 9, 27), "bedrooms": 2, "bathrooms": 2}),
    ("For rent: new 1 bedroom, 2WC apartment. Price: 11.000.000 VND/month. Available now. Location: North side.", {"kind": "apartment", "place": "North side", "bedrooms": 1, "bathrooms": 2, "now": True}),
    ("Cho thuê biệt thự tại Nha Trang. Giá 40 triệu VND/tháng. 4 phòng ngủ. Đặt cọc 2 tháng. Khu vực: Vĩnh Hải.", {"kind": "villa", "place": "Vĩnh Hải", "amount": 40 * MILLION, "bedrooms": 4, "deposit_months": 2}),
    ("Apartment near Villa Park, Mui Ne", {"kind": "apartment", "place": "mui-ne"}),
    ("Hostel bed, 5$ / night", {"kind": "hostel"}),
    ("Quiet place by the sea, already rented", {"kind": "accommodation", "now": False, "pets": None}),
    ("Flat, ID: AB-12, dogs not allowed", {"code": "AB-12", "pets": False}),
]
VERDICTS = [
    ("Светлая студия в центре Дананга. Аренда 6 500 000 VND в месяц. Канал также публикует жильё в Нячанге.", "wrong-location"),
    ("Ищу квартиру в Нячанге до 12 млн VND, нужна одна спальня.", "request"), ("Bán căn hộ tại Nha Trang, giá 3 tỷ VND.", "sale"), ("Сдаётся квартира в Нячанге, 300$", "offer"), ("Ho Chi Minh apartment for rent, 500$", "wrong-location"),
]


LEASES = [
    (None, {}),
    ("", {}),
    ("Deposit: one month's rent", {"deposit_months": 1}),
    ("Залог 2 месяца, предоплата за 3 месяца, договор 1 год", {"deposit_months": 2, "prepayment_months": 3, "minimum_months": 12}),
    ("Contract 2 years, min. stay 5 months, tối đa 18 tháng", {"minimum_months": 5, "maximum_months": 18}),
    ("Contract 10 months or contract 2 years", {"minimum_months": 10}),
    ("COMMİSſION 7,25%, Rated 4.05 - 1234567 REVİEWS", {"agency_fee_percent": 7.25, "rating": 4.05, "reviews": 1234567}),
    # a digit, blank or letter that is none for the patterns, and words in longer words
    ("min stay ٣ months", {}),
    ("min stay\u00a03 months", {}),
    ("min stay 3 months²", {"minimum_months": 3}),
    ("xmin stay 3 months, deposited 4 months, rating 12345678 reviews", {"rating": 1.0}),
    ("12345678 reviews", {}),
    ("1.5 reviews", {}),
    ("Min stay 9 monthsé, max 0012 years, max 07 months", {"maximum_months": 7}),
    ("😀 Đặt cọc 𝟘 3 tháng", {"deposit_months": 3}),
]


def test_lease_terms(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LEASES)], "i int, t string")
    # bytes that are no UTF-8 move no number
    broken = spark.sql("SELECT -1 AS i, CAST(X'FFC3' AS STRING) || 'Deposit ' || CAST(X'D0' AS STRING) || ' 3 months' AS t")
    got = {r.i: {k: v for k, v in r.lease.asDict().items() if v is not None} for r in rows.union(broken).select("i", T.lease_terms(F.col("t")).alias("lease")).collect()}
    assert got == {-1: {"deposit_months": 3}, **{i: want for i, (_, want) in enumerate(LEASES)}}


def test_fields_layouts_and_verdicts(spark):
    texts = [t for t, *_ in (*SCOPES, *FIELDS, *VERDICTS)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("p", T.parse_listing(F.col("t"), F.lit("2026-09-22").cast("timestamp"))).withColumn("v", T.post_verdict(F.col("t"), "nha-trang"))
    got = {r.t: r for r in rows.collect()}
    for text, kind, bedrooms in SCOPES:
        assert (got[text].p.kind, got[text].p.bedrooms) == (kind, bedrooms), text
    for text, want in FIELDS:
        p = got[text].p
        found = {"kind": p.kind, "place": p.location.place, "amount": p.rent and p.rent.amount, "bedrooms": p.bedrooms, "bathrooms": p.bathrooms, "deposit_months": p.lease.deposit_months, "deposit": p.deposit and p.deposit.amount, "minimum": p.lease.minimum_months, "from": p.available_from, "now": p.available_now, "utilities": p.utilities_included, "pets": p.pets_allowed, "code": p.property_id}
        assert {k: found[k] for k in want} == want, text
    for text, label in VERDICTS:
        assert got[text].v.label == label, text
