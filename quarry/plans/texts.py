"""Queries over texts: parsers are checked against the columns that texts are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import listing_text as T
from quarry.functions import text as X
from quarry.functions import url as U
from quarry.sources.listing import each_once, spread, table


def lines(spark, sf_dir):
    """Keys and numbers of the line items, dealt to all cores: each row's text is parsed."""
    return spread(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), F.floor("l_extendedprice").alias("p"), F.to_date("l_shipdate").alias("d"))


def price_roundtrip(spark, sf_dir):
    rows = lines(spark, sf_dir)
    kinds = (
        F.concat(F.lit("Rent: "), F.format_number("p", 0), F.lit(" USD per month. Deposit 900 USD")),
        F.concat(F.lit("Giá: "), F.col("q"), F.lit(" triệu/tháng; phí 200000 VND")),
        F.concat(F.lit("Цена "), F.col("p"), F.lit(" € за неделю\nЗалог 100 €")),
        F.concat(F.lit("Villa 60 m2, "), F.col("p"), F.lit("$ / night")),
        F.concat(F.lit("Apartment 60 m2, floor 5, quiet")),
    )
    text = F.element_at(F.array(*kinds), (F.col("l_orderkey") % 5 + 1).cast("int"))
    price = F.col("price")
    return rows.withColumn("price", T.parse_price(text)).select("l_orderkey", "l_linenumber", price["amount"].alias("amount"), price["currency"].alias("currency"), price["period"].alias("period"))


def attributes_roundtrip(spark, sf_dir):
    rows = lines(spark, sf_dir)
    n = F.col("q") % 9 + 1
    text = F.concat_ws("\n", F.concat(F.lit("House with "), n, F.lit("-bedroom wing")), F.concat(F.lit("bathrooms: "), F.col("l_linenumber")), F.concat(F.lit("area "), F.col("q"), F.lit(",5 m²")), F.concat(F.lit("Floor: "), F.col("q") % 30 + 1), F.concat(F.lit("minimum stay "), F.col("l_linenumber"), F.when(n > 5, " years").otherwise(" months")), F.when(n > 6, "no pets please").when(n > 3, "pets allowed"), F.when(n > 4, "fully furnished").otherwise("unfurnished"), F.when(n > 8, "SOLD OUT!").when(n > 2, "available now"))
    t = F.col("text")
    said = F.struct(T.bedrooms(t).alias("bedrooms"), T.count_of(t, T.BATHROOM).alias("bathrooms"), T.area(t).alias("area"), T.floor(t).alias("floor"), T.stay_months(t).alias("stay"), T.pets_allowed(t).alias("pets"), T.furnished(t).alias("furnished"), T.availability(t).alias("availability"))
    return each_once(rows.select("l_orderkey", "l_linenumber", text.alias("text")), ["text"], "said", said).select("l_orderkey", "l_linenumber", "said.*")


def availability_date(spark, sf_dir):
    rows = lines(spark, sf_dir)
    d = F.col("d")
    kinds = (F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "d.M.yyyy"), F.date_format(d, "dd/MM/yy"), F.date_format(d, "dd.MM"))
    text = F.concat(F.lit("Flat available from "), F.element_at(F.array(*kinds), (F.col("l_orderkey") % 4 + 1).cast("int")))
    return rows.select("l_orderkey", "l_linenumber", T.available_from(text, F.date_sub(d, 100)).alias("available"))


def labeled_fields(spark, sf_dir):
    rows = lines(spark, sf_dir)
    text = F.concat(F.lit("* Size: "), F.col("q"), F.lit("; Owner - s"), F.col("l_suppkey"), F.lit("\nno label here\nSIZE: big"))
    m = F.col("m")
    return rows.withColumn("text", text).withColumn("m", T.labeled_fields(F.col("text"))).select("l_orderkey", "l_linenumber", F.concat_ws("|", F.try_element_at(m, F.lit("size"))).alias("size"), F.concat_ws("|", F.try_element_at(m, F.lit("owner"))).alias("owner"), F.size(m).cast("long").alias("n"))


def contacts_extract(spark, sf_dir):
    rows = lines(spark, sf_dir)
    text = F.concat(F.lit("write to Own"), F.col("l_suppkey"), F.lit("@Mail.example.com or @user_"), F.col("l_orderkey"), F.lit("\ncontact +84 90"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"), F.lit("\narea 123456789012"))
    c = T.contacts(F.col("text"))
    return rows.withColumn("text", text).select("l_orderkey", "l_linenumber", *[F.concat_ws(",", c[k]).alias(k) for k in ("email", "telegram", "phone")])


def language_detect(spark, sf_dir):
    rows = lines(spark, sf_dir)
    kinds = ("Apartment for rent, price per month", "Сдаётся квартира, цена за месяц", "Cho thuê căn hộ, giá tháng", "lorem ipsum")
    text = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return rows.withColumn("text", text).groupBy(T.language(F.col("text"))["language"].alias("language")).agg(F.count("*").alias("n"))


def document_language(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", T.language(F.col("text"))["language"].alias("language"))


def classify_posts(spark, sf_dir):
    rows = lines(spark, sf_dir)
    kinds = ("Looking for an apartment to rent", "House for sale, price 100", "Cleaning of apartments, price 10", "Office for rent, price 5", "Сдаётся квартира, цена 10 млн", "Hello world", "Cho thuê căn hộ, giá 8 triệu")
    text = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("l_orderkey") % 7 + 1).cast("int"))
    return rows.groupBy(T.classify_post(text).alias("label")).agg(F.count("*").alias("n"))


def listing_clauses(spark, sf_dir):
    """Texts of independent clauses in any number and order, in one of three languages; what
    each clause states stands in columns of its own."""
    l, n, q, k = F.col("l_orderkey"), F.col("l_linenumber"), F.col("q"), F.col("l_partkey")
    lang = l % 3
    say = lambda en, ru, vi: F.when(lang == 0, F.concat(*en)).when(lang == 1, F.concat(*ru)).otherwise(F.concat(*vi))
    t = lambda *parts: [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    month = (l % 11 + 1).cast("int")
    clauses = [
        (F.lit(True), say(t("For rent: apartment"), t("Сдаётся квартира"), t("Cho thuê căn hộ"))),
        (n % 2 == 0, say(t("Rent ", q + 5, " million VND/month"), t("Стоимость аренды: ", q + 5, " млн VND в месяц"), t("Giá thuê ", q + 5, " triệu/tháng"))),
        (n % 3 == 0, say(t("Deposit ", n % 4 + 1, " months"), t("Депозит: ", n % 4 + 1, " месяца"), t("Đặt cọc ", n % 4 + 1, " tháng"))),
        (n % 3 == 1, say(t("Deposit: ", q, " million VND"), t("Залог ", q, " млн VND"), t("Cọc ", q, " triệu VND"))),
        (k % 2 == 0, say(t(k % 4 + 1, " bedrooms"), t("Есть ", k % 4 + 1, " спальни"), t(k % 4 + 1, " phòng ngủ"))),
        (k % 2 == 1, say(t("with two bedrooms"), t("с двумя спальнями"), t("hai phòng ngủ"))),
        (k % 3 == 0, say(t("Contract: ", n + 5, " months"), t("Контракт: ", n + 5, " месяцев"), t("Hợp đồng ", n + 5, " tháng"))),
        (k % 5 < 2, F.when(k % 5 == 0, say(t("Small pets are welcome"), t("Можно с небольшими животными"), t("Được nuôi thú cưng"))).otherwise(say(t("No pets please"), t("Без животных"), t("Không nuôi thú cưng")))),
        (k % 7 < 3, F.when(k % 7 == 0, say(t("Utilities are included"), t("Коммунальные включены"), t("Bao gồm điện nước"))).otherwise(say(t("Electricity and water by meter"), t("Коммунальные платежи оплачиваются отдельно"), t("Điện nước riêng")))),
        (k % 4 == 1, say(t("Available from 2027-0", month % 9 + 1, "-15"), t("Доступно с 15.0", month % 9 + 1, ".2027"), t("Trống từ 15/0", month % 9 + 1, "/2027"))),
        (k % 4 == 3, say(t("Motorbike rental ", n, " million VND/month"), t("Аренда байка ", n, " млн VND в месяц"), t("Thuê xe máy ", n, " triệu/tháng"))),
        (q % 2 == 0, say(t("Location: Block ", q), t("Район: Block ", q), t("Khu vực: Block ", q))),
        (q % 3 == 0, say(t("Internet: 200000 VND"), t("Интернет: 200000 VND"), t("Internet: 200000 VND"))),
    ]
    marked = F.array(*[F.when(test, F.struct(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.lit(i))).alias("k"), clause.alias("c"))) for i, (test, clause) in enumerate(clauses)])
    # the order of clauses differs from row to row; they end as sentences or lines
    said = F.transform(F.array_sort(F.array_compact(marked)), lambda x: x["c"])
    text = F.when(l % 2 == 0, F.array_join(said, ".\n")).otherwise(F.array_join(said, "\n"))
    rows = lines(spark, sf_dir).withColumn("text", text).withColumn("p", T.parse_listing(F.col("text"), F.lit("2026-06-01").cast("timestamp_ntz")))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("p.kind").alias("kind"), F.col("p.rent.amount").alias("amount"), F.col("p.lease.deposit_months").alias("deposit_months"), F.col("p.deposit.amount").alias("deposit"), F.col("p.bedrooms").alias("bedrooms"),
        F.col("p.lease.minimum_months").alias("minimum_months"), F.col("p.pets_allowed").alias("pets"), F.col("p.utilities_included").alias("utilities"), F.col("p.available_from").alias("available_from"), F.col("p.location.place").alias("place"),
    )


def quote_bases(spark, sf_dir):
    rows = lines(spark, sf_dir)
    kinds = ("5 million / month", "100$ per room", "50$ per bed", "20$ per person", "30$ за комнату, 10$ per bed", "9$/bedroom")
    text = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("l_orderkey") % 6 + 1).cast("int"))
    return rows.groupBy(T.quote_basis(text).alias("basis")).agg(F.count("*").alias("n"))


def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url"))


def message_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    url = F.concat(F.lit("https://t.me/"), F.when(F.col("user_id") % 2 == 0, "s/").otherwise(""), F.lit("Channel_"), F.col("user_id"), F.lit("/"), F.col("event_id"), F.when(F.col("event_id") % 3 == 0, "?single").when(F.col("event_id") % 3 == 1, "/x").otherwise(""))
    return rows.select("event_id", U.message_url(url).alias("message"))


def accent_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


def accent_fold_whole(spark, sf_dir):
    """The name that whole texts had while accent_fold read a prefix; both stay."""
    return accent_fold(spark, sf_dir)


def stable_hash(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_name", X.fnv1a(F.col("r_name")).alias("hash"), X.stable_hash(F.lit("")).alias("empty"))


def trace_redact(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    text = F.concat(F.lit("user u"), F.col("user_id"), F.lit("@x.example.com token="), F.col("event_id"), F.lit("abc on 2024-01-05"))
    return rows.select("event_id", T.redact(text).alias("text"))


def segment_ledger(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.inline(T.segments(F.col("text"))))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("length").alias("chars"), F.max("sha256").alias("last_sha"))


def rent_ranges(spark, sf_dir):
    """Headings, ranges, carried labels, ceilings, surcharges and meters around a rent."""
    rows = lines(spark, sf_dir)
    q, p = F.col("q"), F.col("p")
    kinds = (
        F.concat(F.lit("Fees:\ncleaning "), p, F.lit(" USD\nRent:\n"), q, F.lit("-"), q + 3, F.lit(" triệu / tháng")),
        F.concat(F.lit("Аренда "), p, F.lit("–"), p + 50, F.lit(" $ за комнату в месяц, депозит 1 000 $")),
        F.concat(F.lit("Điện 4k/kwh, nước 100k/người. Giá thuê: "), q, F.lit(",5 triệu/tháng")),
        F.concat(F.lit("Floor 3-"), q + 100, F.lit(" 000 VND per night, up to 9 million")),
        F.concat(F.lit("Price: "), p, F.lit("€ per week + 70 € cleaning; yearly contract")),
        F.concat(F.lit("Deposit: two months\nQuiet house, lift, "), q, F.lit(" m2")),
    )
    quote = F.col("quote")
    rows = rows.withColumn("text", F.element_at(F.array(*kinds), (F.col("l_orderkey") % 6 + 1).cast("int"))).withColumn("quote", T.rent_quote(F.col("text")))
    return rows.select("l_orderkey", "l_linenumber", *[quote[c].alias(c) for c in ("amount", "high", "currency", "period", "basis")])


def quote_issues(spark, sf_dir):
    rows = lines(spark, sf_dir)
    kinds = (
        F.concat(F.lit("Rent: "), F.col("q") + 100, F.lit(" VND per month or "), F.col("q") + 100, F.lit(" million a month")),
        F.concat(F.lit("Rent: "), F.col("q") + 100, F.lit(" VND per month")),
        F.concat(F.lit("Price\n 3\n"), F.col("q"), F.lit("00 000 VND")),
        F.concat(F.lit("Price "), F.col("p"), F.lit(" USD")),
    )
    quote = T.rent_quote(F.element_at(F.array(*kinds), (F.col("l_orderkey") % 4 + 1).cast("int")))
    return rows.withColumn("quote", quote).groupBy(F.concat_ws(",", "quote.issues").alias("issues")).agg(F.count("*").alias("n"))


def lease_roundtrip(spark, sf_dir):
    rows = lines(spark, sf_dir)
    n, q = F.col("l_linenumber"), F.col("q")
    english = F.concat(F.lit("Min. stay "), n, F.lit(" months, maximum: "), n + 12, F.lit(" months\nDeposit is "), n, F.lit(" months\nPrepayment of "), n + 1, F.lit(" months\nAgency fee: "), q, F.lit(",5%\nRating: 4."), n, F.lit(" ("), F.col("l_partkey"), F.lit(" reviews)"))
    russian = F.concat(F.lit("От "), n, F.lit(" года, не более "), n + 12, F.lit(" месяцев\nДепозит: "), n, F.lit(" месяца\nПредоплата за "), n + 1, F.lit(" месяца\nКомиссия "), q, F.lit(",5 %\nРейтинг 4,"), n, F.lit(", "), F.col("l_partkey"), F.lit(" отзывов"))
    rows = rows.withColumn("text", F.when(F.col("l_orderkey") % 2 == 0, english).otherwise(russian))
    return rows.select("l_orderkey", "l_linenumber", T.lease_terms(F.col("text")).alias("t")).select("l_orderkey", "l_linenumber", "t.*")


def amenity_lists(spark, sf_dir):
    rows = lines(spark, sf_dir)
    n = F.col("l_linenumber")
    text = F.concat_ws(". ", F.when(n % 2 == 0, "Big swimming pool").otherwise("No pool"), F.when(n % 3 == 0, "shared kitchen").otherwise("Кухня"), F.when(F.col("q") % 2 == 0, "ban công rộng"), F.when(F.col("q") % 5 == 0, "без лифта, Wi-Fi").otherwise("wifi"), F.when(n > 5, "washing machine unavailable"))
    return each_once(rows.select("l_orderkey", "l_linenumber", text.alias("text")), ["text"], "a", T.amenities(F.col("text"))).select("l_orderkey", "l_linenumber", *[F.concat_ws(",", f"a.{c}").alias(c) for c in ("present", "absent", "shared")])


def place_chain(spark, sf_dir):
    """Labels, bullets below an empty label, pins, a single city; distances and amounts are none."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    kinds = (
        F.concat(F.lit("Villa\nAddress: "), F.col("s_name"), F.lit(" street\n📍 elsewhere")),
        F.concat(F.lit("Локация:\n• 5 минут до моря\n• "), F.col("s_name"), F.lit("\n- block "), F.col("s_nationkey"), F.lit("\nend\n• no")),
        F.concat(F.lit("Nice flat\n📍 "), F.col("s_name"), F.lit(" | near the sea\nLocation: Deposit: $300")),
        F.lit("Сдаётся квартира в городе Дананг"),
        F.lit("From Mui Ne to Da Nang"),
        F.lit("no place"),
    )
    place = T.location(F.element_at(F.array(*kinds), (F.col("s_suppkey") % 6 + 1).cast("int")))
    return rows.select("s_suppkey", place["place"].alias("place"), place["method"].alias("method"))


def post_verdicts(spark, sf_dir):
    """All labels of the classifier, by reason."""
    rows = lines(spark, sf_dir)
    kinds = (
        "Căn hộ dịch vụ cho thuê, 9 triệu", "Хочу снять студию у моря", "Продаётся дом, 5 млрд", "Visa service and tickets", "Rent a flat\nfrom owner, 500 USD\nsea view\ncurrency exchange too",
        "Market report on apartments", "Apartment in Da Nang, 300$", "Cho thuê mặt bằng 50tr", "Scooter for rent, 5$", "Quiet studio, 2nd floor", "Nice weather", "Villa, transfer to Hanoi, 900 USD",
    )
    text = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("l_orderkey") % 12 + 1).cast("int"))
    rows = each_once(rows.select(text.alias("text"), (F.col("l_linenumber") == 7).alias("again")), ["text", "again"], "v", T.post_verdict(F.col("text"), "nha-trang", F.col("again")))
    return rows.groupBy(F.col("v.label").alias("label"), F.col("v.reason").alias("reason"), F.col("v.eligible").alias("eligible")).agg(F.count("*").alias("n"))


def page_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    pick = lambda column, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))
    status, cards = pick("l_linenumber", 200, 429, 202, 503, 404, 302, 200), F.col("l_quantity") % 3
    title = pick("l_orderkey", "Apartments for rent in Mui Ne", "Please login", "Cookie-settings", "House for-sale", "Search results", "Welcome", "Attention required: Cloudflare", "Rooms in Nha Trang and Mui Ne")
    return rows.groupBy(T.page_class(cards, status, title, F.lit("https://x.example/"), "nha-trang").alias("class")).agg(F.count("*").alias("n"))


def audience_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    text = F.when(n % 4 == 0, F.concat(n, F.lit(".5K members"))).when(n % 4 == 1, F.concat(F.lit("1,"), F.lpad((n % 1000).cast("string"), 3, "0"))).when(n % 4 == 2, F.concat(n, F.lit(" M"))).otherwise("members only")
    return rows.select("c_custkey", T.audience(text).alias("audience"))


def coordinate_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    lat, lon = F.col("o_orderkey") % 120, F.col("o_custkey") % 250
    text = F.concat(F.lit("Sea side. GPS: "), F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise(""), lat, F.lit(".25, "), lon, F.lit(".5\nMã căn: A"), F.col("o_orderkey"), F.lit(", check-in: 14:00"))
    c = T.coordinates(text)
    return rows.select("o_orderkey", c["latitude"].alias("latitude"), c["longitude"].alias("longitude"), T.property_id(text).alias("code"), T.time_after(text, ("check-in",)).alias("check_in"))


def listing_parse(spark, sf_dir):
    """The whole parser at once over one text with everything in it."""
    rows = lines(spark, sf_dir)
    q, n = F.col("q"), F.col("l_linenumber")
    text = F.concat(F.lit("Villa for rent, "), q, F.lit(" m2, "), n, F.lit(" bedrooms, 2-3 beds, 1 WC\nRent: "), q, F.lit(" triệu / tháng; deposit 2 months\nLocation: Hue, block "), n, F.lit("\nAvailable from 5 March 2031\nutilities included, water and internet, no pets\nContact: @owner_"), F.col("l_suppkey"))
    a = rows.withColumn("text", text).withColumn("a", T.parse_listing(F.col("text"), F.lit("2030-01-01").cast("timestamp")))
    return a.select("l_orderkey", "l_linenumber", "a.kind", F.col("a.location.place").alias("place"), F.col("a.rent.amount").alias("amount"), "a.bedrooms", "a.bathrooms", F.col("a.beds_range.min").alias("beds_min"), F.col("a.beds_range.max").alias("beds_max"), "a.area", F.col("a.lease.deposit_months").alias("deposit_months"), "a.available_from", "a.utilities_included", "a.pets_allowed", F.concat_ws(",", "a.utilities").alias("utilities"), F.concat_ws(",", "a.contacts.telegram").alias("telegram"), F.col("a.language.language").alias("language"))


L = "SELECT l_orderkey, l_linenumber, "
LINES = "FROM (SELECT *, l_quantity::INT AS q, floor(l_extendedprice)::BIGINT AS p, l_shipdate::DATE AS d FROM lineitem)"
PICK = lambda column, names, n: f"SELECT [{', '.join(repr(x) for x in names)}][l_orderkey % {n} + 1] AS {column}, count(*) AS n FROM lineitem GROUP BY 1"
SQL = {
    "price_roundtrip": L + f"CASE l_orderkey % 5 WHEN 1 THEN q * 1000000.0 WHEN 4 THEN NULL ELSE p END::DOUBLE AS amount, ['USD', 'VND', 'EUR', 'USD', NULL][l_orderkey % 5 + 1] AS currency, ['month', 'month', 'week', 'night', NULL][l_orderkey % 5 + 1] AS period {LINES}",
    "attributes_roundtrip": L + f"q % 9 + 1 AS bedrooms, l_linenumber::INT AS bathrooms, q + 0.5::DOUBLE AS area, q % 30 + 1 AS floor, l_linenumber * CASE WHEN q % 9 + 1 > 5 THEN 12 ELSE 1 END AS stay, CASE WHEN q % 9 + 1 > 6 THEN false WHEN q % 9 + 1 > 3 THEN true END AS pets, q % 9 + 1 > 4 AS furnished, CASE WHEN q % 9 + 1 > 8 THEN 'unavailable' WHEN q % 9 + 1 > 2 THEN 'available' END AS availability {LINES}",
    "availability_date": L + f"CASE WHEN l_orderkey % 4 = 2 AND year(d) < 2000 THEN (d + INTERVAL 100 YEAR)::DATE ELSE d END AS available {LINES}",
    "labeled_fields": L + f"q || '|big' AS size, 's' || l_suppkey AS owner, 2::BIGINT AS n {LINES}",
    "contacts_extract": L + f"'own' || l_suppkey || '@mail.example.com' AS email, 'user_' || l_orderkey AS telegram, '+8490' || lpad(l_partkey::VARCHAR, 7, '0') AS phone {LINES}",
    "language_detect": PICK("language", ("en", "ru", "vi", "unknown"), 4),
    "document_language": r"""WITH s AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(?:apartment|available|bedroom|contact|deposit|for\s+rent|house|month|price|room)\b')) AS en,
      CASE WHEN regexp_matches(text, '(?i)[àáâãèéêìíòóôõùúýăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]') THEN 2 ELSE 0 END AS vi FROM documents)
      SELECT doc_id, CASE WHEN en = 0 AND vi = 0 THEN 'unknown' WHEN en >= vi THEN 'en' ELSE 'vi' END AS language FROM s""",
    "classify_posts": "SELECT label, sum(n)::BIGINT AS n FROM (" + PICK("label", ("request", "sale", "service", "commercial", "offer", "unrelated", "offer"), 7) + ") GROUP BY 1",
    "listing_clauses": """WITH l AS (SELECT *, l_quantity::INT AS q FROM lineitem)
      SELECT l_orderkey, l_linenumber, l_partkey, 'apartment' AS kind, CASE WHEN l_linenumber % 2 = 0 THEN (q + 5) * 1000000::DOUBLE END AS amount, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber % 4 + 1 END AS deposit_months, CASE WHEN l_linenumber % 3 = 1 THEN q * 1000000::DOUBLE END AS deposit,
        CASE WHEN l_partkey % 2 = 0 THEN l_partkey % 4 + 1 ELSE 2 END AS bedrooms, CASE WHEN l_partkey % 3 = 0 THEN l_linenumber + 5 END AS minimum_months, CASE l_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS pets, CASE l_partkey % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS utilities,
        CASE WHEN l_partkey % 4 = 1 THEN make_date(2027, (l_orderkey % 11 + 1) % 9 + 1, 15) END AS available_from, CASE WHEN q % 2 = 0 THEN 'Block ' || q END AS place FROM l""",
    "quote_bases": PICK("basis", ("property", "room", "bed", "person", "unknown", "bedroom"), 6),
    "url_canonical": r"""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme,
      regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages),
      q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND NOT list_contains(['fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'referrer', 'source'], string_split(x, '=')[1]))), '&') AS kept FROM p)
      SELECT page_id, scheme || '://' || host || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url FROM q""",
    "message_urls": "SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN 'channel_' || user_id || '/' || event_id END AS message FROM events",
    "accent_fold": "SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents",
    "accent_fold_whole": "SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents",
    "stable_hash": "SELECT r_name, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(r_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS hash, 'ztntfp' AS empty FROM region",
    "trace_redact": "SELECT event_id, 'user [email] token=[redacted] on 2024-01-05' AS text FROM events",
    "segment_ledger": r"SELECT doc_id, count(*) AS lines, sum(length(x))::BIGINT AS chars, max(sha256(x)) AS last_sha FROM (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS x FROM documents) WHERE trim(x, ' ') <> '' GROUP BY 1",
    "rent_ranges": L + f"""CASE l_orderkey % 6 WHEN 0 THEN q * 1e6 WHEN 1 THEN p WHEN 2 THEN (q + 0.5) * 1e6 WHEN 3 THEN (q + 100) * 1000 WHEN 4 THEN p END::DOUBLE AS amount, CASE l_orderkey % 6 WHEN 0 THEN (q + 3) * 1e6 WHEN 1 THEN p + 50 END::DOUBLE AS high,
      ['VND', 'USD', 'VND', 'VND', 'EUR', NULL][l_orderkey % 6 + 1] AS currency, ['month', 'month', 'month', 'night', 'week', NULL][l_orderkey % 6 + 1] AS period, ['property', 'room', 'property', 'property', 'property', NULL][l_orderkey % 6 + 1] AS basis {LINES}""",
    "quote_issues": "SELECT ['implausible-literal-monthly-VND,contradictory-rent-scales', 'implausible-literal-monthly-VND', 'ambiguous-wrapped-money-token', ''][l_orderkey % 4 + 1] AS issues, count(*) AS n FROM lineitem GROUP BY 1",
    "lease_roundtrip": L + f"CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber ELSE l_linenumber * 12 END::INT AS minimum_months, l_linenumber::INT + 12 AS maximum_months, l_linenumber::INT AS deposit_months, l_linenumber::INT + 1 AS prepayment_months, q + 0.5::DOUBLE AS agency_fee_percent, 4 + l_linenumber / 10::DOUBLE AS rating, l_partkey::INT AS reviews {LINES}",
    "amenity_lists": L + f"""concat_ws(',', CASE WHEN q % 2 = 0 THEN 'balcony' END, CASE WHEN l_linenumber % 3 <> 0 THEN 'kitchen' END, CASE WHEN l_linenumber % 2 = 0 THEN 'pool' END, 'wifi') AS present,
      concat_ws(',', CASE WHEN q % 5 = 0 THEN 'elevator' END, CASE WHEN l_linenumber % 2 = 1 THEN 'pool' END, CASE WHEN l_linenumber > 5 THEN 'washing-machine' END) AS absent, CASE WHEN l_linenumber % 3 = 0 THEN 'kitchen' ELSE '' END AS shared {LINES}""",
    "place_chain": "SELECT s_suppkey, [s_name || ' street', s_name || ', block ' || s_nationkey, s_name, 'da-nang', NULL, NULL][s_suppkey % 6 + 1] AS place, ['labelled', 'bullets', 'pinned', 'city', NULL, NULL][s_suppkey % 6 + 1] AS method FROM supplier",
    "post_verdicts": """WITH r AS (SELECT CASE WHEN l_linenumber = 7 THEN 'duplicate|stable-identity-already-seen' ELSE ['offer|rental-evidence', 'request|seeking-accommodation', 'sale|sale-intent', 'service|service-advertisement', 'offer|rental-evidence', 'unrelated|informational-market-content',
      'wrong-location|explicit-other-city', 'commercial|commercial-premises', 'unrelated|non-housing-rental', 'uncertain|insufficient-rental-evidence', 'unrelated|no-accommodation-evidence', 'offer|rental-evidence'][l_orderkey % 12 + 1] END AS v FROM lineitem)
      SELECT split_part(v, '|', 1) AS label, split_part(v, '|', 2) AS reason, v = 'offer|rental-evidence' AS eligible, count(*) AS n FROM r GROUP BY ALL""",
    "page_classes": """SELECT CASE WHEN l_linenumber % 7 = 1 OR l_orderkey % 8 = 6 THEN 'challenge' WHEN l_linenumber % 7 = 2 THEN 'http-pending' WHEN l_linenumber % 7 = 3 THEN 'http-server-error' WHEN l_linenumber % 7 = 4 THEN 'http-client-error' WHEN l_linenumber % 7 = 5 THEN 'http-unresolved'
      WHEN l_orderkey % 8 = 1 THEN 'login' WHEN l_orderkey % 8 = 2 THEN 'consent-wall' WHEN l_orderkey % 8 = 3 THEN 'sale' WHEN l_orderkey % 8 = 0 THEN 'wrong-location' WHEN l_quantity::INT % 3 > 0 THEN 'rental' WHEN l_orderkey % 8 = 4 THEN 'empty' ELSE 'landing' END AS class, count(*) AS n FROM lineitem GROUP BY 1""",
    "audience_counts": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey * 1000 + 500 WHEN 1 THEN 1000 + c_custkey % 1000 WHEN 2 THEN c_custkey * 1000000 END::BIGINT AS audience FROM customer",
    "coordinate_pairs": """WITH r AS (SELECT *, (o_orderkey % 120 + 0.25) * CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END AS lat, o_custkey % 250 + 0.5 AS lon FROM orders), k AS (SELECT *, o_orderkey % 120 < 100 AND abs(lat) <= 90 AND lon <= 180 AS ok FROM r)
      SELECT o_orderkey, CASE WHEN ok THEN lat END::DOUBLE AS latitude, CASE WHEN ok THEN lon END::DOUBLE AS longitude, 'A' || o_orderkey AS code, '14:00' AS check_in FROM k""",
    "listing_parse": L + f"""'villa' AS kind, 'Hue, block ' || l_linenumber AS place, q * 1000000::DOUBLE AS amount, l_linenumber::INT AS bedrooms, 1 AS bathrooms, 2 AS beds_min, 3 AS beds_max, q::DOUBLE AS area, 2 AS deposit_months, DATE '2031-03-05' AS available_from, true AS utilities_included,
      false AS pets_allowed, 'internet,water' AS utilities, 'owner_' || l_suppkey AS telegram, 'en' AS language {LINES}""",
}
QUERIES = {f.__name__: f for f in (listing_clauses, rent_ranges, quote_issues, lease_roundtrip, amenity_lists, place_chain, post_verdicts, page_classes, audience_counts, coordinate_pairs, listing_parse, price_roundtrip, attributes_roundtrip, availability_date, labeled_fields, contacts_extract, language_detect, document_language, classify_posts, quote_bases, url_canonical, message_urls, accent_fold, accent_fold_whole, stable_hash, trace_redact, segment_ledger)}
