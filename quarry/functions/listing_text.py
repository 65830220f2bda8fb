"""Typed attributes out of listing texts in English, Russian, Vietnamese and Chinese.

Native expressions over the word tables of vocabulary.py; only rents, whose labels carry
from clause to clause, and terms of leases, whose many patterns are searched once for each
form of a text, go through the Arrow functions of pricing.py and lease.py. Where seen, the
clues of a text (see clues.py), is given, patterns are tried only where they can match.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import vocabulary as V
from quarry.functions.clues import COORDINATES, EMAIL, FURNISHED, PHONE, PIN, UNFURNISHED, clues, may, named, sure, told
from quarry.functions.lease import terms
from quarry.functions.pricing import rent_quote

#: Small letters that share their capital with another, such as the long s.
SAME_CAPITAL = {c: low for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) == 1 and len(low := c.upper().lower()) == 1 and low != c.lower()}
BEDROOM, BATHROOM, BED, GUEST, ROOM = (V.any_of(words) for words in (V.BEDROOMS, V.BATHROOMS, V.BEDS, V.GUESTS, V.ROOMS))
LANGUAGE_SCRIPTS, VIETNAMESE = V.LANGUAGE_SCRIPTS, V.VIETNAMESE
MONTHS, YEARS = V.any_of(V.MONTH), V.any_of(V.YEAR)
_LABEL = r"[ \t]*[:#-]?[ \t]*"


def let(value: Column, body) -> Column:
    """body(value), where value is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(text: Column) -> Column:
    """A text with letters as patterns with (?iu) compare them."""
    return F.lower(F.translate(text, "İ" + "".join(SAME_CAPITAL), "i" + "".join(SAME_CAPITAL.values())))


def contains_any(low: Column, parts: tuple[str, ...]) -> Column:
    """Whether a folded text has any of parts (in lower case), whatever stands around them."""
    return functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])


def may_have(low: Column, words: tuple[str, ...]) -> Column:
    """False where no pattern of words can match the text that low is folded from: a plain
    search, far cheaper than the pattern, that most texts fail for most words."""
    return contains_any(low, V.pieces(words))


def has(text: Column, words: tuple[str, ...], low: Column | None = None, seen: Column | None = None) -> Column:
    """low: the folded text, where many patterns are tried on one; or seen: its clues."""
    found = text.rlike("(?iu)" + V.any_of(words))
    if seen is not None:
        return named(seen, words, found)
    return found if low is None else may_have(low, words) & found


def _first(text: Column, *patterns: str) -> Column:
    """The first group of the first pattern that matches, else null."""
    return F.coalesce(*[let(F.regexp_extract(text, "(?iu)" + p, 1), lambda found: F.when(found != "", found)) for p in patterns])


def decimal(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def count_of(text: Column, label: str, digits: int = 2) -> Column:
    """A number on the label's line right before it, with or without a hyphen, or right
    after it; what is followed by a unit of area counts nothing."""
    n = rf"\d{{1,{digits}}}"
    before = rf"(?<![\d.,])({n})(?:[ \t]|-){{0,3}}{label.replace('(?<!' + chr(92) + 'p{L})', '')}"
    return _first(text, before, rf"{label}{_LABEL}({n})(?!\d|[ \t]*[mм][²2])").try_cast("int")


def digits_for_words(text: Column, counted: str, seen: Column | None = None) -> Column:
    """A text with small numbers in words as digits where they stand before what counted
    (a pattern) names."""
    said = lambda of, n: F.regexp_replace(of, rf"(?iu){V.any_of(V.NUMBER_WORDS[n])}(?=[\s-]+{counted})", str(n))
    every = F.when(text.rlike(rf"(?iu){V.any_of(V.NUMBERS)}[\s-]+{counted}"), functools.reduce(said, V.NUMBER_WORDS, text)).otherwise(text)
    if seen is None:
        return every
    # most texts have words of one number at most
    out = F.when(~may(seen, *V.NUMBER_WORDS.values()), text)
    for n in V.NUMBER_WORDS:
        out = out.when(~may(seen, *[words for m, words in V.NUMBER_WORDS.items() if m != n]), said(text, n))
    return out.otherwise(every)


def bedrooms(text: Column, seen: Column | None = None) -> Column:
    """The stated count, in digits or words; a studio has none."""
    counted = F.when(may(seen, V.BEDROOMS), let(digits_for_words(text, BEDROOM, seen), lambda said: count_of(said, BEDROOM)))
    return F.coalesce(counted, F.when(may(seen, V.STUDIO) & has(text, V.STUDIO), 0))


def beds_range(text: Column, seen: Column | None = None) -> Column:
    """Struct (min, max) of alternatives such as 1-2 beds, else null."""
    pattern = rf"(?iu)(?<!\d)(\d{{1,2}})\s*(?:or|или|hoặc|[-–])\s*(\d{{1,2}})\s*{BED}"
    def read(found: Column) -> Column:
        a, b = (F.regexp_extract(found, r"^(\d{1,2})\D+(\d{1,2})", i).try_cast("int") for i in (1, 2))
        return F.when(found != "", F.struct(F.least(a, b).alias("min"), F.greatest(a, b).alias("max")))

    # both numbers are read from the place that was found
    return let(F.when(may(seen, V.BEDS), F.regexp_extract(text, pattern, 0)), read)


def area(text: Column) -> Column:
    """Square metres."""
    return decimal(_first(text, r"(\d{1,4}(?:[.,]\d{1,2})?)\s?(?:[mм][²2]|кв\.?\s?м|sqm)"))


def floor(text: Column) -> Column:
    """The listing's floor; ranges and areas are none."""
    words = V.any_of(V.FLOOR_LABELS)
    return _first(text, rf"{words}{_LABEL}(\d{{1,2}})(?![\d-]|[ \t]*[mм][²2])", r"(?<![\d-])(\d{1,2})(?:st|nd|rd|th)?[ \t-]+(?:floor|этаж)(?!\p{L})").try_cast("int")


def stay_months(text: Column, words: tuple[str, ...] = V.LEAST) -> Column:
    """Months of the stay that words speak of; a year has twelve."""
    head = rf"{V.any_of(words)}\.?\s*(?:stay\s+)?[:]?\s*"
    return F.coalesce(_first(text, rf"{head}(\d{{1,3}})\s*{MONTHS}").try_cast("int"), _first(text, rf"{head}(\d{{1,2}})\s*{YEARS}").try_cast("int") * 12)


def deposit_money(text: Column, seen: Column | None = None) -> Column:
    """Struct (amount, currency) of a deposit that is stated as money, else null."""
    def said(clause: Column) -> Column:
        # the price parser knows amounts; a rent label stands in for that of the deposit
        quote = rent_quote(F.concat(F.lit("rent "), clause))
        return F.when(quote["amount"].isNotNull(), F.struct(quote["amount"].alias("amount"), quote["currency"].alias("currency")))

    behind = F.regexp_extract(text, rf"(?iu){V.any_of(V.DEPOSIT)}[ \t]*[:–—-]?[ \t]*([$€£₫]?\d[^\n;!?]*?)(?=[.;!?](?:\s|$)|\n|$)", 1)
    behind = F.when(may(seen, V.DEPOSIT), behind)
    return said(let(behind, lambda clause: F.when((clause != "") & ~clause.rlike(rf"(?iu)^\d{{1,2}}\s*{MONTHS}"), clause)))


def lease_terms(text: Column) -> Column:
    """Struct of months (least, most, deposit, prepayment), agency fee, rating, reviews. The
    term of a contract is its least stay; a deposit of a month's rent is one month."""
    return terms(text)


def pets_allowed(text: Column, seen: Column | None = None) -> Column:
    yes, no = (text.rlike("(?iu)" + V.phrases(parts)) for parts in (V.PETS_KEPT, V.PETS_BANNED))
    said = F.when(told(seen, V.PETS_BANNED, no), False).when(told(seen, V.PETS_KEPT, yes), True)
    return F.when(may(seen, V.PETS), said)


def furnished(text: Column, seen: Column | None = None) -> Column:
    return F.when(has(text, UNFURNISHED, seen=seen), False).when(has(text, FURNISHED, seen=seen), True)


def utilities_included(text: Column, seen: Column | None = None) -> Column:
    """False where they are paid apart or by meter, within one sentence."""
    yes, no = (text.rlike("(?iu)" + V.near(pairs)) for pairs in (V.UTILITIES_IN, V.UTILITIES_OUT))
    said = F.when(told(seen, V.UTILITIES_OUT, no), False).when(told(seen, V.UTILITIES_IN, yes), True)
    return F.when(may(seen, V.UTILITY_WORDS), said)


def availability(text: Column, seen: Column | None = None) -> Column:
    """A marker of what is gone outranks all others."""
    return F.when(has(text, V.GONE, seen=seen), "unavailable").when(has(text, V.OPEN, seen=seen), "available")


_ENGLISH_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def available_from(text: Column, published: Column, seen: Column | None = None) -> Column:
    """The one date after an availability word: ISO, day.month[.year] or with an English
    month's name. Two-digit years are of this century. Without a year it is the year of
    publication, or the next one if that lies before publication. Ranges, several dates
    and days that no calendar has give null."""
    word = rf"(?iu){V.any_of(V.FROM)}\s+"
    month_name = r"(?:" + "|".join(_ENGLISH_MONTHS) + r")[a-z]{0,6}"
    shapes = (r"\d{4}-\d{2}-\d{2}", r"\d{1,2}[./]\d{1,2}(?:[./](?:\d{4}|\d{2}))?", rf"\d{{1,2}}(?:st|nd|rd|th)?\s+{month_name}\.?(?:,?\s+\d{{4}})?", rf"{month_name}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?")
    any_date = rf"(?iu)(?<![\d./-])({'|'.join(shapes)})(?!\d|[./-]\d)"
    after = F.when(may(seen, V.FROM), F.regexp_extract(text, word + r"([^\n;]{1,60})", 1))
    ranges = lambda said: F.regexp_replace(said, r"\d{4}-\d{2}-\d{2}", "1.1.").rlike(r"(?iu)\d\s*(?:[-–—]|to|until|till|до|đến)\s*\d{1,2}[./\s]")
    only = lambda said: let(F.regexp_extract_all(said, F.lit(any_date), 1), lambda dates: F.when((F.size(dates) == 1) & ~ranges(said), F.lower(F.get(dates, F.lit(0)))))
    alone = let(after, lambda said: F.when(said != "", only(said)))
    return let(alone, lambda one: F.when(one.isNotNull(), _date_of(one, month_name, published)))


def _date_of(one: Column, month_name: str, published: Column) -> Column:
    number = lambda pattern: F.regexp_extract(one, pattern, 1).try_cast("int")
    by_name = let(F.array_position(F.lit(list(_ENGLISH_MONTHS)), F.regexp_extract(one, f"({'|'.join(_ENGLISH_MONTHS)})", 1)).cast("int"), lambda place: F.when(place > 0, place))
    day = F.coalesce(number(r"^(\d{1,2})(?!\d)"), number(r"^[a-z]+\.?\s+(\d{1,2})"))
    month = F.coalesce(by_name, number(r"^\d{1,2}[./](\d{1,2})"))
    year = F.coalesce(number(r"(\d{4})$"), number(r"^\d{1,2}[./]\d{1,2}[./](\d{2})$") + 2000)

    def dated(read: Column) -> Column:
        date = lambda y: F.try_to_date(F.format_string("%04d-%02d-%02d", y, read["month"], read["day"]), "yyyy-MM-dd")
        rolled = let(date(F.year(published)), lambda this: F.when(this.isNull() | (this < F.to_date(published)), date(F.year(published) + 1)).otherwise(this))
        return F.when(read["day"].isNotNull() & read["month"].isNotNull(), F.when(read["year"].isNotNull(), date(read["year"])).otherwise(rolled))

    parts = F.struct(day.alias("day"), month.alias("month"), year.alias("year"))
    return F.when(one.rlike(r"^\d{4}-"), F.try_to_date(F.regexp_extract(one, r"^(\d{4}-\d{2}-\d{2})$", 1), "yyyy-MM-dd")).otherwise(let(parts, dated))


def labeled_fields(text: Column) -> Column:
    """label: value and label - value within lines or between semicolons; a map of the
    label in lower case to all its values in order."""
    parts = F.filter(F.split(text, r"\r?\n|;"), lambda p: p.rlike(r":| [-–—] "))
    pattern = r"(?u)^[^\p{L}\p{N}]*([\p{L}\p{N}][^:\n]{0,59}?)(?::| [-–—] )(.*)$"
    found = F.filter(F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.regexp_extract(p, pattern, 1))).alias("k"), F.trim(F.regexp_extract(p, pattern, 2)).alias("v"))), lambda s: (s["k"] != "") & (s["v"] != ""))

    def by_label(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda s: s["k"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda s: s["k"] == k), lambda s: s["v"])))

    return let(found, by_label)


def contacts(text: Column, seen: Column | None = None) -> Column:
    """Struct of distinct e-mails in lower case, handles of 5 to 32 characters (with @ or
    as a link to a profile) and phones of 8 digits or more on lines that speak of contact."""
    found = lambda pattern, of=text: F.regexp_extract_all(of, F.lit(pattern), 1)
    none = F.array().cast("array<string>")
    emails = F.transform(F.when(may(seen, EMAIL) & F.contains(text, F.lit("@")), found(r"(?u)([\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[\p{L}\p{N}-]{1,63}\.){1,5}\p{L}{2,24})")).when(text.isNotNull(), none), F.lower)
    name = r"(\p{Alpha}\w{4,31})(?!\w)"
    where = lambda sign, pattern: F.when(F.contains(text, F.lit(sign)), found(pattern)).when(text.isNotNull(), none)
    handles = F.concat(where("@", rf"(?<![\w.\p{{L}}])@{name}"), where("://", rf"(?i)://(?:www\.)?t(?:elegram)?\.me/(?!joinchat|share/){name}"))
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: has(x, V.CONTACT_WORDS))
    lines = F.when(may(seen, V.CONTACT_WORDS) & may(seen, PHONE), lines).when(text.isNotNull(), none)
    numbers = F.flatten(F.transform(lines, lambda x: found(r"(?<![\d+])(\+?\d(?:[ ().-]{0,2}\d){7,15})(?!\d)", x)))
    phones = F.transform(numbers, lambda p: F.concat(F.when(p.startswith("+"), "+").otherwise(""), F.regexp_replace(p, r"\D", "")))
    return F.struct(F.array_distinct(emails).alias("email"), F.array_distinct(handles).alias("telegram"), F.array_distinct(phones).alias("phone"))


def language(text: Column, seen: Column | None = None) -> Column:
    """Struct of language and confidence: words and script of each, ties by name."""
    def score(name):
        words = F.regexp_count(text, F.lit("(?iu)" + V.any_of(V.LANGUAGES[name]))) if seen is None else seen[name].cast("int")
        if name in V.LANGUAGE_SCRIPTS:
            # each of its words has a letter of the script
            words = F.when(text.rlike(V.LANGUAGE_SCRIPTS[name]) if seen is None else sure(seen, name), words + 2).when(text.isNotNull(), 0)
        return words.alias(name)

    def best_of(scores: Column) -> Column:
        best = F.greatest(*[scores[n] for n in V.LANGUAGES])
        name = F.when(best == 0, "unknown")
        for n in sorted(V.LANGUAGES):
            name = name.when(scores[n] == best, n)
        total = sum((scores[n] for n in V.LANGUAGES), F.lit(0))
        return F.struct(name.alias("language"), F.coalesce(F.try_divide(best.cast("double"), total), F.lit(0.0)).alias("confidence"))

    return let(F.struct(*[score(n) for n in V.LANGUAGES]), best_of)


def parse_price(text: Column) -> Column:
    """Struct (amount, currency, period) of the rent, or null (see pricing.rent)."""
    quote = rent_quote(text)
    return F.when(quote["amount"].isNotNull(), F.struct(quote["amount"].alias("amount"), quote["currency"].alias("currency"), quote["period"].alias("period")))


def quote_basis(text: Column) -> Column:
    """What the rent is for: property, bedroom, room, bed or person; unknown if quotes of
    the same text differ. A quote that stands alone needs no rent label."""
    quote = rent_quote(text)
    bases = F.array_distinct(F.transform(quote["options"], lambda o: o["basis"]))
    return F.when(quote.isNull() | (F.size(bases) == 0), "property").when(F.size(bases) == 1, F.element_at(bases, 1)).otherwise("unknown")


def amenities(text: Column, seen: Column | None = None) -> Column:
    """Struct of sorted lists: present, absent (a negation stands right before it, or
    absent/unavailable after it) and shared. What is absent somewhere is not present."""
    return _amenities(text, seen=seen) if seen is not None else let(folded(text), lambda low: _amenities(text, low))


def _amenities(text: Column, low: Column | None = None, seen: Column | None = None) -> Column:
    no, shared = V.any_of(V.ABSENT), V.any_of(V.SHARED)
    tests = []
    for name, words in V.AMENITIES.items():
        word = V.any_of(words)
        gone = text.rlike(rf"(?iu){no}\s+{word}|{word}\s+(?:is\s+)?(?:absent|unavailable|нет)(?!\p{{L}})")
        together = rf"(?iu){shared}[^.;\n]{{0,40}}{word}|{word}[^.;\n]{{0,30}}{shared}"
        # mentions that are neither negated nor shared
        rest = F.regexp_replace(text, rf"{together}|{no}\s+{word}", " ")
        # the long tests are for texts that name the amenity at all
        tests.append(F.when(has(text, words, low, seen), F.struct(F.lit(name).alias("name"), (rest.rlike("(?iu)" + word) & ~gone).alias("present"), gone.alias("absent"), text.rlike(together).alias("shared"))))
    names = lambda rows, field: F.array_sort(F.transform(F.filter(rows, lambda r: F.coalesce(r[field], F.lit(False))), lambda r: r["name"]))
    return let(F.array_compact(F.array(*tests)), lambda rows: F.struct(*[names(rows, f).alias(f) for f in ("present", "absent", "shared")]))


def utility_charges(text: Column, seen: Column | None = None) -> Column:
    """Names of the charges that a text speaks of."""
    named = lambda low: F.array_compact(F.array(*[F.when(has(text, words, low, seen), name) for name, words in V.UTILITIES.items()]))
    return named(None) if seen is not None else let(folded(text), named)


def coordinates(text: Column, seen: Column | None = None) -> Column:
    """Struct (latitude, longitude) after a label, within the bounds of the globe."""
    head = r"(?iu)(?:gps|coordinates?|координат\p{L}*|tọa\s*độ)[ \t]*[:#-]?[ \t]*"
    pattern = head + r"(-?\d{1,2}(?:[.,]\d{1,8})?)\s*[,;]\s*(-?\d{1,3}(?:[.,]\d{1,8})?)"
    lat, lon = (decimal(F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))) for i in (1, 2))
    return F.when(may(seen, COORDINATES) & lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("latitude"), lon.alias("longitude")))


def time_after(text: Column, words: tuple[str, ...]) -> Column:
    """A time of day after one of words, such as that of check-in."""
    return _first(text, rf"{V.any_of(words)}{_LABEL}(\d{{1,2}}:\d{{2}})")


def property_id(text: Column, seen: Column | None = None) -> Column:
    """What stands behind a label for codes, or behind a label and one more word: letters,
    digits, - and _, with a digit among them or all in capitals."""
    label = rf"(?iu:{V.any_of(V.CODE_LABELS)})(?:[ ]\p{{Ll}}+(?=[ ]*[:#№]))?[ \t]*[:#№-]?[ \t]*"
    codes = F.when(may(seen, V.CODE_LABELS), F.regexp_extract_all(text, F.lit(label + r"([\p{L}\p{N}][\p{L}\p{N}_-]*)"), 1))
    return F.get(F.filter(codes, lambda c: c.rlike(r"\p{N}") | (c.rlike(r"..") & (c == F.upper(c)))), F.lit(0))


def kind_of(text: Column, scope: Column | None = None, seen: Column | None = None) -> Column:
    """The first of the kinds that a text names, by the order of the table, else the kind of
    all. scope: the part that describes the chosen home, which goes first if it names any;
    there a studio is a kind, too."""
    def first(names, otherwise: Column) -> Column:
        out = otherwise
        for name, words in reversed(list(V.KINDS.items())):
            out = F.when(names(words), name).otherwise(out)
        return out

    whole = first(lambda words: has(text, words, seen=seen), F.lit(V.ANY_KIND))
    within = lambda words: may(seen, words) & has(scope, words)
    return whole if scope is None else F.when(scope.isNull(), whole).when(within(V.STUDIO), "studio").otherwise(first(within, whole))


def cities_in(text: Column, seen: Column | None = None) -> Column:
    """Slugs of the cities that a text names."""
    return F.array_compact(F.array(*[F.when(may(seen, (*words, slug)) & (has(text, words) | F.contains(F.lower(text), F.lit(slug))), slug) for slug, words in V.CITIES.items()]))


def _elsewhere(text: Column, city: str) -> Column:
    """Cities are named, but not the given one."""
    return let(cities_in(text), lambda found: (F.size(found) > 0) & ~F.array_contains(found, city))


_BULLET = r"^[\s\p{So}]*[-•·▪◦‣–][ \t]*"
#: A place within reach is no place of the listing.
_DISTANCE = r"(?iu)≈|\d\s*(?:(?:min|мин)\p{L}*|phút|km|км|m|м)(?!\p{L})"


def location(text: Column, seen: Column | None = None) -> Column:
    """Struct of place and method: a labelled line, the bullets (two at most) under a label
    with nothing behind it, a pinned line, else the one city that is named."""
    label = rf"(?iu)^[^\p{{L}}]*{V.any_of(V.PLACE_LABELS)}[ \t]*:[ \t]*"
    sentence = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, label, ""), r"\.(?:\s.*)?$", ""))

    def bullets(below: Column) -> Column:
        # they end at the first line that is none
        upto = F.array_position(F.transform(below, lambda x: ~x.rlike(_BULLET)), F.lit(True)).cast("int")
        own = F.when(upto > 0, F.slice(below, 1, upto - 1)).otherwise(below)
        near = F.filter(F.transform(own, lambda x: F.trim(F.regexp_replace(x, _BULLET, ""))), lambda x: (x != "") & ~x.rlike(_DISTANCE))
        return F.nullif(F.array_join(F.slice(near, 1, 2), ", "), F.lit(""))

    def labelled(lines: Column) -> Column:
        marked = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("at"))), lambda m: F.contains(m["line"], F.lit(":")) & m["line"].rlike(label))
        return let(F.transform(marked, lambda m: F.struct(sentence(m["line"]).alias("rest"), m["at"].alias("at"))), lambda rows: placed(lines, rows))

    def placed(lines: Column, marked: Column) -> Column:
        # a further label with an amount behind it names no place
        direct = F.filter(marked, lambda m: (m["rest"] != "") & ~m["rest"].rlike(r"^[^:]*:[ \t]*(?:\p{Sc}|\d)"))
        bare = F.get(F.filter(marked, lambda m: m["rest"] == ""), F.lit(0))["at"]
        return F.struct(F.get(direct, F.lit(0))["rest"].alias("direct"), F.when(bare.isNotNull(), let(F.slice(lines, bare + 2, 8), bullets)).alias("listed"))

    # a label may also begin a sentence within a line
    apart = F.regexp_replace(text, rf"(?iu)(?<=[.!?])[ \t]+(?={V.any_of(V.PLACE_LABELS)}[ \t]*:)", "\n")
    parts = F.split(F.when(contains_any(text, tuple(mark + blank for mark in ".!?" for blank in " \t")), apart).otherwise(text), r"\r?\n")
    pinned = F.when(may(seen, PIN), F.nullif(F.trim(F.regexp_extract(text, r"(?m)^\s*📍\s*([^|\n]{1,120})", 1)), F.lit("")))
    alone = let(cities_in(text, seen), lambda city: F.when(F.size(city) == 1, F.element_at(city, 1)))
    by = F.when(has(text, V.PLACE_LABELS, seen=seen), let(parts, labelled))
    known = F.struct(by.alias("by"), pinned.alias("pinned"), alone.alias("city"))

    def chosen(k):
        method = F.when(k["by"]["direct"].isNotNull(), "labelled").when(k["by"]["listed"].isNotNull(), "bullets").when(k["pinned"].isNotNull(), "pinned").when(k["city"].isNotNull(), "city")
        return F.struct(F.coalesce(k["by"]["direct"], k["by"]["listed"], k["pinned"], k["city"]).alias("place"), method.alias("method"))

    return let(known, chosen)


# Labels, reasons and classes below are fixed values, as is the order of their tests.
def post_verdict(text: Column, city: str | None = None, duplicate: Column | None = None, seen: Column | None = None) -> Column:
    """Struct of label, reason and eligible, the first that fits of: duplicate, request,
    sale, service (the first three lines offer no rent), guides, another city than the
    given one, commercial, vehicles, offer, uncertain, unrelated."""
    if seen is not None:
        return _post_verdict(text, folded(text), city, duplicate, seen)
    return let(folded(text), lambda low: _post_verdict(text, low, city, duplicate))


def _post_verdict(text: Column, low: Column, city: str | None, duplicate: Column | None, seen: Column | None = None) -> Column:
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    head = F.array_join(F.slice(lines, 1, 3), "\n")
    names = lambda words: has(text, words, low, seen)
    renting, home, money = names(V.RENTING), names(V.PROPERTY), may(seen, V.MONEY) & contains_any(low, V.MONEY)
    # sentences on other places, or on what the channel offers besides, don't place the listing
    said = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+")))
    named = F.filter(said, lambda x: ~has(x, V.ELSEWHERE))
    place = F.coalesce(F.get(F.filter(named, lambda x: x.rlike(rf"(?iu){V.any_of(V.PLACE_LABELS)}\s*:")), F.lit(0)), F.array_join(named, "\n"))
    other = F.lit(False) if city is None else _elsewhere(place, city)
    cases = [
        (F.coalesce(duplicate, F.lit(False)) if duplicate is not None else F.lit(False), "duplicate", "stable-identity-already-seen"),
        (names(V.REQUEST), "request", "seeking-accommodation"),
        (names(V.SALE), "sale", "sale-intent"),
        (names(V.SERVICES) & ~has(head, V.RENTING), "service", "service-advertisement"),
        (names(V.GUIDE), "unrelated", "informational-market-content"),
        (other, "wrong-location", "explicit-other-city"),
        (names(V.COMMERCIAL), "commercial", "commercial-premises"),
        (~home & names(V.VEHICLES), "unrelated", "non-housing-rental"),
        (home & (renting | money | names(V.BOOKING)), "offer", "rental-evidence"),
        (home | money, "uncertain", "insufficient-rental-evidence"),
    ]
    out = F.struct(F.lit("unrelated").alias("label"), F.lit("no-accommodation-evidence").alias("reason"), F.lit(False).alias("eligible"))
    for test, label, reason in reversed(cases):
        out = F.when(test, F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"), F.lit(label == "offer").alias("eligible"))).otherwise(out)
    return out


def classify_post(text: Column) -> Column:
    return post_verdict(text)["label"]


def detail_status(text: Column, expires_at: Column, now: str) -> Column:
    """expired, rented, active or unknown, in this order of weight."""
    past = F.coalesce(expires_at <= F.lit(now).cast("timestamp_ntz"), F.lit(False))
    over, rented, active = ("listing expired", "listing has expired", "tin đã hết hạn", "tin đăng hết hạn", "объявление истекло"), ("already rented", "сдан", "сдана", "сдано", "đã thuê", "đã cho thuê", "đã có khách thuê"), ("available now", "available for rent", "listing active", "còn phòng", "còn trống", "đang cho thuê")
    return F.when(has(text, over) | past, "expired").when(has(text, rented), "rented").when(has(text, active), "active").otherwise("unknown")


def page_class(cards: Column, status: Column, title: Column, url: Column, city: str | None = None) -> Column:
    """What became of a fetched page, the first that fits."""
    context = F.concat_ws("\n", title, url)
    says = lambda *words: has(context, words)
    other = F.lit(False) if city is None else _elsewhere(context, city)
    return (
        F.when(status.isin(401, 403, 429) | says("captcha*", "cloudflare", "verify you*", "verify human", "access denied"), "challenge")
        .when(status == 202, "http-pending")
        .when(status >= 500, "http-server-error")
        .when(status >= 400, "http-client-error")
        .when((status < 200) | (status >= 300), "http-unresolved")
        .when(says("login", "log-in", "sign-in", "đăng-nhập"), "login")
        .when(says("consent", "cookie-settings", "privacy-choices", "quyền riêng tư"), "consent-wall")
        .when(says("mua-ban", "for-sale", "sale", "căn hộ bán", "bán nhà", "bán căn"), "sale")
        .when(other, "wrong-location")
        .when(cards > 0, "rental")
        .when(says("cho-thue", "for-rent", "rent", "rental", "аренд*"), "selector-drift")
        .when(says("search*", "results", "listing*"), "empty")
        .otherwise("landing")
    )


def audience(text: Column) -> Column:
    """Members from a short form such as 12.3K; commas and blanks are separators."""
    clean = F.regexp_replace(text, r"[\s,]", "")
    scale = F.upper(F.regexp_extract(clean, r"(?i)^\d+(?:\.\d+)?([KMB])", 1))
    times = F.when(scale == "K", 1e3).when(scale == "M", 1e6).when(scale == "B", 1e9).otherwise(1.0)
    return F.round(F.nullif(F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double") * times).cast("long")


def parse_listing(text: Column, published: Column) -> Column:
    """All attributes of a listing's text as one struct."""
    quote, seen = rent_quote(text), clues(text)
    # what the chosen rent is for; a text about one home describes it as a whole
    scope = quote["scope"]
    layout = F.coalesce(scope, text)
    counted = lambda words, pattern, digits=2: F.when(may(seen, words), count_of(text, pattern, digits))
    return F.struct(
        kind_of(text, scope, seen).alias("kind"), location(text, seen).alias("location"), language(text, seen).alias("language"), quote.alias("rent"),
        bedrooms(layout, seen).alias("bedrooms"), counted(V.BATHROOMS, BATHROOM).alias("bathrooms"), counted(V.BEDS, BED).alias("beds"), beds_range(text, seen).alias("beds_range"), counted(V.GUESTS, GUEST, 3).alias("guests"),
        area(text).alias("area"), F.when(may(seen, V.FLOOR_LABELS), floor(text)).alias("floor"), lease_terms(text).alias("lease"), deposit_money(text, seen).alias("deposit"), amenities(text, seen).alias("amenities"), utility_charges(text, seen).alias("utilities"),
        furnished(text, seen).alias("furnished"), pets_allowed(text, seen).alias("pets_allowed"), utilities_included(text, seen).alias("utilities_included"), availability(text, seen).alias("availability"), F.when(has(text, V.GONE, seen=seen), False).when(has(text, V.OPEN, seen=seen), True).alias("available_now"),
        available_from(text, published, seen).alias("available_from"), coordinates(text, seen).alias("coordinates"), property_id(text, seen).alias("property_id"), contacts(text, seen).alias("contacts"), labeled_fields(text).alias("labeled_fields"),
    )


def redact(text: Column) -> Column:
    """Masks e-mails, tokens and phone numbers; dates stay."""
    out = F.regexp_replace(text, r"[\p{L}\d._%+-]{1,64}@[\p{L}\d-]{1,63}(?:\.[\p{L}\d-]{1,63})+", "[email]")
    out = F.regexp_replace(out, r"(?i)(token|secret|password|api[_-]?key)(\s*[:=]\s*)\"?[^\s\"]+\"?", "$1$2[redacted]")
    return F.regexp_replace(out, r"(?<![\d-])\+?\d[\d ().]{7,18}\d(?![\d-])", "[phone]")


def segments(text: Column) -> Column:
    """Lines of a text: array of struct (n, offset, length, sha256); blank ones left out."""
    lines = F.split(text, r"\r?\n")
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("n"), F.length(x).alias("length"), F.sha2(x, 256).alias("sha256"), (F.trim(x) != "").alias("full"))), lambda s: s["full"])
