"""Words of listings in four languages, and patterns made of them.

A trailing * stands for any ending, a blank for white space of any length, [x] for a
letter that may be missing or one of several."""

from __future__ import annotations

import unicodedata

# The names on the left are fixed values; which words stand for them is this library's own
# choice, by the rules that functions state.
LANGUAGES = {
    "en": ("apartment", "available", "bedroom", "contact", "deposit", "for rent", "house", "month", "price", "room"),
    "ru": ("аренд*", "квартир*", "комнат*", "спальн*", "цена*", "депозит*", "месяц*", "контакт*", "сда[её]т*"),
    "vi": ("cho thuê", "căn hộ", "phòng", "giá", "nhà", "tháng", "địa chỉ"),
}
PERIODS = {
    "night": ("night", "nights", "nightly", "day", "days", "daily", "ночь", "ночи", "ночей", "сутки", "день", "đêm", "ngày", "晚", "夜", "天"),
    "week": ("week", "weeks", "weekly", "недел*", "tuần", "周", "週"),
    "month": ("month", "months", "monthly", "месяц*", "мес", "tháng", "月"),
    "year": ("year", "years", "yearly", "annual", "annually", "год", "года", "лет", "năm", "年"),
}
SCALES = {
    1e3: ("k", "к", "тыс", "тысяч*", "nghìn", "ngàn", "thousand"),
    1e4: ("萬", "万"),
    1e6: ("m", "tr", "тр", "triệu", "million", "millions", "mln", "млн", "миллион*"),
    1e9: ("tỷ", "tỉ", "billion", "млрд"),
}
CURRENCIES = {
    "USD": ("us$", "$", "usd", "dollar", "dollars", "доллар*", "đô"),
    "EUR": ("€", "eur", "euro", "euros", "евро"),
    "GBP": ("£", "gbp"),
    "RUB": ("₽", "rub", "руб*"),
    "VND": ("₫", "vnd", "vnđ", "đ", "đồng", "донг*", "越盾"),
}
RENT = ("rent", "rental", "lease", "price", "monthly", "аренд*", "цена", "стоимост*", "giá thuê", "giá", "cho thuê", "租金")
FEE = (
    "deposit", "fee", "fees", "electric*", "water", "internet", "wifi", "wi-fi", "parking", "cleaning", "laundry", "management", "service", "security", "guard*", "maintenance", "commission", "agency", "utilities", "pet", "pets", "for sale",
    "депозит*", "залог*", "электр*", "свет", "вод[аыуе]", "газ", "мусор*", "интернет*", "вайфай", "вай-фай", "парков*", "уборк*", "стирк*", "комисси*", "коммунал*", "управлени*", "обслуживани*", "охран*", "услуг*", "питом*", "животн*", "продаж*",
    "đặt cọc", "cọc", "điện", "nước", "phí", "gửi xe", "giặt", "dọn", "giá bán", "押金",
)
#: What is rented out beside homes: a rent word next to it is no rent of a home.
BESIDES = ("bike", "bikes", "motorbike*", "scooter*", "car rental", "transfer", "байк*", "скутер*", "мотоцикл*", "авто", "автомобил*", "трансфер*", "xe máy", "thuê xe")
#: What comes on top of a rent, and headings of lists of such things.
EXTRA = ("surcharge", "extra charge*", "extra fee*", "extra cost*", "additional charge*", "additional fee*", "additional cost*", "other cost*", "доплат*", "надбавк*", "дополнительн*", "расход*", "phụ thu", "trả thêm", "cộng thêm", "chi phí khác", "phát sinh")
CEILING = ("up to", "at most", "under", "до", "не более", "не дороже", "tối đa", "đến", "dưới")
PLUS = ("+", "plus", "плюс", "cộng")
FLOOR = ("floor", "floors", "level", "levels", "этаж*", "tầng", "lầu")
#: Units that a charge is counted by; people and times may also be those of a rent.
METERED = ("kwh", "m2", "m²", "м2", "м²", "m3", "м3", "khối", "km", "km²", "số")
COUNTED = ("person", "people", "pax", "người", "человек*", "time", "lần", "раз")
BASES = {
    "bedroom": ("bedroom", "bedrooms", "phòng ngủ", "спальн*"),
    "room": ("room", "rooms", "phòng", "комнат*"),
    "bed": ("bed", "beds", "giường", "кроват*", "койк*"),
    "person": ("person", "persons", "pax", "người", "человек*"),
}
AMENITIES = {
    "air-conditioning": ("air condition*", "aircon", "кондиционер*", "điều hòa", "máy lạnh"),
    "balcony": ("balcony", "balconies", "балкон*", "ban công"),
    "elevator": ("elevator", "elevators", "lift", "лифт*", "thang máy"),
    "gym": ("gym", "тренаж*", "phòng tập"),
    "kitchen": ("kitchen*", "кухн*", "bếp"),
    "parking": ("parking", "парков*", "bãi đỗ", "chỗ đậu xe"),
    "pool": ("pool", "swimming pool", "бассейн*", "hồ bơi"),
    "sea-view": ("sea view", "ocean view", "вид на море", "view biển"),
    "washing-machine": ("washing machine", "washer", "стиральн*", "máy giặt"),
    "wifi": ("wifi", "wi-fi", "вайфай", "вай-фай"),
}
ABSENT = ("no", "without", "không", "không có", "без", "нет", "не имеется")
SHARED = ("shared", "communal", "общ*", "chung")
UTILITIES = {
    "management": ("management", "управлени*", "phí quản lý"),
    "internet": ("internet", "интернет*", "wifi", "wi-fi"),
    "electricity": ("electricity", "электрич*", "điện"),
    "water": ("water", "вод[ауы]", "nước"),
}
MONTH, YEAR = ("month", "months", "месяц*", "tháng"), ("year", "years", "год*", "năm")
LEAST = ("minimum", "min", "minimum stay", "min stay", "от", "tối thiểu")
MOST = ("maximum", "max", "maximum stay", "не более", "tối đa")
DEPOSIT = ("deposit", "депозит*", "залог*", "đặt cọc", "cọc")
PREPAID = ("prepay", "prepayment", "paid in advance", "предоплат*", "trả trước")
CONTRACT = ("contract", "lease term", "контракт*", "договор*", "hợp đồng")
#: Ways to say: as much as one month's rent.
A_MONTHS_RENT = ("one month rent", "one month's rent", "a month's rent", "month's payment", "месячн* платеж*", "месячн* оплат*", "месячн* аренд*", "một tháng tiền nhà", "месяц")
AGENCY, RATED, REVIEWS = ("agency fee", "commission", "комисси*", "phí môi giới"), ("rating", "rated", "рейтинг", "đánh giá"), ("review", "reviews", "отзыв*", "đánh giá")
GONE = (
    "sold out", "already rented", "already taken", "already booked", "now rented", "now taken", "now booked", "rented out", "no longer available",
    "сдан", "сдана", "сдано", "сданы", "hết phòng", "đã thuê", "đã cho thuê",
)
OPEN = ("available now", "свободн* сейчас", "доступн* сейчас", "có sẵn ngay")
REQUEST = ("looking for", "wanted", "need", "needed", "seeking", "ищу", "ищем", "сниму", "хочу снять", "хочу взять", "cần tìm", "cần thuê")
SALE = ("for sale", "selling", "sell", "продаю", "продам", "прода[её]тся", "продажа", "продажи", "bán căn", "bán nhà", "bán đất", "bán phòng", "sang nhượng", "出售", "买卖", "買賣")
SERVICE = ("visa", "visa service", "immigration service", "cleaning service", "moving service", "sim card", "sim-карт*", "currency exchange", "обмен валют*", "визов* услуг*", "визаран")
GUIDE = ("market guide", "market report", "rental price guide", "how to rent", "how to clean", "сколько стоит аренд*", "хватит сказок", "hướng dẫn thuê")
COMMERCIAL = ("mặt bằng", "cho thuê mặt bằng", "коммерческ* помещени*", "только для бизнеса", "office", "shop", "warehouse", "店面", "办公室", "辦公室")
VEHICLES = ("motorbike", "motorcycle", "scooter", "laptop", "bicycle", "мотоцикл*", "байк*", "скутер*", "велосипед*", "xe máy")
RENTING = ("for rent", "rent", "rental", "renting", "lease", "аренд*", "сда[её]т*", "сдам", "сдаю", "cho thuê", "thuê nhà", "thuê phòng", "thuê căn", "出租", "租金")
BOOKING = ("booking", "бронирован*", "đặt phòng")
PROPERTY = ("apartment*", "flat*", "studio", "room*", "house*", "villa*", "hotel*", "bedroom*", "căn hộ", "phòng", "nhà", "квартир*", "комнат*", "вилл*", "студи*", "спальн*", "дом", "公寓", "房")
#: In this order a text's kind is looked for; the names are fixed values, and so is their order.
KINDS = {
    "apartment": ("apartment*", "flat", "condo*", "квартир*", "апартамент*", "căn hộ", "公寓"),
    "villa": ("villa*", "вилл*", "biệt thự"),
    "hotel": ("hotel*", "отел*", "khách sạn"),
    "hostel": ("hostel*", "хостел*", "nhà nghỉ"),
    "room": ("room", "rooms", "комнат*", "phòng"),
    "house": ("house*", "townhouse*", "дом", "дома", "nhà"),
}
#: Fixed value: the kind of what names none.
ANY_KIND = "accommodation"
STUDIO = ("studio*", "студи*")
#: Cities by slug; the slugs are fixed values.
CITIES = {
    "da-nang": ("da nang", "danang", "đà nẵng", "дананг*"),
    "da-lat": ("da lat", "dalat", "đà lạt", "далат*"),
    "ha-noi": ("hanoi", "ha noi", "hà nội", "ханой", "ханое"),
    "ho-chi-minh": ("ho chi minh", "hồ chí minh", "saigon", "sài gòn", "хошимин*", "сайгон*"),
    "mui-ne": ("mui ne", "mũi né", "муйне", "муй не"),
    "nha-trang": ("nha trang", "nhatrang", "нячанг*"),
    "phu-quoc": ("phu quoc", "phú quốc", "фукуок*"),
}
PLACE_LABELS = ("location", "address", "area", "district", "локация", "адрес", "район", "местоположение", "địa chỉ", "vị trí", "khu vực", "quận")
#: Lines that speak of places without naming that of the listing.
ELSEWHERE = ("view of", "view to", "вид на", "trip to", "trips to", "transfer", "трансфер*", "поездк*", "экскурси*", "agency", "агентств*", "channel", "канал*", "kênh", "also publish*", "также публик*")
BEDROOMS, BATHROOMS = ("bedroom", "bedrooms", "br", "bhk", "pn", "спальн*", "phòng ngủ"), ("bathroom", "bathrooms", "wc", "сануз*", "phòng tắm")
BEDS, GUESTS, ROOMS = ("bed", "beds", "кроват*", "giường"), ("guest", "guests", "гост*", "khách"), ("room", "rooms", "комнат*", "phòng")
FLOOR_LABELS = ("floor", "этаж", "tầng", "lầu")
#: Small numbers in words, in front of what they count.
NUMBER_WORDS = {1: ("one", "одна", "одной", "одну", "một"), 2: ("two", "две", "двух", "двумя", "hai"), 3: ("three", "три", "тремя", "ba"), 4: ("four", "четыре", "четырьмя", "bốn"), 5: ("five", "пять", "пятью", "năm")}
NUMBERS = tuple(w for words in NUMBER_WORDS.values() for w in words)
PETS = ("pet", "pets", "cat*", "dog*", "animal*", "животн*", "питом*", "собак*", "кошк*", "thú cưng")
UTILITY_WORDS = ("utilities", "bills", "utility bills", "electric*", "water", "коммунал*", "электрич*", "điện nước", "điện")
APART = ("not included", "excluded", "extra", "separately", "by meter", "metered", "отдельно", "не включены", "не входят", "по счётчик*", "по счетчик*", "chưa bao gồm", "không bao gồm", "riêng")
INCLUDED, INCLUDING, EXCLUDING = ("included", "включены", "входят", "miễn phí"), ("including", "includes", "включая", "bao gồm", "bao"), ("excluding", "without", "plus", "chưa bao gồm", "không bao gồm")
#: What is said of pets and utilities: phrases of words, other words between them.
PETS_KEPT = ((PETS, ("allowed", "welcome", "ok", "accepted", "разреш*")), (("можно с", "можно со", "разреш*", "allow*", "welcome", "cho phép", "được nuôi"), PETS))
PETS_BANNED = ((("no", "without", "без", "нельзя с", "не", "không"), PETS), (PETS, ("not allowed", "not accepted", "forbidden", "запрещ*", "нельзя")), (PETS, ("not",), ("allowed", "welcome")))
#: Each phrase has one of these beside the word for a pet.
KEPT_WORDS, BANNED_WORDS = (tuple(w for phrase in parts for words in phrase if words is not PETS for w in words) for parts in (PETS_KEPT, PETS_BANNED))
UTILITIES_IN, UTILITIES_OUT = ((UTILITY_WORDS, INCLUDED), (INCLUDING, UTILITY_WORDS)), ((UTILITY_WORDS, APART), (EXCLUDING, UTILITY_WORDS))
#: Words before the day from which a home is free, and before codes.
FROM, CODE_LABELS = ("available from", "from", "свободн* с", "доступн* с", "освободится", "trống từ"), ("id", "код", "mã")
#: What tells that a text speaks of money.
MONEY = (*[w.removesuffix("*") for ws in CURRENCIES.values() for w in ws if len(w) > 1 or not w.isalpha()], "triệu", "million", "tỷ", "млн", "млрд", "price", "цена", "giá")
SERVICES = (*SERVICE, "cleaning of")
CONTACT_WORDS = ("contact*", "whatsapp", "phone", "tel", "контакт*", "телефон*", "liên hệ")


def any_of(words: tuple[str, ...], letter: str = r"\p{L}") -> str:
    """A pattern, without flags, of any of words, not inside a longer run of letters.
    Longer words come first. letter is the class of letters: the default is Java's.

    Words that begin with a letter share one look behind and are grouped by that letter, so
    that most places of a text cost one test, however many words there are."""
    initials: dict[str, list[str]] = {}
    others = []
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        stem = word.endswith("*")
        solid = all(not ("⺀" < c < "ꀀ") for c in word) and word[0].isalpha()
        body = _pattern(_parts(word.removesuffix("*")), letter)
        after = f"{letter}*" if stem else f"(?!{letter})" if solid and word[-1].isalnum() else ""
        if solid:
            initials.setdefault(_plain(word[0]), []).append(body[len(_plain(word[0])) :] + after)
        else:
            others.append(body + after)
    solids = [initial + (rests[0] if len(rests) == 1 else f"(?:{'|'.join(rests)})") for initial, rests in initials.items()]
    return "(?:" + "|".join(([f"(?<!{letter})(?:{'|'.join(solids)})"] if solids else []) + others) + ")"


def phrases(parts: tuple, letter: str = r"\p{L}") -> str:
    """A pattern of any of several phrases; one or two words may stand between their parts."""
    gap = rf"\s+(?:(?:{letter}|-)+\s+){{0,2}}"
    return "(?:" + "|".join(gap.join(any_of(words, letter) for words in phrase) for phrase in parts) + ")"


def near(pairs: tuple, letter: str = r"\p{L}") -> str:
    """A pattern of any of several pairs of words within one sentence."""
    return "(?:" + "|".join(rf"{any_of(a, letter)}[^.;\n]{{0,40}}{any_of(b, letter)}" for a, b in pairs) + ")"


def letters_of(letters: str) -> str:
    """A class of letters as ranges: a class of single ones tries one after the other."""
    codes = sorted(set(map(ord, letters)))
    first = [c for c in codes if c - 1 not in codes]
    last = [c for c in codes if c + 1 not in codes]
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(first, last, strict=True)) + "]"


def pieces(words: tuple[str, ...]) -> tuple[str, ...]:
    """Of each word the longest plain piece, in lower case: a text that any_of(words) matches
    has one of them. Those that contain another are left out."""
    longest = {max((p for p in _parts(w.removesuffix("*")) if p[0] not in "[* "), key=len).upper().lower() for w in words}
    return tuple(sorted(p for p in longest if not any(q != p and q in p for q in longest)))


def _pattern(parts: list[str], letter: str) -> str:
    return "".join(rf"{letter}*\s+" if part == "* " else r"\s+" if part == " " else part if part[0] == "[" else _plain(part) for part in parts)


def _parts(word: str) -> list[str]:
    """Plain pieces, blanks, inner endings and bracketed letters of a word, in order."""
    parts, rest = [], word
    while rest:
        if rest.startswith("* "):
            n = 2
        elif rest[0] == "[":
            n = rest.index("]") + 1
        elif rest[0] == " ":
            n = 1
        else:
            n = min([i for i in (rest.find(" "), rest.find("["), rest.find("* ")) if i > 0] or [len(rest)])
        parts.append(rest[:n])
        rest = rest[n:]
    return parts


def _plain(text: str) -> str:
    return "".join("\\" + c if c in r".$+*?()[]{}|^\-/" else c for c in text)


#: Vietnamese letters beside the plain ones: each vowel with each tone, and đ.
VIETNAMESE = "".join(sorted({unicodedata.normalize("NFC", v + tone) for v in "aăâeêioôơuưy" for tone in ("", "̀", "́", "̃", "̉", "̣")} - set("aeiouy"))) + "đ"
LANGUAGE_SCRIPTS = {"ru": "[А-ЯЁа-яё]", "vi": letters_of(VIETNAMESE + VIETNAMESE.upper())}
