"""Terms of a lease in free text: months of stay, deposit and prepayment, fee, rating, reviews.

No pattern tells one digit from another. So where the numbers stand is looked for once in each
form of a text (see pricing.by_form), and read there from the bytes of a whole batch at once.
"""

from __future__ import annotations

import functools
import operator
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quarry.functions import vocabulary as V
from quarry.functions.pricing import LETTER, ZEROS, by_form

TERMS_TYPE = StructType([
    *[StructField(n, IntegerType()) for n in ("minimum_months", "maximum_months", "deposit_months", "prepayment_months")],
    *[StructField(n, DoubleType()) for n in ("agency_fee_percent", "rating")],
    StructField("reviews", IntegerType()),
])
TERMS = [pa.field(f.name, pa.float64() if isinstance(f.dataType, DoubleType) else pa.int32()) for f in TERMS_TYPE]
ZERO_OF = np.frombuffer(bytes(range(256)).translate(ZEROS), np.uint8)


class _Letters(dict):
    """Code points as column expressions with (?iu) compare them: of letters that share a
    capital one stands for all. Blanks and digits that are none there count as other signs."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        capital = c.upper() if len(c.upper()) == 1 else c
        small = capital.lower() if len(capital.lower()) == 1 else capital
        other = (c.isalnum() and not c.isalpha() and not c.isascii()) or (c.isspace() and c not in " \t\n\v\f\r")
        self[code] = "\0" if other else "i" if c == "İ" else small
        return self[code]


LETTERS = _Letters()


class Rule(NamedTuple):
    """A number is the first group of a pattern, times as many. A text without any of pieces
    has no match. A pattern without a group stands for one."""

    pieces: tuple[str, ...]
    pattern: re.Pattern
    times: int = 1


class Place(NamedTuple):
    """Where a number stands in the bytes of a text, its decimals, and the number that times
    and plus make of it. Without width it is plus alone."""

    begin: int = 0
    width: int = 0
    decimals: int = 0
    times: int = 0
    plus: int = 0
    known: int = 1


NOWHERE = Place(known=0)
_LABEL, _SHARE = r"[ \t]*[:#-]?[ \t]*", r"\d{1,3}(?:[.,]\d{1,2})?"


def _any(words: tuple[str, ...]) -> str:
    return V.any_of(words, LETTER)


def _rule(words: tuple[str, ...], behind: str, times: int = 1) -> Rule:
    return Rule(V.pieces(words), re.compile(_any(words) + behind), times)


def _months(words: tuple[str, ...], between: str) -> list[Rule]:
    """Of months, else of years."""
    return [_rule(words, rf"{between}(\d{{1,3}})\s*{_any(V.MONTH)}"), _rule(words, rf"{between}(\d{{1,2}})\s*{_any(V.YEAR)}", 12)]


_STAY, _NEAR = r"\.?\s*(?:stay\s+)?[:]?\s*", rf"\D{{0,24}}?(\d{{1,3}})\s*{_any(V.MONTH)}"
#: Of each field, in order of weight.
RULES = (
    [*_months(V.LEAST, _STAY), *_months(V.CONTRACT, _LABEL)],
    _months(V.MOST, _STAY),
    [_rule(V.DEPOSIT, _NEAR), _rule(V.DEPOSIT, rf"[^.;\n\d]{{0,24}}{_any(V.A_MONTHS_RENT)}")],
    [_rule(V.PREPAID, _NEAR)],
    [_rule(V.AGENCY, rf"{_LABEL}({_SHARE})\s*%")],
    [_rule(V.RATED, rf"{_LABEL}(\d(?:[.,]\d{{1,2}})?)")],
    [Rule(V.pieces(V.REVIEWS), re.compile(rf"(?<![\d.,])(\d{{1,7}})\s*{_any(V.REVIEWS)}"))],
)

EVERY = [rule for rules in RULES for rule in rules]
#: The rules of each field with their bits.
NUMBERED = [[(rule, 1 << EVERY.index(rule)) for rule in rules] for rules in RULES]


@by_form
def _line(form: bytes) -> tuple[str, int]:
    """A line as patterns compare it, and a bit for each rule that it has a piece of."""
    # bytes that are no UTF-8 stay as many as they are
    low = form.decode("utf-8", "surrogateescape").translate(LETTERS)
    return low, sum(1 << i for i, rule in enumerate(EVERY) if any(p in low for p in rule.pieces))


def _find(form: bytes) -> tuple[Place, ...]:
    """The place of each field's number in texts of a form."""
    lines = [_line(x) for x in form.split(b"\n")]
    held = functools.reduce(operator.or_, [bits for _, bits in lines])
    low = "\n".join([line for line, _ in lines]) if held else ""
    return tuple(_first(form, low, [rule for rule, bit in rules if held & bit]) for rules in NUMBERED)


def _first(form: bytes, low: str, rules: list[Rule]) -> Place:
    for rule in rules:
        m = rule.pattern.search(low)
        if m and not m.re.groups:
            return Place(plus=rule.times)
        if m:
            begin = len(form.decode("utf-8", "surrogateescape")[: m.start(1)].encode("utf-8", "surrogateescape"))
            return Place(begin, len(m[1]), len(re.sub(r"^\d+\D?", "", m[1])), rule.times)
    return NOWHERE


_places = by_form(_find)


def terms_of(texts: pa.Array) -> pa.Array:
    """The terms of each text of a batch; those of null are null."""
    texts = texts.cast(pa.large_binary())
    valid, ends, data = texts.buffers()
    chars = np.append(np.frombuffer(data or b"", np.uint8), np.uint8(0))
    starts = np.frombuffer(ends or bytes(8), np.int64)[texts.offset : texts.offset + len(texts)]
    forms = pa.Array.from_buffers(pa.large_binary(), len(texts), [valid, ends, pa.py_buffer(ZERO_OF[chars])], offset=texts.offset).dictionary_encode()
    places = np.array([*[_places(form) for form in forms.dictionary.to_pylist()], (NOWHERE,) * len(TERMS)])
    of = forms.indices.fill_null(len(forms.dictionary)).to_numpy()
    return pa.StructArray.from_arrays([_numbers(chars, starts, places[of, i], field) for i, field in enumerate(TERMS)], fields=TERMS)


def _numbers(chars: np.ndarray, starts: np.ndarray, places: np.ndarray, field: pa.Field) -> pa.Array:
    begin, width, decimals, times, plus, known = places.T
    at, value = starts + begin, np.zeros(len(starts), np.int64)
    for k in range(width.max(initial=0)):
        digit = chars[np.minimum(at + k, len(chars) - 1)] - np.uint8(ord("0"))
        value = np.where((k < width) & (digit < 10), value * 10 + digit, value)
    value = value * times + plus
    # both are whole, so the quotient is the number that is nearest to the decimal
    return pa.array(value / 10.0**decimals if pa.types.is_floating(field.type) else value, field.type, mask=known == 0)


@F.arrow_udf(TERMS_TYPE)
def terms(texts: pa.Array) -> pa.Array:
    return terms_of(texts)
