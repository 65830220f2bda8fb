"""Which groups of words a text may have, so that patterns are tried only where they can match.

What a line holds is looked for once in each form of a line (see pricing.by_form). Words that
stand in one line are sure; of those of several parts, which may lie on several lines, a clue
says that all parts are there, and the pattern has the last word.
"""

from __future__ import annotations

import functools
import operator
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.functions import vocabulary as V
from quarry.functions.lease import LETTERS
from quarry.functions.pricing import FORMS, LETTER, ZEROS, by_form

FURNISHED, UNFURNISHED = ("furnished", "с мебел*", "đầy đủ nội thất", "full nội thất"), ("unfurnished", "not furnished", "без мебел*", "không nội thất")
COORDINATES = ("gps", "coordinate*", "координат*", "tọa*")
#: Signs that are no words: what an e-mail, a phone and a pinned line have.
EMAIL, PHONE, PIN = "email", "phone", "pin"
_SIGNS = {EMAIL: re.compile(r"\S@\S+\."), PHONE: re.compile(r"[0-9](?:[ ().-]{0,2}[0-9]){7}"), PIN: re.compile("\U0001f4cd")}
_GROUPS = [
    V.BEDROOMS, V.BATHROOMS, V.BEDS, V.GUESTS, V.FLOOR_LABELS, *V.NUMBER_WORDS.values(), V.STUDIO, *V.KINDS.values(), V.PLACE_LABELS, *[(*words, slug) for slug, words in V.CITIES.items()], *V.LANGUAGES.values(), *V.AMENITIES.values(), *V.UTILITIES.values(),
    FURNISHED, UNFURNISHED, V.PETS, V.UTILITY_WORDS, V.APART, V.INCLUDED, V.INCLUDING, V.EXCLUDING, V.KEPT_WORDS, V.BANNED_WORDS, V.GONE, V.OPEN, V.FROM, COORDINATES, V.CODE_LABELS, V.CONTACT_WORDS, V.DEPOSIT,
    V.RENTING, V.PROPERTY, V.MONEY, V.REQUEST, V.SALE, V.SERVICES, V.GUIDE, V.COMMERCIAL, V.VEHICLES, V.BOOKING,
]
#: Groups whose words may stand within others.
_LOOSE = (V.MONEY, COORDINATES)
#: Phrases and pairs of words (see vocabulary.py) and the groups that their matches need.
_PHRASES = {
    V.PETS_KEPT: (V.phrases, (V.KEPT_WORDS,)), V.PETS_BANNED: (V.phrases, (V.BANNED_WORDS,)),
    V.UTILITIES_IN: (V.near, (V.INCLUDED, V.INCLUDING)), V.UTILITIES_OUT: (V.near, (V.APART, V.EXCLUDING)),
}
_SIGNS |= {name: re.compile(script) for name, script in V.LANGUAGE_SCRIPTS.items()}
#: The place of each group, sign and phrase among the bits, how many a long has, and the columns.
BITS = {group: i for i, group in enumerate(dict.fromkeys([*_GROUPS, *_SIGNS, *_PHRASES]))}
WIDTH = 62
PARTS = -(-len(BITS) // WIDTH)
CLUES = [*[pa.field(f"{kind}{i}", pa.int64()) for kind in ("may", "sure") for i in range(PARTS)], *[pa.field(name, pa.int64()) for name in V.LANGUAGES]]
CLUES_TYPE = StructType([StructField(f.name, LongType()) for f in CLUES])


def _pieces(word: str) -> tuple[str, ...]:
    return tuple(p.upper().lower() for p in V._parts(word.removesuffix("*")) if p[0] not in "[* ")


def _parted(words: tuple[str, ...]) -> list[str]:
    return [word for word in words if " " in word]


_OF_WORDS = [group for group in BITS if group not in _SIGNS and group not in _PHRASES and group not in _LOOSE]


def _pattern(group) -> re.Pattern:
    if group in _SIGNS:
        return _SIGNS[group]
    if group in _LOOSE:
        return re.compile("|".join(map(re.escape, V.pieces(group))))
    return re.compile(_PHRASES[group][0](group, LETTER) if group in _PHRASES else V.any_of(group, LETTER))


PATTERNS = [_pattern(group) for group in BITS]
#: Pieces of which a line needs one, so that a pattern may match; none for signs.
NEEDED = [V.pieces(sum(_PHRASES[group][1], ()) if group in _PHRASES else group) if group not in _SIGNS else () for group in BITS]
#: The pieces of words of several parts, and of each group those of each such word.
PIECES = {piece: 1 << i for i, piece in enumerate(sorted({p for group in _OF_WORDS for word in _parted(group) for p in _pieces(word)}))}
WORDS = [tuple({sum(PIECES[p] for p in set(_pieces(word))) for word in _parted(group)}) if group in _OF_WORDS else () for group in BITS]
#: How often a text has words of a language; and how words of several parts begin.
COUNTED = [re.compile(V.any_of(words, LETTER)) for words in V.LANGUAGES.values()]
BEGUN = tuple({_pieces(word)[0] for words in V.LANGUAGES.values() for word in _parted(words)})


def _found(line: str) -> int:
    low = line.translate(LETTERS)
    held = [not needed or any(p in low for p in needed) for needed in NEEDED]
    return sum(1 << i for i, pattern in enumerate(PATTERNS) if held[i] and pattern.search(line if NEEDED[i] == () else low))


@by_form
def _line(form: bytes) -> tuple[int, int, int, tuple[int, ...], bool]:
    """Of a line: pieces and groups, as far as it has them as it is or in plain spelling; groups
    as it is; numbers of words by language; and whether one of these may go on in the next."""
    line = form.decode("utf-8", "surrogateescape")
    plain, low = unicodedata.normalize("NFKC", line), line.translate(LETTERS)
    sure = _found(line)
    also = _found(plain) if plain != line else 0
    both = f"{low}\n{plain.translate(LETTERS)}"
    held = sum(bit for piece, bit in PIECES.items() if piece in both)
    return held, sure | also, sure, tuple(len(p.findall(low)) for p in COUNTED), low.rstrip().endswith(BEGUN)


@lru_cache(FORMS)
def _bits(held: int, may: int, sure: int) -> tuple[int, ...]:
    """The bits of may, also of groups of which all pieces of a word are there, and of sure."""
    may |= sum(1 << i for i, words in enumerate(WORDS) if any(word & held == word for word in words))
    return tuple(bits >> i * WIDTH & (1 << WIDTH) - 1 for bits in (may, sure) for i in range(PARTS))


def clues_of(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.cast(pa.large_binary()).to_pylist():
        form = (text or b"").translate(ZEROS)
        held = may = sure = 0
        lines = [_line(line) for line in form.split(b"\n")]
        for pieces, some, own, _, _ in lines:
            held, may, sure = held | pieces, may | some, sure | own
        if any([line[4] for line in lines[:-1]]):
            low = form.decode("utf-8", "surrogateescape").translate(LETTERS)
            counts = [len(p.findall(low)) for p in COUNTED]
        else:
            counts = [sum(n) for n in zip(*[line[3] for line in lines], strict=True)]
        out.append((*_bits(held, may, sure), *counts))
    columns = [pa.array(column, pa.int64()) for column in zip(*out, strict=True)] if out else [pa.array([], pa.int64()) for _ in CLUES]
    return pa.StructArray.from_arrays(columns, fields=CLUES, mask=texts.is_null())


@F.arrow_udf(CLUES_TYPE)
def clues(texts: pa.Array) -> pa.Array:
    """Struct of the bits of groups that a text may have and surely has, and of the number of
    words of each language; null without a text."""
    return clues_of(texts)


def _any(seen: Column, kind: str, groups: tuple) -> Column:
    masks: dict[int, int] = {}
    for group in groups:
        part, bit = divmod(BITS[group], WIDTH)
        masks[part] = masks.get(part, 0) | 1 << bit
    return functools.reduce(operator.or_, [seen[f"{kind}{i}"].bitwiseAND(F.lit(mask).cast("long")) != 0 for i, mask in masks.items()])


def may(seen: Column | None, *groups) -> Column:
    """False where no pattern of the words of any of groups can match the text whose clues are
    seen, or a part of it, or of its plain spelling; without clues always true."""
    return F.lit(True) if seen is None else _any(seen, "may", groups)


def sure(seen: Column, group) -> Column:
    """Whether a text has a sign, or words, or a phrase in one line."""
    return _any(seen, "sure", (group,))


def told(seen: Column | None, parts: tuple, found: Column) -> Column:
    """Whether a text has any of some phrases; found: what their pattern finds, which may lie on
    several lines where the words of one are there."""
    return found if seen is None else sure(seen, parts) | (may(seen, *_PHRASES[parts][1]) & found)


def named(seen: Column, words: tuple[str, ...], found: Column) -> Column:
    """Whether a text has any of words; found: what their pattern finds, for words of several
    parts that may lie on several lines."""
    return sure(seen, words) | (may(seen, words) & found) if _parted(words) else sure(seen, words)
