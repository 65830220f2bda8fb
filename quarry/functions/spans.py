"""Spans of texts: entities in UTF-16 units, folded text with a way back."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: The entities that are kept, by the names that providers have for them.
ENTITY_TYPES = {"messageEntityTextUrl": "text_link", "messageEntityUrl": "url", "messageEntityMention": "mention", "messageEntityEmail": "email", "messageEntityPhone": "phone_number"}
#: Entities of a text that are looked at, and characters of a link.
ENTITIES, LINK = 100, 2048


def _unit(units: Column, at: Column) -> Column:
    """The high byte of a UTF-16 unit, as two hex digits."""
    return F.hex(F.substring(units, at * 2 + 1, 1))


def _inside_pair(units: Column, at: Column) -> Column:
    """Whether a position lies between the two units of one character."""
    return (at > 0) & _unit(units, at - 1).rlike("^D[89AB]") & _unit(units, at).rlike("^D[CDEF]")


def sliced(units: Column, offset: Column, length: Column) -> Column:
    """Text from UTF-16 (big endian) units."""
    return F.decode(F.substring(units, offset * 2 + 1, length * 2), "UTF-16BE")


def text_entities(text: Column, entities: Column) -> Column:
    """The valid ones of a text's entities, in their order: array of struct (type, offset,
    length, url, target, context).

    entities: array of struct (type, offset, length, url), positions in UTF-16 units. Of
    the first ENTITIES those stay that have a known type, lie within the text, cut no
    character in two, have a link to the web, mail or telephone where they are text links,
    and overlap none that stays before them. target is the link or the text that is meant,
    context the line up to the entity's end. Null text or entities: an empty array.
    """
    units = F.encode(text, "UTF-16BE")
    n = (F.octet_length(units) / 2).cast("long")
    types = F.create_map(*[F.lit(x) for pair in [*ENTITY_TYPES.items(), *[(t, t) for t in ENTITY_TYPES.values()]] for x in pair])

    def fits(e: Column) -> Column:
        offset, end = e["offset"], e["offset"] + e["length"]
        link = e["url"].rlike(r"(?i)^(?:https?://|mailto:|tel:)") & (F.length(e["url"]) <= LINK)
        inside = (offset >= 0) & (e["length"] >= 1) & (end <= n)
        whole = ~_inside_pair(units, offset) & ~_inside_pair(units, end)
        return F.coalesce(inside & F.when(inside, whole) & e["type"].isNotNull() & ((e["type"] != "text_link") | link), F.lit(False))

    def told(e: Column) -> Column:
        end = e["offset"] + e["length"]
        line = F.substring_index(sliced(units, F.lit(0), e["offset"]), "\n", -1)
        url = F.when(e["type"] == "text_link", e["url"])
        return F.struct(e["type"].alias("type"), e["offset"].alias("offset"), e["length"].alias("length"), url.alias("url"), F.coalesce(url, sliced(units, e["offset"], e["length"])).alias("target"), F.concat(line, sliced(units, e["offset"], end - e["offset"])).alias("context"))

    given = F.transform(F.slice(entities, 1, ENTITIES), lambda e: F.struct(types[e["type"]].alias("type"), e["offset"].cast("long").alias("offset"), e["length"].cast("long").alias("length"), e["url"].alias("url")))
    kind = "array<struct<type:string,offset:long,length:long,url:string>>"
    apart = lambda e, o: (e["offset"] >= o["offset"] + o["length"]) | (e["offset"] + e["length"] <= o["offset"])
    kept = F.aggregate(F.filter(given, fits), F.array().cast(kind), lambda done, e: F.when(F.forall(done, lambda o: apart(e, o)), F.concat(done, F.array(e))).otherwise(done))
    return F.coalesce(F.transform(kept, told), F.array().cast("array<struct<type:string,offset:long,length:long,url:string,target:string,context:string>>"))


_FOLDED = StructType([StructField("text", StringType()), StructField("starts", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType()))])


def fold_compatible(text: str) -> tuple[str, list[int], list[int]]:
    """A text in NFKC, folded one user-perceived character at a time, and for each of its
    characters where the original one begins and ends (code points)."""
    out, starts, ends, at = [], [], [], 0
    for cluster in regex.findall(r"\X", text):
        folded = unicodedata.normalize("NFKC", cluster)
        out.append(folded)
        starts += [at] * len(folded)
        at += len(cluster)
        ends += [at] * len(folded)
    return "".join(out), starts, ends


@F.pandas_udf(_FOLDED)
def _lexemes(texts: pd.Series) -> pd.DataFrame:
    rows = [fold_compatible(t) if t is not None else (None, None, None) for t in texts]
    return pd.DataFrame(rows, columns=["text", "starts", "ends"])


def lexemes(text: Column) -> Column:
    """Struct of the folded text and, for each of its characters, where the original one
    starts and ends. A text that is ASCII only folds to itself and needs no Python."""
    plain = text.rlike(r"^\p{ASCII}*$") & ~text.contains("\r\n")
    n = F.length(text)
    count = lambda first: F.when(n > 0, F.sequence(F.lit(first), n - 1 + first)).otherwise(F.array().cast("array<int>"))
    native = F.struct(text.alias("text"), count(0).alias("starts"), count(1).alias("ends"))
    other = _lexemes(F.when(~plain, text))
    return F.when(text.isNull(), F.lit(None)).when(plain, native).otherwise(F.struct(other["text"].alias("text"), other["starts"].alias("starts"), other["ends"].alias("ends")))


def source_span(folded: Column, start: Column, end: Column) -> Column:
    """Struct (start, end) in the original text of a span of the folded one, widened to
    whole characters; null where the span is empty or outside."""
    begin, last = F.get(folded["starts"], start), F.get(folded["ends"], end - 1)
    return F.when((start >= 0) & (end > start) & begin.isNotNull() & last.isNotNull(), F.struct(begin.alias("start"), last.alias("end")))


def found_in_source(text: Column, pattern: str) -> Column:
    """The first match of a pattern in the folded text, as the original writes it."""
    folded = lexemes(text)
    hit = F.regexp_substr(folded["text"], F.lit(pattern))
    start = F.when(hit.isNotNull(), F.position(hit, folded["text"]) - 1)
    span = source_span(folded, start, start + F.length(hit))
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])
