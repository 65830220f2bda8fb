"""Free-form records: canonical options, overlays, bounds."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: How deep, wide and large a stored record may be.
TEXT, ITEMS, DEPTH, BYTES = 4096, 20, 4, 8 * 1024
#: Fields that are never stored, as they are elsewhere or hold provider data.
DROPPED = ("mediaIds", "members", "photos", "raw")
#: Fields that stay where a record is too large otherwise.
CORE = ("id", "messageId", "messageIds", "sourceId", "url", "date", "editDate", "groupedId", "topicId", "media", "entities", "ocrState", "discoveredFrom", "caption", "text")
#: Fields that hold secrets or a person's own data, refused wherever they stand.
DENIED = ("password", "secret", "token", "api_key", "session", "phone_code", "authorization", "cookie")


def canonical(options: Column) -> Column:
    """JSON with the keys of all objects in order, without blanks and trailing zeros of
    decimals (1.0 is 1; numbers with an exponent stay apart), so that equal options are
    equal text; null for what is no JSON."""
    return F.to_json(F.try_parse_json(options))


def _fields(options: Column) -> Column:
    return F.try_parse_json(options).cast("map<string,variant>")


def overlay(base: Column, overrides: Column, nested: str = "filters") -> Column:
    """Canonical JSON of base with the fields of overrides in their place; the object
    called nested is overlaid field by field. Null counts as no options."""
    def over(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    none = F.lit("{}")
    a, b = _fields(F.coalesce(base, none)), _fields(F.coalesce(overrides, none))
    inner = lambda m: F.coalesce(F.try_variant_get(m[nested], "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    whole = over(a, b)
    either = F.map_contains_key(a, nested) | F.map_contains_key(b, nested)
    one = F.map_from_arrays(F.array(F.lit(nested)), F.array(F.parse_json(F.to_json(over(inner(a), inner(b))))))
    return canonical(F.to_json(F.when(either, F.map_concat(F.map_filter(whole, lambda k, _: k != nested), one)).otherwise(whole)))


def _safe(value, depth: int):
    """The value within bounds, or None for what is left out; (None,) for a stored null."""
    if value is None:
        return (None,)
    if isinstance(value, str):
        return value[:TEXT]
    if isinstance(value, bool | int):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if depth >= DEPTH:
        return None
    if isinstance(value, list):
        return [_plain(x) for x in (_safe(v, depth + 1) for v in value[:ITEMS]) if x is not None]
    if value.get("type") == "Buffer" and isinstance(value.get("data"), list):
        return None
    return {k: _plain(x) for k, v in value.items() if k not in DROPPED and (x := _safe(v, depth + 1)) is not None}


def _plain(x):
    return None if isinstance(x, tuple) else x


def _size(value) -> int:
    return len(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode())


def _refused(value) -> str | None:
    """The first denied key, wherever it stands."""
    if isinstance(value, dict):
        return next((k for k in value if k.lower() in DENIED), None) or next((d for v in value.values() if (d := _refused(v))), None)
    return next((d for v in value if (d := _refused(v))), None) if isinstance(value, list) else None


def bounded_record(text: str | None) -> tuple[str | None, str | None]:
    """(record, refused): the record within all bounds, or the reason why there is none."""
    try:
        value = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None, "no-json"
    if not isinstance(value, dict):
        return None, "no-object"
    if denied := _refused(value):
        return None, f"denied:{denied.lower()}"
    safe = _plain(_safe(value, 0)) or {}
    if _size(safe) > BYTES:
        safe = {k: safe[k] for k in CORE if k in safe}
        while _size(safe) > BYTES and isinstance(safe.get("text"), str) and safe["text"]:
            safe["text"] = safe["text"][: len(safe["text"]) // 2]
        safe = safe if _size(safe) <= BYTES else {}
    return json.dumps(safe, ensure_ascii=False, separators=(",", ":"), sort_keys=True), None


@F.pandas_udf(StructType([StructField("record", StringType()), StructField("refused", StringType())]))
def _bounded(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([bounded_record(t) for t in texts], columns=["record", "refused"])


def bounded(record: Column) -> Column:
    """Struct (record, refused) of a JSON object: texts of TEXT characters, lists of ITEMS
    values and DEPTH levels at most, without binary data and DROPPED fields; past BYTES only
    the CORE fields, the text halved until it fits. A record with a DENIED key is refused
    whole, with the key; so is what is no JSON object."""
    return _bounded(record)
