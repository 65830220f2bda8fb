"""Predicates over listings. Missing values make a predicate false, never unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import fold


def certainly(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def is_available(since: str, include_unavailable: bool = False) -> Column:
    """Not sold out, not under review, and no older than since if it is a message."""
    if include_unavailable:
        return F.lit(True)
    fresh = (F.col("source_type") != "telegram") | F.col("posted_at").isNull() | (F.col("posted_at") >= F.lit(since).cast("timestamp_ntz"))
    return certainly(fresh) & ~certainly(F.col("review_required")) & ~certainly(F.col("availability") == "unavailable") & F.coalesce("available_now", F.lit(True))


def for_query(stored: Column, query: str) -> Column:
    """All stored queries are empty, or one equals query but for case and outer spaces."""
    clean = F.lit(query.strip().lower())
    return F.forall(stored, lambda q: certainly(q == "") | q.isNull()) | F.exists(stored, lambda q: certainly(F.lower(F.trim(q)) == clean))


def is_fresh(at: Column, now: str, max_age: str) -> Column:
    """0 to max_age old at now; what is dated later is not fresh."""
    end = F.lit(now).cast("timestamp_ntz")
    return certainly((at <= end) & (at >= end - F.expr(f"interval {max_age}")))


def in_window(at: Column, now: str, days: int = 90) -> Column:
    """At or after now less so many days."""
    return certainly(at >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def message_matches(document: Column, query: str) -> Column:
    """Every word of the query is in the folded document."""
    return F.forall(F.filter(F.split(fold(F.lit(query)), r"\s+"), lambda t: t != ""), lambda t: certainly(F.contains(fold(document), t)))


def value_matches(actual: Column, kind: str, expected) -> Column:
    """Texts match by folded containment, arrays by any element, the rest by equality of
    value and type: a number is no text."""
    if kind.startswith("array<"):
        return F.coalesce(F.exists(actual, lambda x: value_matches(x, kind[6:-1], expected)), F.lit(False))
    if kind == "string" and isinstance(expected, str):
        return certainly(F.contains(fold(actual), fold(F.lit(expected))))
    same = kind == "boolean" if isinstance(expected, bool) else kind in ("double", "float", "int", "bigint") if isinstance(expected, int | float) else kind == "string"
    return certainly(actual == F.lit(expected)) if same else F.lit(False)


def matches_filters(columns: dict[str, str], filters: dict) -> Column:
    """All key=value filters hold. A key is a column (dots reach into structs), else a
    labelled field."""
    out = F.lit(True)
    for key, expected in filters.items():
        top = key.split(".")[0]
        actual, kind = (F.col(key), columns.get(key, "string")) if top in columns else (F.try_element_at("labeled_fields", F.lit(key)), "array<string>")
        out = out & value_matches(actual, kind, expected)
    return out


def source_matches(focus: Column, cities: list[str]) -> Column:
    """The query names no city, the source has no focus, or they have a city in common."""
    if not cities:
        return F.lit(True)
    return (F.coalesce(F.size(focus), F.lit(0)) <= 0) | certainly(F.arrays_overlap(focus, F.array(*[F.lit(c) for c in cities])))


def is_protected(posted_at: Column, collected_at: Column, since: str) -> Column:
    """Young enough to keep, or of unknown age."""
    at = F.coalesce(posted_at, collected_at)
    return at.isNull() | (at >= F.lit(since).cast("timestamp_ntz"))


def is_public_url(url: Column) -> Column:
    """http(s) without user info, to no local or private host."""
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    private = r"^(localhost|.*\.local|.*\.localhost|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2\d|3[01])\..*|0\..*|\[(::1?|f[cd].*|fe[89ab].*)\])$"
    return certainly(url.rlike(r"^(?i)https?://") & ~url.rlike(r"^(?i)https?://[^/?#]*@") & (host != "") & ~host.rlike(private))
