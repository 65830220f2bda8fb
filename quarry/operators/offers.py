"""Offers out of raw rows: what a text says, completed by what its source declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import listing_text as T
from quarry.functions.clues import clues
from quarry.functions.url import canonical_url
from quarry.operators.entities import PHOTOS
from quarry.operators.value import convert_to_vnd
from quarry.sources.listing import spread

#: Names where a row has none, and how long a photo's id may be.
UNKNOWN_SOURCE, UNTITLED, INTENT, PHOTO_ID = "unknown", "Accommodation", "rental-offer", 2048
#: Reasons of the classifier that ask for a review of an offer.
TO_REVIEW = ("informational-market-content", "service-advertisement")


def _said(column: str) -> Column:
    """A text without white space at its ends; null where nothing is left."""
    return F.nullif(F.btrim(F.col(column), F.lit(" \t\n\r\u00a0")), F.lit(""))


def normalize_offers(rows: DataFrame, rates: DataFrame, collected_at: Column) -> DataFrame:
    """rows with text, title, id, source_id, source_type, kind, location, url, official_url,
    search_query, posted_at, updated_at, amount, currency, period, basis, contacts,
    identifiers, photos (all may be null) and ordinal, as offers (see operators.entities).

    What a row declares goes before what its text says: the price as a whole, place, kind,
    basis. Contacts are united, text first. A row without an id gets one from its source
    and the SHA-256 of url, text and date, so the same post gets the same one again; equal
    ids join, so a hash of few bits would join posts of different flats. Urls are
    canonical. price_vnd is null where the currency has no rate; rate_source tells where a
    rate is from. review_reasons holds what is odd about the quote and posts that are no
    offers by their classification. basis_provenance is `declared` or
    `inferred-from-quote`. The text is parsed once a row; short tables are dealt to all
    cores for that.
    """
    text = F.coalesce(_said("text"), _said("title"), F.lit(""))
    read = spread(rows).withColumn("_text", text)
    read = read.withColumns({"_p": T.parse_listing(F.col("_text"), F.coalesce("posted_at", collected_at)), "_v": T.post_verdict(F.col("_text"), seen=clues(F.col("_text")))["reason"]})
    declared = F.col("amount").isNotNull()
    quoted = F.col("_p.rent.amount").isNotNull()
    url, source = canonical_url(_said("url")), F.coalesce(_said("source_id"), F.lit(UNKNOWN_SOURCE))
    key = F.concat_ws("\n", F.coalesce(url, F.lit("")), F.col("_text"), F.coalesce(F.col("posted_at").cast("string"), F.lit("")))
    reasons = F.array_compact(F.array_distinct(F.concat(F.coalesce(F.col("_p.rent.issues"), F.array().cast("array<string>")), F.array(F.when(F.col("_v").isin(*TO_REVIEW), F.col("_v"))))))
    own = rows.schema["contacts"].dataType.names
    none = F.array().cast("array<string>")
    united = [F.array_distinct(F.concat(*([F.col(f"_p.contacts.{c}")] if c in ("email", "phone", "telegram") else []), F.coalesce(f"contacts.{c}", none))).alias(c) for c in own]
    photos = F.slice(F.array_distinct(F.filter(F.coalesce("photos", none), lambda p: p.isNotNull() & (p != "") & (F.length(p) <= PHOTO_ID))), 1, PHOTOS)
    either = lambda c: F.when(declared, F.col(c)).otherwise(F.col(f"_p.rent.{c}")).alias(c)
    out = read.select(
        "ordinal", F.coalesce(_said("id"), F.concat(source, F.lit(":"), F.when(_said("id").isNull(), F.sha2(key, 256)))).alias("id"), source.alias("source_id"), _said("source_type").alias("source_type"),
        F.coalesce(_said("title"), F.nullif(F.btrim(F.substring_index("_text", "\n", 1), F.lit(" \t\r")), F.lit("")), F.lit(UNTITLED)).alias("title"), F.lit(INTENT).alias("intent"), F.coalesce(_said("kind"), "_p.kind").alias("kind"), F.col("_p.language.language").alias("language"),
        F.coalesce(_said("location"), "_p.location.place").alias("location"), F.when(_said("location").isNotNull(), "declared").otherwise(F.col("_p.location.method")).alias("location_provenance"), url.alias("url"), canonical_url(_said("official_url")).alias("official_url"), _said("search_query").alias("search_query"),
        "posted_at", "updated_at", collected_at.alias("collected_at"), either("amount"), either("currency"), either("period"),
        F.coalesce(_said("basis"), F.when(quoted & ~declared, F.col("_p.rent.basis")), F.lit("property")).alias("basis"), F.when(_said("basis").isNotNull(), "declared").otherwise("inferred-from-quote").alias("basis_provenance"),
        F.struct(
            F.col("_p.bedrooms").cast("double").alias("bedrooms"), F.col("_p.beds").cast("double").alias("beds"), F.col("_p.availability").alias("availability"), F.col("_p.available_now").alias("available_now"), F.col("_p.amenities.present").alias("amenities"),
            (F.size(reasons) > 0).alias("review_required"), reasons.alias("review_reasons"), F.col("_p.bathrooms").alias("bathrooms"), F.col("_p.area").alias("area_m2"), F.col("_p.floor").cast("string").alias("floor"), F.col("_p.property_id").alias("property_id"),
            F.col("_p.pets_allowed").alias("pets_allowed"), F.col("_p.utilities_included").alias("utilities_included"), F.col("_p.lease.minimum_months").alias("minimum_stay_months"), F.col("_p.lease.deposit_months").alias("deposit_months"), F.col("_p.available_from").alias("available_from"),
        ).alias("attributes"),
        F.col("_p.labeled_fields").alias("labeled_fields"), F.struct(*united).alias("contacts"), "identifiers", photos.alias("photos"),
    )
    priced = convert_to_vnd(out, rates)
    return priced.withColumn("rate_source", F.when(F.col("currency") == "VND", "par").when(F.col("price_vnd").isNotNull(), "rate-table"))
