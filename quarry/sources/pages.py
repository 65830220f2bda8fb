"""Import of collected page files: checked against a manifest, read by format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The formats that files may have.
FORMATS = ("jsonl", "csv", "html")
_CARD = "struct<id:string,title:string,price:double>"


def files_of(spark: SparkSession, folder: str, name: str = r"([^/]+)$") -> DataFrame:
    """name, content, sha256 of all files below a folder; the name is what the pattern's
    group finds in the path. Hidden files and markers of Spark's committers are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    own = F.regexp_extract("path", name, 1)
    return files.where(~F.substring_index("path", "/", -1).rlike("^[_.]")).select(own.alias("name"), "content", F.sha2("content", 256).alias("sha256"))


def checked_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, state, format, source_id and content of files and of what the manifest (name,
    sha256, format, source_id) lists: missing, unlisted, changed (another digest),
    unknown-format, else ok. Only ok files have content. A name that the manifest lists
    twice with different entries is `ambiguous`, not fatal."""
    listed = manifest.groupBy("name").agg(F.collect_set(F.struct("sha256", "format", "source_id")).alias("all")).select("name", F.element_at("all", 1).alias("m"), (F.size("all") > 1).alias("several"))
    rows = files.join(listed, "name", "full_outer")
    state = (
        F.when(F.col("sha256").isNull(), "missing").when(F.col("m").isNull(), "unlisted").when(F.col("several"), "ambiguous")
        .when(F.col("sha256") != F.col("m.sha256"), "changed").when(~F.coalesce(F.col("m.format").isin(*FORMATS), F.lit(False)), "unknown-format").otherwise("ok")
    )
    rows = rows.withColumn("state", state)
    return rows.select("name", "state", "m.format", "m.source_id", F.when(F.col("state") == "ok", F.col("content")).alias("content"))


def cards(checked: DataFrame) -> DataFrame:
    """name, source_id, place, id, title, price, fault of each card of the ok files.

    jsonl: an object a line; csv: a header, then id,title,price; html: list items with
    data-id and data-price. Blank lines count nothing. A card that can't be read is a row
    with its fault (no-card, or no-price where only the price is wrong), and so the rest of
    its file is still read. All formats are read by expressions, in one pass."""
    text = F.decode("content", "UTF-8")
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")

    def from_csv(x: Column) -> Column:
        part = F.split(x, ",", 3)
        return F.when(F.size(part) == 3, F.struct(F.get(part, F.lit(0)).alias("id"), F.get(part, F.lit(1)).alias("title"), F.get(part, F.lit(2)).try_cast("double").alias("price")))

    def from_html(x: Column) -> Column:
        at = lambda pattern: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))
        return F.struct(at(r'data-id="([^"]*)"').alias("id"), F.btrim(F.regexp_replace(x, "<[^>]*>", ""), F.lit(" \t\r\n")).alias("title"), at(r'data-price="([^"]*)"').try_cast("double").alias("price"))

    json = F.transform(lines, lambda x: F.from_json(x, "id string, title string, price double"))
    html = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(<li\b.*?</li>)"), 1), from_html)
    table = F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), from_csv)
    read = F.when(F.col("format") == "jsonl", json).when(F.col("format") == "csv", table).otherwise(html).cast(f"array<{_CARD}>")
    rows = checked.where("state = 'ok'").select("name", "source_id", F.posexplode(read).alias("place", "card"))
    fault = F.when(F.col("card").isNull() | F.col("card.id").isNull(), "no-card").when(F.col("card.price").isNull(), "no-price")
    return rows.select("name", "source_id", (F.col("place") + 1).alias("place"), "card.id", "card.title", "card.price", fault.alias("fault"))


def import_report(checked: DataFrame, found: DataFrame) -> DataFrame:
    """One row a file: state, cards and faults."""
    sums = found.groupBy("name").agg(F.count_if(F.col("fault").isNull()).alias("cards"), F.count("fault").alias("faults"))
    return checked.select("name", "state", "format").join(sums, "name", "left").na.fill(0, ["cards", "faults"])
