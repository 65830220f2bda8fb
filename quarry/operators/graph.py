"""Records as triples, reference pruning and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir. Where that is unset a temporary
    folder serves, but only in one process: on a cluster others couldn't read it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark takes the shuffle files of a query away as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage. What it was
    shuffled for is written then, so the shuffle files go at once."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def emptied(*tables: DataFrame) -> None:
    """Takes the files of stored tables away that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            spark.range(0).write.mode("overwrite").parquet(folder)


def to_triples(rows: DataFrame, key: str) -> DataFrame:
    """record, path, kind, value: one row per column that is not null."""
    kinds = {"string": "string", "boolean": "boolean"}
    fields = [F.struct(F.lit("/" + c).alias("path"), F.lit(kinds.get(t, "number")).alias("kind"), F.col(c).cast("string").alias("value")) for c, t in rows.dtypes if c != key]
    return rows.select(F.col(key).alias("record"), F.inline(F.array(*fields))).where("value IS NOT NULL")


def from_triples(triples: DataFrame, paths: dict[str, str]) -> DataFrame:
    """The inverse: one row per record with a column for each path, of the given type."""
    return triples.groupBy("record").agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).cast(t).alias(p.strip("/")) for p, t in paths.items()])


def prune_orphans(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Links (id, subject, object) of which both ends exist. A link is an end too; so
    what hangs on a removed link goes with it, until nothing changes."""
    while True:
        known = entities.select("id").union(links.select("id")).distinct()
        left = links.join(known.withColumnRenamed("id", "subject"), "subject", "left_semi").join(known.withColumnRenamed("id", "object"), "object", "left_semi")
        left = stored(left.select("id", "subject", "object"), "links")
        if left.count() == links.count():
            return left
        links = left


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Every id that edges (parent, child) lead to from start, itself included: a frontier
    join per step, each step only with what is new."""
    found = frontier = stored(start.select("id").distinct(), "reach")
    while True:
        step = frontier.join(edges, F.col("id") == F.col("parent")).select(F.col("child").alias("id")).distinct()
        frontier = stored(step.join(found, "id", "left_anti"), "reach")
        if not frontier.limit(1).count():
            return found
        found = found.union(frontier)


def components(nodes: DataFrame, keys: Column, id_col: str) -> DataFrame:
    """id and component (smallest id) where rows that share a key belong together."""
    held = nodes.select(F.col(id_col).alias("id"), F.explode(keys).alias("key"))
    return nodes.select(F.col(id_col).alias("id")).join(linked(held), "id", "left").select("id", F.coalesce("label", "id").alias("component"))


def linked(held: DataFrame, salts: int = 32, hot: int = 10_000) -> DataFrame:
    """id and label (smallest id of the component) of all ids in held (id, key) that share
    a key with another.

    Each key links its rows to its smallest id (a star, not all pairs); then smallest
    labels spread and jump until they rest. Hubs and labels that more than `hot` rows have
    are joined by salts: their rows are dealt to `salts` places, and the one row that they
    lead to goes to all of these."""
    hubs = held.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = held.join(hubs, "key").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    star = stored(star, "edges")
    salt = lambda rows, by: rows.withColumn("salt", F.when(F.col("n") > hot, F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0))
    places = F.when(F.col("n") > hot, F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).otherwise(F.array(F.lit(0).cast("long")))
    ends = stored(star.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n")), "hubs")
    # few hubs are hot: only their names travel to the rows
    big = ends.where(F.col("n") > hot)
    star = salt(star.join(big.select(F.col("id").alias("b"), "n"), "b", "left").na.fill(0, ["n"]), "a").drop("n")
    star = stored(star, "edges")
    labels = star.select(F.col("a").alias("id"), F.col("b").alias("label")).union(star.select("b", "b")).groupBy("id").agg(F.min("label").alias("label"))
    labels = stored(labels.select("id", F.least("id", "label").alias("label")), "labels")
    while True:
        # what hubs know goes to their rows, what rows know to their hubs
        hub = labels.join(ends, "id").select(F.col("id").alias("b"), "label", F.explode(places).alias("salt"))
        down = star.join(hub, ["b", "salt"]).select(F.col("a").alias("id"), "label")
        up = star.join(labels, F.col("a") == F.col("id")).select(F.col("b").alias("id"), "label")
        low = labels.withColumn("old", F.col("label")).unionByName(down.union(up).withColumn("old", F.lit(None).cast(labels.schema["id"].dataType)))
        low = stored(low.groupBy("id").agg(F.max("old").alias("old"), F.min("label").alias("low")), "low")
        # labels that lead further, with the number of rows that have them
        named = low.groupBy("low").agg(F.count("*").alias("n"))
        jump = labels.where("id <> label").join(named, F.col("id") == F.col("low")).select("low", F.col("label").alias("jump"), "n")
        far = jump.where(F.col("n") > hot).select("low", "n")
        dealt = salt(low.join(far, "low", "left").na.fill(0, ["n"]), "id").drop("n")
        new = dealt.join(jump.select("low", "jump", F.explode(places).alias("salt")), ["low", "salt"], "left").select("id", "old", F.least("low", F.coalesce("jump", "low")).alias("label"))
        new = stored(new, "labels")
        emptied(low, labels)
        labels = new.select("id", "label")
        if not new.where("old <> label").limit(1).count():
            emptied(star, ends)
            return labels
