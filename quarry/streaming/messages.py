"""Message streams: admission, edits and deletions, albums, rate limits.

Each function takes a streaming or a batch frame where its docstring says so."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType


def admit_once(events: DataFrame, id_col: str, time_col: str, delay: str = "1 day") -> DataFrame:
    """Streaming or batch: each id once. In a stream an id is remembered until the
    watermark passes it, so the state is bounded by time, not by a count."""
    if events.isStreaming:
        return events.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])
    return events.dropDuplicates([id_col])


def current_messages(events: DataFrame, keys: list[str], order: list[str], since: str | None = None) -> DataFrame:
    """Batch: the last event of each message, where that is no deletion and not older than
    since (a rolling window, not a watermark)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    rows = events.withColumn("_place", place).where("_place = 1 AND type <> 'delete'").drop("_place")
    return rows if since is None else rows.where(F.col(order[0]) >= F.lit(since).cast("timestamp_ntz"))


def apply_changes(target: str, keys: list[str], order: list[str]):
    """For writeStream.foreachBatch: keeps a Parquet table under target up to date.

    A batch's own last events replace the messages they name; deletions take them away.
    The new version goes to a folder of the batch's number, so a batch that is repeated
    writes the same again."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
        last = batch.withColumn("_place", place).where("_place = 1").drop("_place")
        rows = last.where("type <> 'delete'")
        if number:
            old = spark.read.schema(batch.schema).parquet(f"{target}/{number - 1}")
            rows = old.join(last.select(*keys), keys, "left_anti").unionByName(rows)
        rows.write.mode("overwrite").parquet(f"{target}/{number}")

    return run


def albums(messages: DataFrame) -> DataFrame:
    """Batch: chat_id, album, message_ids in order, captions, media (10 at most).

    Messages without grouped_id are albums of their own."""
    album = F.coalesce(F.col("grouped_id").cast("string"), F.concat(F.lit("m"), F.col("message_id").cast("string")))
    rows = F.array_sort(F.collect_list(F.struct("message_id", "text", "media")))
    out = messages.groupBy("chat_id", album.alias("album")).agg(rows.alias("rows"))
    pick = lambda name: F.array_distinct(F.filter(F.transform("rows", lambda r: r[name]), lambda x: x.isNotNull() & (x.cast("string") != "")))
    return out.select("chat_id", "album", pick("message_id").alias("message_ids"), pick("text").alias("captions"), F.slice(pick("media"), 1, 10).alias("media"))


def limit_rate(events: DataFrame, key: str, time_col: str, most: int, window: str) -> DataFrame:
    """Streaming: events with allowed, false past most events of a key within the window
    that its first event opened. The state is a key's window and count."""
    size = pd.Timedelta(window)

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, n = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(time_col, kind="stable")
        allowed = []
        for at in rows[time_col].astype("datetime64[ns]").astype("int64"):
            if n == 0 or at - begin >= size.value:
                begin, n = int(at), 0
            n += 1
            allowed.append(n <= most)
        state.update((int(begin), int(n)))
        yield rows.assign(allowed=allowed)

    schema = StructType([*events.schema.fields, StructField("allowed", BooleanType())])
    return events.groupBy(key).applyInPandasWithState(run, schema, "begin long, n long", "append", GroupStateTimeout.NoTimeout)


def first_of_window(events: DataFrame, key: str, time_col: str, window: str) -> DataFrame:
    """Batch: key, start and n of each window that a key's first event opens, or its first
    one after the last window has passed. Rows are sorted by key and time and read as they
    come, so a key may have any number; null times count nowhere."""
    size = pd.Timedelta(window).value // 1000
    kind, arrow = events.schema[key].dataType.simpleString(), to_arrow_type(events.schema[key].dataType)
    rows = events.select(F.col(key).alias("key"), F.col(time_col).cast("timestamp_ntz").alias("at")).where("at IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begin, n, first = None, 0, 0, True
        for batch in batches:
            at = batch["at"].cast(pa.int64()).to_numpy()
            coded = batch["key"].dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy() if coded.indices.null_count else coded.indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(at)] if len(at) else [0]
            done: list[tuple] = []
            for a, b in zip(edges, edges[1:], strict=False):
                name = batch["key"][a].as_py()
                if first or name != held:
                    if not first:
                        done.append((held, begin, n))
                    held, begin, n, first = name, int(at[a]), 0, False
                while a < b:
                    upto = a + int(np.searchsorted(at[a:b], begin + size))
                    n, a = n + upto - a, upto
                    if a < b:
                        done.append((held, begin, n))
                        begin, n = int(at[a]), 0
            yield batch_of(done)
        if not first:
            yield batch_of([(held, begin, n)])

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        names, starts, counts = zip(*done, strict=True) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(names, arrow), pa.array(starts, pa.int64()).cast(pa.timestamp("us")), pa.array(counts, pa.int64())], ["key", "start", "n"])

    out = rows.repartition("key").sortWithinPartitions("key", "at").mapInArrow(run, f"key {kind}, start timestamp_ntz, n long")
    return out.withColumnRenamed("key", key)


class _Ring(StatefulProcessor):
    """The ids that a key has last admitted, oldest first."""

    def __init__(self, id_col: str, order: list[str], most: int):
        self.id_col, self.order, self.most = id_col, order, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = dict.fromkeys(r[0] for r in self.ring.get())
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        admitted = []
        for value in frame[self.id_col].astype(str):
            admitted.append(value not in known)
            if admitted[-1]:
                known[value] = None
                if len(known) > self.most:
                    del known[next(iter(known))]
        self.ring.put([(i,) for i in known])
        yield frame.assign(admitted=admitted)

    def close(self) -> None:
        pass


def admit_recent(events: DataFrame, key: str, id_col: str, order: list[str], most: int = 10_000) -> DataFrame:
    """Streaming: events with admitted, false where the id is among the last `most` ids
    that its key admitted. What is refused doesn't become recent again. The state is a list
    of at most `most` ids a key, whatever time they span; within a batch events act in the
    given order. Needs the RocksDB state store (see state_store)."""
    schema = StructType([*events.schema.fields, StructField("admitted", BooleanType())])
    return events.groupBy(key).transformWithStateInPandas(_Ring(id_col, order, most), schema, "Append", "None")


def state_store(spark) -> None:
    """Sets the state store that lists of state need, where none is set."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
