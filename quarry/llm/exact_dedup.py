"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import staged

#: What tells texts apart.
KEY = ["digest", "bytes", "second"]


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise=None,
    fan_in: int = 4,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Each partition turns its rows into a run, sorted by digest, with one entry per
    distinct text: the best identifier so far and a count. Then partitions exchange runs
    in binomial rounds (see tree_merged). A group of copies of any size leaves each
    partition as one entry, and comes closer by a factor of fan_in in each round.

    Two texts are equal when SHA-256, byte length and a second hash (xxhash64) agree.

    keep: "min" or "max" of id_col stays. Null ids sort below all others. Of rows that
    repeat an id and a text, exactly one is kept. Null text counts as empty. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = staged(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.sha2(text, 256).alias("digest"),
            F.octet_length(text).cast("long").alias("bytes"),
            F.xxhash64(text).alias("second"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    nodes = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = tree_merged(rows.withColumn("n", F.lit(1).cast("long")), keep, nodes, fan_in).select(*KEY, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), "n")
    return rows.join(kept, KEY).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def rounds_of(nodes: int, fan_in: int) -> int:
    """Rounds until fan_in ** rounds nodes or more have met."""
    rounds = 1
    while fan_in**rounds < nodes:
        rounds += 1
    return rounds


def tree_merged(entries: DataFrame, keep: str, nodes: int, fan_in: int) -> DataFrame:
    """entries (KEY, id, row, n) with one row left for each key: the best (id, row) and the
    sum of n.

    Partition p has the node number p modulo fan_in ** rounds, a digit of base fan_in for
    each round. In round r the fan_in nodes that differ in digit r alone exchange their
    runs: each keeps the entries whose digest has its own digit and sends the others to
    their node. What a node then has are fan_in sorted runs, which are merged: entries of
    a key become one. After the last round a key has one node. An entry stays a candidate
    only if it is the best of its node, and keys are compared whole at every level.
    """
    rounds = rounds_of(nodes, fan_in)
    size = fan_in**rounds
    order = [F.col(c).asc_nulls_first() if keep == "min" else F.col(c).desc_nulls_last() for c in ("id", "row")]
    columns = [*KEY, "id", "row", "n"]
    kind = entries.select(*columns).schema
    runs = entries.select(*columns).sortWithinPartitions(*KEY, *order).mapInArrow(_merged, kind)
    runs = runs.withColumn("node", F.pmod(F.spark_partition_id(), F.lit(size)))
    for r in range(rounds):
        runs = runs.withColumn("node", _exchanged("node", F.col("second"), r, size, fan_in))
        runs = runs.repartitionById(size, F.col("node")).sortWithinPartitions(*KEY, *order)
        runs = runs.select(*columns).mapInArrow(_merged, kind).withColumn("node", F.spark_partition_id())
    return runs.select(*columns)


def _exchanged(node: str, digest: Column, r: int, size: int, base: int) -> Column:
    """The node number with digit r of the digest in the place of its own."""
    at = base**r
    digit = lambda x: F.pmod(F.floor(x / F.lit(at)), F.lit(base))
    return (F.col(node) + (digit(F.pmod(digest, F.lit(size))) - digit(F.col(node))) * F.lit(at)).cast("int")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of one key become one entry: the first of them, as they come sorted, and
    the sum of their counts. A key may go on in the next batch."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
        new = np.ones(batch.num_rows, bool)
        if batch.num_rows > 1:
            same = [pc.equal(batch[c].slice(1), batch[c].slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False) for c in KEY]
            new[1:] = ~np.logical_and.reduce(same)
        first = np.flatnonzero(new)
        sums = np.add.reduceat(batch["n"].to_numpy(), first)
        out = batch.take(pa.array(first)).set_column(batch.schema.get_field_index("n"), "n", pa.array(sums))
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
