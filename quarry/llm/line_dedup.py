"""Lines that repeat across documents, found through two Bloom filters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bytewords import utf8
from quarry.llm.common import fresh, small_batches, staged

HASHES = 3
CHUNK_BITS = 20
#: The twice-seen filter that is broadcast has 32 MiB at most.
MAX_BITS = 1 << 28
#: Lines that a task gathers before it sends their bits.
HELD_LINES = 1 << 20


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_documents: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    bits_per_line: int = 16,
) -> DataFrame:
    """docs with repeated lines taken out of the text, and n_lines and n_dropped.

    Lines end at \\n; a null or empty text is one empty line. A line's key is the line
    without [ \\t-\\r] at both ends, A-Z lower-cased. Keys of min_chars code points or
    more that min_documents rows hold lose all their lines, with keep_first all but the
    first one by (id, text hash, position). The other lines stay, joined by \\n, each as
    it was. Columns of docs called n_lines or n_dropped are replaced; other columns stay.
    Null ids come first; repeated rows count as documents of their own.

    Pass 1 fills a once-seen and a twice-seen Bloom filter: a second sight of a bit moves
    it to the twice-seen filter. Each partition sends the bits of its own lines; filters
    merge by range of bits, in two levels. Pass 2 tests every line against the twice-seen
    filter, and only suspects travel: they are counted by 128-bit digest, which also
    picks first occurrences. The filter has bits_per_line bits for each line of the
    corpus, MAX_BITS at most (17 million lines at 16 bits). Beyond that each line has
    fewer bits, and the share of unique lines that pass as suspects grows: by the Poisson
    rule, 0.5 % of them at 4 bits a line (67 million lines), 9 % at 2 (134 million), half
    at 1. The result stays exact at any size, as suspects are counted. More bits than a
    task can hold would not help: to ask a remote filter for a line's bits moves as many
    bytes as its digest.
    """
    if min_documents < 2:
        raise ValueError("min_documents is 2 at least")
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("t64"))
    lines = rows.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = min(MAX_BITS, 1 << max(CHUNK_BITS, math.ceil(math.log2(max(1, lines * bits_per_line)))))
    local = rows.select("text").mapInArrow(_seen(bits, min_chars), "chunk int, part int, once binary, twice binary")
    fan = max(1, math.isqrt(docs.rdd.getNumPartitions()))
    met = local.groupBy("chunk", F.pmod("part", F.lit(fan)).alias("meet")).applyInArrow(_merged, "chunk int, part int, once binary, twice binary")
    planes = met.groupBy("chunk").applyInArrow(_merged, "chunk int, part int, once binary, twice binary")
    twice = np.zeros(bits >> 3, np.uint8)
    for row in planes.select("chunk", "twice").toLocalIterator():
        twice[row["chunk"] << (CHUNK_BITS - 3) : (row["chunk"] + 1) << (CHUNK_BITS - 3)] = _packed(_positions(row["twice"]))
    shared = docs.sparkSession.sparkContext.broadcast(twice)
    suspects = staged(rows.mapInArrow(_suspects(shared, bits, min_chars), f"id {dict(rows.dtypes)['id']}, t64 long, digest binary, positions array<int>"), "suspects")
    first = F.min(F.struct("id", "t64", F.array_min("positions").alias("at")))
    common = suspects.groupBy("digest").agg(F.count("*").alias("n"), first.alias("first")).where(F.col("n") >= min_documents)
    # written, so that Spark knows its size and can split a digest that many rows have
    hit = suspects.join(staged(common, "common"), "digest")
    if keep_first:
        here = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t64") == F.col("first.t64"))
        hit = hit.withColumn("positions", F.when(here, F.filter("positions", lambda p: p != F.col("first.at"))).otherwise(F.col("positions")))
    gone = hit.groupBy("id", "t64").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("gone"))
    return _without(docs, gone, id_col, text_col)


def _without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = fresh(own, "text_key")
    right = gone.select(F.col("id").alias(fresh(own, "gone_id")), F.col("t64").alias(fresh(own, "gone_key")), F.col("gone").alias(fresh(own, "gone")))
    gone_id, gone_key, at = (F.col(c) for c in right.columns)
    left = docs.select(*[F.col(f"`{c}`") for c in own], F.xxhash64(text).alias(key))
    all_ = left.join(right, F.col(f"`{id_col}`").eqNullSafe(gone_id) & (F.col(key) == gone_key), "left")
    lines = F.split(text, "\n", -1)
    # the runs of lines between those that go
    edges = F.concat(F.array(F.lit(-1)), at, F.array(F.size(lines)))
    runs = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.slice(lines, F.get(edges, i - 1) + 2, F.get(edges, i) - F.get(edges, i - 1) - 1))
    kept = F.when(at.isNull() | (F.size(at) == 0), text).otherwise(F.array_join(F.flatten(runs), "\n"))
    return all_.select(
        *[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in own],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _keys(column: pa.Array, min_chars: int) -> Iterator[tuple[int, dict[bytes, list[int]]]]:
    """(row, digest of each line's key to its positions)."""
    data, at = utf8(column)
    for i in range(len(at) - 1):
        found: dict[bytes, list[int]] = {}
        for n, line in enumerate(data[at[i] : at[i + 1]].tobytes().split(b"\n")):
            key = line.strip(b" \t\n\v\f\r").lower()
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                found.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(n)
        yield i, found


def _places(digests: bytes, bits: int) -> np.ndarray:
    """HASHES bit numbers for each 16-byte digest."""
    pair = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        at = pair[:, :1] + np.arange(HASHES, dtype=np.uint64) * (pair[:, 1:] | np.uint64(1))
    return (at & np.uint64(bits - 1)).astype(np.int64)


def _seen(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            for _, found in _keys(batch["text"], min_chars):
                held.append(b"".join(found))
                n_held += len(found)
                if n_held > HELD_LINES:
                    yield from _planes(b"".join(held), bits)
                    held, n_held = [], 0
        yield from _planes(b"".join(held), bits)

    return run


def _planes(digests: bytes, bits: int) -> Iterator[pa.RecordBatch]:
    at, n = np.unique(_places(digests, bits), return_counts=True)
    edges = np.searchsorted(at, np.arange((bits >> CHUNK_BITS) + 1) << CHUNK_BITS)
    for c in np.flatnonzero(np.diff(edges)):
        here = slice(edges[c], edges[c + 1])
        low = (at[here] & ((1 << CHUNK_BITS) - 1)).astype(np.uint32)
        yield _plane(int(c), TaskContext.get().partitionId(), low, low[n[here] > 1])


def _packed(positions: np.ndarray) -> np.ndarray:
    """A range's bits as a bitmap of 128 kB."""
    bitmap = np.zeros(1 << CHUNK_BITS, bool)
    bitmap[positions] = True
    return np.packbits(bitmap, bitorder="little")


def _sent(positions: np.ndarray) -> bytes:
    """Numbers of four bytes where those are shorter, else a bitmap."""
    return (positions.astype(np.uint32) if len(positions) * 32 < 1 << CHUNK_BITS else _packed(positions)).tobytes()


def _positions(sent) -> np.ndarray:
    if len(sent) == 1 << (CHUNK_BITS - 3):
        return np.flatnonzero(np.unpackbits(np.frombuffer(sent, np.uint8), bitorder="little"))
    return np.frombuffer(sent, np.uint32)


def _plane(chunk: int, part: int, once: np.ndarray, twice: np.ndarray):
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([_sent(once)], pa.binary()), pa.array([_sent(twice)], pa.binary())],
        ["chunk", "part", "once", "twice"],
    )


def _merged(table: pa.Table) -> pa.Table:
    """Filters over one range of bits: what several have once is seen twice."""
    n = np.zeros(1 << CHUNK_BITS, np.int32)
    for row in zip(table["once"], table["twice"], strict=True):
        for column in row:
            n[_positions(column.as_buffer())] += 1
    once, twice = (np.flatnonzero(n >= k) for k in (1, 2))
    return pa.Table.from_batches([_plane(table["chunk"][0].as_py(), table["part"][0].as_py(), once, twice)])


def _suspects(shared, bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in batches:
            row, digests, positions = [], [], []
            for i, found in _keys(batch["text"], min_chars):
                at = _places(b"".join(found), bits)
                hit = ((twice[at >> 3] >> (at & 7)) & 1).all(axis=1)
                for k, (digest, where) in enumerate(found.items()):
                    if hit[k]:
                        row.append(i)
                        digests.append(digest)
                        positions.append(where)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"].take(take), batch["t64"].take(take), pa.array(digests, pa.binary()), pa.array(positions, pa.list_(pa.int32()))], ["id", "t64", "digest", "positions"])

    return run


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key)
GROUP BY doc_id
"""
