"""Sequences of related documents, by sharded BM25 retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, staged
from quarry.llm.tokens import tokenizer

K1, B = 1.2, 0.75
#: Documents of a partition from which its borders are taken, about.
SAMPLED = 100
TOLD = "id {kind}, ids binary, rank long, part int"
PIECE = "doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    end_id: int = 2,
    shard_docs: int = 512,
    shard_tokens: int = 1 << 21,
    common_share: float = 0.5,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned 32-bit, little-endian),
    doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text and end_id; a null or empty text has
    end_id alone. Each id lies in exactly one piece, sequences hold at most window ids
    and no padding: all are full, but for the last ids of each partition, which go to
    sequences of lengths that are powers of two. Repeated rows are documents of their
    own, null ids stay null, other columns are ignored; an empty table gives no pieces.

    Documents are dealt by their two most telling tokens, of the highest BM25 weights, and
    then by their ids, so that related ones are neighbours in a partition and equal ones
    stand together; where all that is equal, rows are spread over the partitions that
    begin or end there. They are taken in shards of
    shard_docs documents or shard_tokens ids; a seed finds neighbours in its own shard. Each shard has an inverted index with BM25 weights;
    document frequencies come from all documents, one number for each of the tokenizer's
    ids. A seed document opens a window and its unused neighbours fill it in the order
    of their scores against the seed's whole text; the last one is cut to fit, and its
    rest seeds the next window. Parts of window ids that a document fills alone are
    sequences at once. What a shard can't fill goes on to the next. Tokens of more than
    common_share of all documents (half of them, where the classic weight is negative)
    tell nothing and are not indexed. Ids are held in 16 bits: a tokenizer with more ids
    is refused.
    """
    kind = dict(docs.select(F.col(f"`{id_col}`").alias("id")).dtypes)["id"]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    spark = docs.sparkSession
    small_batches(spark)
    tokens = staged(rows.mapInArrow(_encoded(tokenizer_path, end_id), f"id {kind}, ids binary"), "tokens")
    df = np.zeros(1 << 16)
    counted = tokens.select("ids").mapInArrow(_frequencies, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    for row in counted.toLocalIterator():  # one row per id of the tokenizer at most
        df[row["token"]] = row["n"]
    total = tokens.count()
    length = (tokens.select(F.avg(F.length("ids") / 2)).first()[0]) or 1.0
    weight = np.log1p((total - df + 0.5) / (df + 0.5))
    dealing = spark.sparkContext.broadcast(weight.copy())
    weight[df > common_share * max(total, 8)] = 0
    shared = spark.sparkContext.broadcast(weight)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = tokens.select("id", "ids", F.xxhash64("ids").alias("equal"))
    # only borders of partitions come from a sample, all documents are dealt
    some = keyed.sample(min(1.0, SAMPLED * parts / max(total, 1)), seed=1).mapInArrow(_told(dealing, []), TOLD.format(kind=kind)).select("rank")
    ranks = np.sort(np.array([row["rank"] for row in some.collect()], np.int64))  # SAMPLED a partition
    borders = ranks[np.arange(1, parts) * len(ranks) // parts] if len(ranks) else ranks
    told = keyed.mapInArrow(_told(dealing, borders), TOLD.format(kind=kind))
    dealt = told.repartitionById(parts, "part").sortWithinPartitions("rank").drop("part", "rank")
    return dealt.mapInArrow(_packed(shared, length, window, shard_docs, shard_tokens), PIECE.format(kind=kind)).withColumnRenamed("doc_id", id_col)


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        end = np.array([end_id], np.uint16).tobytes()
        for batch in batches:
            ids = [row.tobytes() + end for row in coder.rows(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(ids, pa.binary())], ["id", "ids"])

    return run


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in column]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for ids in _ids(batch["ids"]):
            here = np.zeros(1 << 16, bool)
            here[ids] = True
            n += here
    token = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int32)), pa.array(n[token])], ["token", "n"])


def _told(shared, borders):
    """Adds each document's rank (its two most telling tokens, then its ids' hash) and the
    partition between whose borders that lies; several with the same border share its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        chance = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            terms = []
            for ids in _ids(batch["ids"]):
                here, n = np.unique(ids, return_counts=True)
                score = weight[here] * n / (n + K1)
                first = int(np.argmax(score))
                score[first] = -1
                terms.append((int(here[first]) << 16) + int(here[np.argmax(score)]))
            rank = (np.array(terms, np.int64) << 31) + (batch["equal"].to_numpy().view(np.uint64) >> np.uint64(33)).astype(np.int64)
            low, high = np.searchsorted(borders, rank, "left"), np.searchsorted(borders, rank, "right")
            part = chance.integers(low, high, endpoint=True)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["ids"], pa.array(rank), pa.array(part.astype(np.int32))], ["id", "ids", "rank", "part"])

    return run


class Shard:
    """The inverted index of some documents: postings by token, with BM25 weights."""

    def __init__(self, docs: list[np.ndarray], weight: np.ndarray, mean: float):
        self.n = len(docs)
        token, doc, tf = [], [], []
        for i, ids in enumerate(docs):
            here, n = np.unique(ids, return_counts=True)
            keep = weight[here] > 0
            token.append(here[keep])
            doc.append(np.full(int(keep.sum()), i))
            tf.append(n[keep] / (n[keep] + K1 * (1 - B + B * len(ids) / mean)))
        self.terms = token
        flat, self.doc, tf = (np.concatenate(x) if x else np.zeros(0) for x in (token, doc, tf))
        order = np.argsort(flat, kind="stable")
        flat, self.doc = flat[order].astype(np.int64), self.doc[order]
        self.score = tf[order] * weight[flat] * (K1 + 1)
        self.begin = np.searchsorted(flat, np.arange((1 << 16) + 1))

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents by falling score against all of the seed's tokens."""
        begin, end = self.begin[self.terms[seed]], self.begin[self.terms[seed].astype(np.int64) + 1]
        size = end - begin
        ends = np.cumsum(size)
        at = np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        scores = np.bincount(self.doc[at].astype(np.int64), self.score[at], self.n)
        return np.argsort(-scores, kind="stable")


class Packer:
    """Fills windows from one partition's documents, shard by shard."""

    def __init__(self, window: int, first: int):
        self.window, self.sequence = window, first
        self.pieces: list[tuple] = []
        self.rest: list[list] = []  # document, its ids, where its unused ids begin

    def put(self, entry: list, n: int, offset: int) -> None:
        doc, ids, start = entry
        self.pieces.append((doc, start, n, ids[start : start + n].astype("<u4").tobytes(), len(ids), self.sequence, offset))
        entry[2] += n

    def shard(self, docs: list[list], weight: np.ndarray, mean: float) -> None:
        for entry in docs:
            while len(entry[1]) - entry[2] >= self.window:
                self.put(entry, self.window, 0)
                self.sequence += 1
        docs = self.rest + [d for d in docs if d[2] < len(d[1])]
        index = Shard([d[1] for d in docs], weight, mean)
        free = np.ones(len(docs), bool)
        left = sum(len(d[1]) - d[2] for d in docs)
        seed = 0
        while left >= self.window:
            while not free[seed]:
                seed = (seed + 1) % len(docs)
            filled = 0
            for i in [seed, *index.neighbours(seed)]:
                if free[i]:
                    n = min(self.window - filled, len(docs[i][1]) - docs[i][2])
                    self.put(docs[i], n, filled)
                    filled += n
                    free[i] = docs[i][2] < len(docs[i][1])
                    if filled == self.window:
                        seed = int(i)
                        break
            self.sequence += 1
            left -= self.window
        self.rest = [d for d, f in zip(docs, free, strict=True) if f]

    def finish(self) -> None:
        left = sum(len(d[1]) - d[2] for d in self.rest)
        for k in range(left.bit_length() - 1, -1, -1):
            if left >> k & 1:
                filled = 0
                while filled < 1 << k:
                    entry = self.rest[0]
                    n = min((1 << k) - filled, len(entry[1]) - entry[2])
                    self.put(entry, n, filled)
                    filled += n
                    if entry[2] == len(entry[1]):
                        self.rest.pop(0)
                self.sequence += 1

    def taken(self, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*self.pieces, strict=True)) if self.pieces else [[] for _ in range(7)]
        kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        self.pieces = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def _packed(shared, mean: float, window: int, shard_docs: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        held, size, kind = [], 0, pa.int64()
        for batch in batches:
            kind = batch["id"].type
            for doc, ids in zip(batch["id"].to_pylist(), _ids(batch["ids"]), strict=True):
                held.append([doc, ids, 0])
                size += len(ids)
                if len(held) >= shard_docs or size >= shard_tokens:
                    packer.shard(held, weight, mean)
                    held, size = [], 0
                    yield packer.taken(kind)
        packer.shard(held, weight, mean)
        packer.finish()
        yield packer.taken(kind)

    return run


def packing_query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    out = pack_documents(docs, tokenizer_path)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
