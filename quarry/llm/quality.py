"""Quality scores of whole texts by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.bytewords import utf8
from quarry.llm.common import fresh, small_batches

WIDTH, STRIDE, CHUNK, EMBED, FILTERS = 8, 2, 512, 8, 24
#: A byte is marked as an echo when it ends SAME bytes that also stand up to FAR bytes before.
SAME, FAR = 6, 24
#: Chunks that are convolved at once.
BLOCK = 64


@dataclass
class ByteConv:
    """p = sigmoid(out . [max, mean and min over chunks] + bias), where a chunk's value of
    a filter is the largest over the chunk's windows of WIDTH bytes."""

    embed: np.ndarray  # 512, EMBED: bytes, then bytes that are an echo
    kernel: np.ndarray  # WIDTH, EMBED, FILTERS
    shift: np.ndarray  # FILTERS
    out: np.ndarray  # 3 * FILTERS
    bias: np.ndarray  # 1

    @classmethod
    def start(cls, seed: int, prior: float) -> ByteConv:
        r = np.random.default_rng(seed)
        f = lambda *shape: r.standard_normal(shape).astype(np.float32)
        return cls(f(512, EMBED) * 0.5, f(WIDTH, EMBED, FILTERS) * 0.25, np.zeros(FILTERS, np.float32), f(3 * FILTERS) * 0.1, np.full(1, np.log(prior / (1 - prior)), np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.shift, self.out, self.bias]

    def tables(self) -> np.ndarray:
        """What each input adds at each place of a window: WIDTH, 512, FILTERS."""
        return np.einsum("be,kef->kbf", self.embed, self.kernel).astype(np.float32)


def chunks_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of row for each chunk. Chunks begin CHUNK bytes apart and
    reach WIDTH bytes into the next one, so every window of a text lies in one; the last
    chunk of a text begins earlier, so as to be full too."""
    n = -(-np.diff(at) // CHUNK)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.minimum(at[row] + inside * CHUNK, np.maximum(at[row], at[row + 1] - CHUNK))
    return row, begin, at[row + 1]


def inputs(held: np.ndarray) -> np.ndarray:
    """Bytes, plus 256 where a byte is an echo within its chunk."""
    echo = np.zeros(held.shape, bool)
    for far in range(2, FAR + 1):
        same = held[:, far:] == held[:, :-far]
        same &= held[:, far:] > 0
        two = same[:, 1:] & same[:, :-1]
        four = two[:, 2:] & two[:, :-2]
        echo[:, far + SAME - 1 :] |= four[:, 2:] & two[:, : four.shape[1] - 2]
    return held + echo * np.int16(256)


def convolve(data: np.ndarray, begin: np.ndarray, end: np.ndarray, tables: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responses (chunks, windows, FILTERS), at least 0, and the chunks' inputs."""
    where = begin[:, None] + np.arange(CHUNK + WIDTH)
    held = np.where(where < end[:, None], data[np.minimum(where, len(data) - 1)], 0)
    held = inputs(held)
    total = np.tile(shift, (len(begin), CHUNK // STRIDE, 1))
    added = np.empty_like(total)
    for k in range(WIDTH):
        np.take(tables[k], held[:, k : k + CHUNK : STRIDE], axis=0, out=added, mode="clip")
        total += added
    np.maximum(total, 0, out=total)
    total *= (where[:, :CHUNK:STRIDE] < end[:, None])[:, :, None]
    return total, held


def features(data: np.ndarray, at: np.ndarray, tables: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """rows, 3 * FILTERS. Memory is that of BLOCK chunks, however long a text is."""
    rows = len(at) - 1
    most, total, least = np.zeros((rows, FILTERS), np.float32), np.zeros((rows, FILTERS)), np.full((rows, FILTERS), np.inf, np.float32)
    row, begin, end = chunks_of(data, at)
    for i in range(0, len(row), BLOCK):
        s = slice(i, i + BLOCK)
        pooled = convolve(data, begin[s], end[s], tables, shift)[0].max(axis=1)
        np.maximum.at(most, row[s], pooled)
        np.add.at(total, row[s], pooled)
        np.minimum.at(least, row[s], pooled)
    n = np.maximum(np.bincount(row, minlength=rows), 1)[:, None]
    return np.concatenate([most, (total / n).astype(np.float32), np.where(np.isinf(least), 0, least)], axis=1)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 16, rate: float = 0.01, weight: float = 3.0, seed: int = 7) -> ByteConv:
    """Adam on the log loss, the rarer label weighing weight times as much; gradients go
    through the pooled windows alone. Then the output layer is fitted again by Newton's
    method without weights, so that scores are shares."""
    prior = (labels.sum() + 1) / (len(labels) + 2)
    net = ByteConv.start(seed, prior)
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        return net
    rare = float(labels.mean() < 0.5)
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in net.arrays()]
    order, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        turn = order.permutation(len(texts))
        for i in range(0, len(turn), batch):
            pick = turn[i : i + batch]
            grads = gradients(net, [texts[j] for j in pick], labels[pick], np.where(labels[pick] == rare, weight, 1).astype(np.float32))
            step += 1
            pace = rate * (0.5 if epoch >= epochs * 2 // 3 else 1.0)
            for a, g, (m, v) in zip(net.arrays(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7) + pace * 1e-3 * a * (a is not net.bias)
    return calibrated(net, texts, labels)


def calibrated(net: ByteConv, texts: list[bytes], labels: np.ndarray, ridge: float = 0.5, steps: int = 12) -> ByteConv:
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x = np.concatenate([features(data, at, net.tables(), net.shift), np.ones((len(texts), 1))], axis=1)
    scale = np.maximum(x.std(axis=0), 1e-3)
    scale[-1] = 1
    x /= scale
    w = np.append(net.out, net.bias).astype(np.float64) * scale
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - labels) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(curve, slope)
        w -= move / max(1.0, float(np.abs(move).max()) / 4)
    w /= scale
    net.out, net.bias = w[:-1].astype(np.float32), w[-1:].astype(np.float32)
    return net


def gradients(net: ByteConv, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    tables, rows = net.tables(), len(texts)
    row, begin, end = chunks_of(data, at)
    pooled, best = np.zeros((len(row), FILTERS), np.float32), np.zeros((len(row), FILTERS), np.int64)
    read = np.zeros((WIDTH, len(row), FILTERS), np.int64)
    for i in range(0, len(row), BLOCK):
        s = slice(i, i + BLOCK)
        value, held = convolve(data, begin[s], end[s], tables, net.shift)
        best[s] = value.argmax(axis=1)
        pooled[s] = value.max(axis=1)
        for k in range(WIDTH):
            read[k, s] = np.take_along_axis(held, best[s] * STRIDE + k, axis=1)
    n = np.maximum(np.bincount(row, minlength=rows), 1)
    most = np.zeros((rows, FILTERS), np.float32)
    np.maximum.at(most, row, pooled)
    mean = np.zeros((rows, FILTERS), np.float32)
    np.add.at(mean, row, pooled)
    least = np.full((rows, FILTERS), np.inf, np.float32)
    np.minimum.at(least, row, pooled)
    least[np.isinf(least)] = 0
    every = np.concatenate([most, mean / n[:, None], least], axis=1)
    p = 1 / (1 + np.exp(-(every @ net.out + net.bias)))
    error = (weights * (p - labels) / rows).astype(np.float32)
    d_most, d_mean, d_least = np.split(error[:, None] * net.out, 3, axis=1)
    d_pooled = d_mean[row] / n[row, None] + d_most[row] * (pooled == most[row]) + d_least[row] * (pooled == least[row])
    d_pooled *= pooled > 0
    d_tables = np.zeros((WIDTH, 512, FILTERS), np.float32)
    for k in range(WIDTH):
        d_tables[k] = np.bincount((read[k] * FILTERS + np.arange(FILTERS)).ravel(), d_pooled.ravel(), 512 * FILTERS).reshape(512, FILTERS)
    return [
        np.einsum("kbf,kef->be", d_tables, net.kernel),
        np.einsum("be,kbf->kef", net.embed, d_tables),
        d_pooled.sum(axis=0),
        error @ every,
        error.sum(keepdims=True),
    ]


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from; a null id counts as one of them."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 3000, max_bytes: int = 16384) -> ByteConv:
    """Fits on labelled rows that are not held out.

    A bounded sample: the max_rows labels with the smallest hashed ids, of which the texts
    of max_bytes bytes or less are used (48 MB at most). Null labels are left out, null
    texts are empty. Without rows of both labels the network gives their share alone.
    """
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    given = given.where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    picked = given.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows).dropDuplicates(["id"])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).where(F.octet_length("text") <= max_bytes)
    rows = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label")).collect()
    rows.sort(key=lambda r: r["id"])
    return fit([r["text"].encode() for r in rows], np.array([r["label"] for r in rows], np.float32))


def score_quality(docs: DataFrame, net: ByteConv, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each whole text; null and empty texts have the
    score of no chunks. A column of that name is replaced, other columns stay."""
    own = [c for c in docs.columns if c.lower() != score_col.lower()]
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    text = fresh(own, "scored_text")
    frame = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text_col}`").cast("string").alias(text))
    schema = frame.drop(text).schema.add(score_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables()
        for batch in batches:
            data, at = utf8(batch[text])
            x = features(data, at, tables, model.shift).astype(np.float64)
            p = 1 / (1 + np.exp(-(x @ model.out.astype(np.float64) + model.bias)))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in own], pa.array(p)], [*own, score_col])

    return frame.mapInArrow(run, schema)


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    net = train_quality(docs, labels)
    scored = score_quality(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
