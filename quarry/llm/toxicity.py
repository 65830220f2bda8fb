"""Severity of toxic language by cumulative-link ordinal regression on sparse features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bytewords import utf8, word_hashes
from quarry.llm.common import fresh, small_batches
from quarry.llm.quality import held_out

#: Words are runs of letters: ASCII letters and all bytes of other characters.
APART = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
PREFIXES = (4, 5, 6)
#: Grades: 0 is clean; the others follow from labels and evidence (see graded).
GRADES = 4
BUDGET = 1 << 21


@dataclass
class Severity:
    """P(grade > k) = sigmoid(weights . x - cuts[k]): one weight for each feature, shared
    by all cuts. x holds log(1 + occurrences) of each feature and log(1 + words)."""

    features: np.ndarray  # sorted hashes of words and of their first bytes
    weights: np.ndarray  # one for each feature, then that of the length
    cuts: np.ndarray  # GRADES - 1, rising

    def above(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.cuts, -40, 40)))


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of rows: first row, number of rows, hashes (words, 1 + prefixes), offsets."""
    data, at = utf8(column)
    row, n = 0, len(at) - 1
    while row < n:
        upto = max(row + 1, int(np.searchsorted(at, at[row] + BUDGET, "right")) - 1)
        hashes, words = word_hashes(data[at[row] : at[upto]], at[row : upto + 1] - at[row], APART, PREFIXES)
        yield row, upto - row, hashes, words
        row = upto


def matrix(column: pa.Array, features: np.ndarray) -> np.ndarray:
    x = np.zeros((len(column), len(features) + 1), np.float32)
    for row, n, hashes, words in words_of(column):
        doc = np.repeat(np.arange(row, row + n), np.diff(words))
        for k in range(hashes.shape[1]):
            if len(features):
                at = np.minimum(np.searchsorted(features, hashes[:, k]), len(features) - 1)
                hit = features[at] == hashes[:, k]
                np.add.at(x, (doc[hit], at[hit]), 1)
        x[row : row + n, -1] = np.diff(words)
    return np.log1p(x)


def telling(column: pa.Array, toxic: np.ndarray, most: int, least_docs: int = 4) -> np.ndarray:
    """The features whose shares in toxic and clean texts differ most, by log odds."""
    tokens, kinds = [], []
    for row, n, hashes, words in words_of(column):
        doc = np.repeat(np.arange(row, row + n), np.diff(words))
        for k in range(hashes.shape[1]):
            pair = np.unique(np.stack([hashes[:, k], doc.astype(np.uint64)], axis=1), axis=0)
            tokens.append(pair[:, 0])
            kinds.append(toxic[pair[:, 1].astype(np.int64)])
    flat, kind = np.concatenate(tokens), np.concatenate(kinds)
    unique, back = np.unique(flat, return_inverse=True)
    a, b = np.bincount(back[kind > 0], minlength=len(unique)), np.bincount(back[kind == 0], minlength=len(unique))
    odds = np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((1 - toxic).sum() + 1))
    value = np.where((a + b >= least_docs) & (unique > 0) & (odds > 0), odds * np.sqrt(a), 0)
    best = np.argsort(-value, kind="stable")[:most]
    return np.sort(unique[best[value[best] > 0]])


def graded(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades of training rows. Labels tell toxic rows only; among these the grade rises
    with the number of occurrences of telling features, by thirds."""
    evidence = np.expm1(x[:, :-1]).sum(axis=1)
    cuts = np.quantile(evidence[toxic > 0], [1 / 3, 2 / 3]) if toxic.any() else [0, 0]
    return np.where(toxic > 0, 1 + (evidence > cuts[0]) + (evidence > cuts[1]), 0)


def fit(x: np.ndarray, grade: np.ndarray, steps: int = 400, rate: float = 0.05, ridge: float = 5e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising cuts by Adam on the mean log likelihood of the grades."""
    above = (grade[:, None] > np.arange(GRADES - 1)).astype(np.float64)
    share = (above.sum(axis=0) + 0.5) / (len(grade) + 1)
    w, first = np.zeros(x.shape[1]), np.array([np.log(1 / share[0] - 1)])
    gaps = np.full(GRADES - 2, -1.0)
    params = [w, first, gaps]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    x64 = x.astype(np.float64)
    for step in range(1, steps + 1):
        cuts = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        p = 1 / (1 + np.exp(-np.clip((x64 @ w)[:, None] - cuts, -40, 40)))
        edge = np.concatenate([np.ones((len(x), 1)), p, np.zeros((len(x), 1))], axis=1)
        chance = np.maximum(edge[np.arange(len(x)), grade] - edge[np.arange(len(x)), grade + 1], 1e-12)
        slope = np.concatenate([np.zeros((len(x), 1)), p * (1 - p), np.zeros((len(x), 1))], axis=1)
        low, high = slope[np.arange(len(x)), grade] / chance, slope[np.arange(len(x)), grade + 1] / chance
        d_cut = np.zeros(GRADES - 1)
        np.add.at(d_cut, np.maximum(grade - 1, 0), np.where(grade > 0, low, 0))
        np.add.at(d_cut, np.minimum(grade, GRADES - 2), np.where(grade < GRADES - 1, -high, 0))
        d_cut /= len(x)
        tail = np.cumsum(d_cut[::-1])[::-1]
        grads = [-(x64.T @ (low - high)) / len(x) + ridge * w, np.array([tail[0]]), tail[1:] * np.exp(gaps)]
        for a, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def train_severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 6000, max_bytes: int = 16384, max_features: int = 1000) -> Severity:
    """Fits on labelled rows that are not held out: the max_rows labels with the smallest
    hashed ids, of which the texts of max_bytes bytes or less are used (96 MB at most).
    Null labels are left out, null texts are empty. Without toxic rows nothing is toxic.
    """
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    given = given.where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    picked = given.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows).dropDuplicates(["id"])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).where(F.octet_length("text") <= max_bytes)
    rows = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label")).toArrow().sort_by("id")
    toxic = rows["label"].to_numpy().astype(np.int64)
    column = rows["text"].combine_chunks()
    if not toxic.any():
        return Severity(np.zeros(0, np.uint64), np.zeros(1), np.full(GRADES - 1, 40.0))
    features = telling(column, toxic, max_features)
    x = matrix(column, features)
    return Severity(features, *fit(x, graded(x, toxic)))


def score_severity(docs: DataFrame, model: Severity, text_col: str = "text", flag_at: float = 0.3) -> DataFrame:
    """docs with expected_severity (0 to GRADES - 1), severity (the likeliest grade) and
    toxic (1 where a grade above 0 has probability flag_at or more) for each whole text.

    Null and empty texts have the severity of no words. Columns of these names are
    replaced; other columns stay.
    """
    added = ("expected_severity", "severity", "toxic")
    own = [c for c in docs.columns if c.lower() not in added]
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = fresh(own, "scored_text")
    frame = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text_col}`").cast("string").alias(text))
    schema = frame.drop(text).schema.add("expected_severity", "double").add("severity", "integer").add("toxic", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                above = known.above(matrix(batch[text], known.features).astype(np.float64))
                edge = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
                grade = (edge[:, :-1] - edge[:, 1:]).argmax(axis=1).astype(np.int32)
                values = [pa.array(above.sum(axis=1)), pa.array(grade), pa.array((above[:, 0] >= flag_at).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in own], *values], [*own, *added])

    return frame.mapInArrow(run, schema)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train_severity(docs, labels)
    scored = score_severity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_severity", "severity", "toxic")
