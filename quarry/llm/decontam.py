"""Benchmark leaks: latent semantic candidates, then subsequence and answer checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bytewords import mix, utf8, word_hashes
from quarry.llm.common import fresh, small_batches, staged

#: Words are runs of ASCII letters and digits and of the bytes of other characters.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Passages are WINDOW words, one every STEP words. Words are hashed to FEATURES.
WINDOW, STEP, FEATURES = 32, 16, 1 << 15
BUDGET = 1 << 21


@dataclass
class Latent:
    """embed: FEATURES x rank, each word's idf times its right singular vectors."""

    embed: np.ndarray

    def passages(self, features: np.ndarray) -> np.ndarray:
        """Latent unit vectors of a text's passages."""
        n = max(1, -(-len(features) // STEP))
        blocks = np.zeros((n + 1, self.embed.shape[1]), np.float32)
        if len(features):
            rows = self.embed[features]
            again, share = repeats(features)
            rows[again] *= share[:, None]
            blocks[:n] = np.add.reduceat(rows, np.arange(0, len(features), STEP), axis=0)
        both = blocks[:-1] + blocks[1:]
        both = both[: max(1, n - 1)]
        return both / np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-9)


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each text, whole."""
    data, at = utf8(column)
    row, n = 0, len(at) - 1
    while row < n:
        upto = max(row + 1, int(np.searchsorted(at, at[row] + BUDGET, "right")) - 1)
        hashes, words = word_hashes(data[at[row] : at[upto]], at[row : upto + 1] - at[row], APART)
        yield from ((row + i, hashes[words[i] : words[i + 1]]) for i in range(upto - row))
        row = upto


def features_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(FEATURES - 1)).astype(np.int64)


def repeats(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that their block of STEP words has had before, and what each still
    counts there: n equal words count as the root of n."""
    key = np.arange(len(features)) // STEP * FEATURES + features
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    nth = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    again, nth = order[~new], nth[~new]
    return again, (np.sqrt(nth + 1) - np.sqrt(nth)).astype(np.float32)


def sketch(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One pass over all passages of all texts (text, seed): a sketch of their count
    matrix, size x FEATURES, each feature's number of texts, and the number of texts.

    Each passage is added, with a random sign, to one random row of the sketch: a sparse
    random projection from the left, whose leading right singular vectors are about those
    of the whole matrix. Weights by feature can be put on afterwards. Each partition sends
    its own sketch (row by row, half precision, nonzero cells only where those are fewer);
    sums merge in two levels, so no task gets more than the root of the partitions."""
    columns = "row int, part int, at binary, held binary"
    local = texts.mapInArrow(_sketched(size), columns)
    fan = max(1, math.isqrt(texts.rdd.getNumPartitions()))
    met = local.groupBy("row", F.pmod("part", F.lit(fan)).alias("meet")).applyInArrow(_summed, columns)
    out = np.zeros((size + 2, FEATURES), np.float32)
    df, total = np.zeros(FEATURES), 0
    for row in met.groupBy("row").applyInArrow(_summed, columns).toLocalIterator():
        values = _cells(row["row"], size, row["at"], row["held"])
        if row["row"] == size:
            df = values
        elif row["row"] > size:
            total = int(values[0])
        else:
            out[row["row"]] = values
    return out[:size], df, total


def _sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size * FEATURES, np.float32)
        df = np.zeros(FEATURES)
        n = 0
        for batch in batches:
            seeds = mix(batch["seed"].to_numpy().view(np.uint64))
            for row, hashes in texts_of(batch["text"]):
                n += 1
                features = features_of(hashes)
                df[features] += 1  # once for each feature, however often it is there
                if not len(features):
                    continue
                counts = np.ones(len(features), np.float32)
                again, share = repeats(features)
                counts[again] = share
                # a block is part of the passage that it begins and of the one before
                blocks = -(-len(features) // STEP)
                passages = max(1, blocks - 1)
                dice = mix(np.arange(passages, dtype=np.uint64) + seeds[row])
                where = (dice >> np.uint64(1)) % np.uint64(size)
                sign = (dice & np.uint64(1)).astype(np.float32) * 2 - 1
                block = np.arange(len(features)) // STEP
                for shift in (0, 1) if blocks > 1 else (0,):
                    of = block - shift
                    keep = (of >= 0) & (of < passages)
                    np.add.at(cells, where[of[keep]].astype(np.int64) * FEATURES + features[keep], sign[of[keep]] * counts[keep])
        part = TaskContext.get().partitionId()
        for i, held in enumerate(cells.reshape(size, FEATURES)):
            if held.any():
                yield _sent(i, part, held, np.float16 if np.abs(held).max() <= 6e4 else np.float32)
        # counts of this precision are exact
        yield _sent(size, part, df, np.float16 if df.max() <= 2048 else np.float32 if df.max() <= 1 << 24 else np.float64)
        yield _sent(size + 1, part, np.array([n], np.float64), np.float64)

    return run


def _sent(row: int, part: int, values: np.ndarray, kind) -> pa.RecordBatch:
    """A row of numbers: the nonzero ones with their places, or all of them."""
    at = np.flatnonzero(values)
    if 2 * len(at) >= len(values):
        at = np.zeros(0, np.uint16)
    else:
        values = values[at]
    return pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([part], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([np.dtype(kind).char.encode() + values.astype(kind).tobytes()], pa.binary())], ["row", "part", "at", "held"])


def _cells(row: int, size: int, at, held) -> np.ndarray:
    out = np.zeros(FEATURES)
    values = np.frombuffer(held, held[:1].decode(), offset=1)
    if len(at):
        out[np.frombuffer(at, np.uint16)] = values
    else:
        out[: len(values)] = values
    return out


def _summed(table: pa.Table) -> pa.Table:
    row = table["row"][0].as_py()
    total = np.zeros(FEATURES)
    for at, held in zip(table["at"], table["held"], strict=True):
        total += _cells(row, 0, at.as_py(), held.as_py())
    # sums keep full precision; counts are whole numbers
    return pa.Table.from_batches([_sent(row, table["part"][0].as_py(), total, np.float64 if np.array_equal(total, np.floor(total)) else np.float32)])


def latent_of(cells: np.ndarray, idf: np.ndarray, rank: int) -> Latent:
    """The leading right singular vectors of the weighted sketch."""
    weighted = cells * idf.astype(np.float32)
    values, left = np.linalg.eigh((weighted @ weighted.T).astype(np.float64))
    order = np.argsort(-values)[:rank]
    order = order[values[order] > 1e-9 * max(values.max(initial=0), 1e-30)]
    right = weighted.T @ (left[:, order] / np.sqrt(values[order])).astype(np.float32)
    return Latent(idf.astype(np.float32)[:, None] * right)


def common_words(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of the item's positions."""
    places: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    whole = (1 << len(item)) - 1
    row = whole
    for word in region.tolist():
        if hit := places.get(word):
            row = (row + (row & hit)) | (row & ~hit)
            row &= whole
    return len(item) - row.bit_count()


def holds(region: np.ndarray, answer: np.ndarray) -> bool:
    """Whether the answer's words stand together somewhere in the region."""
    n = len(answer)
    if not n or len(region) < n:
        return False
    return bool(np.all([region[i : len(region) - n + 1 + i] == answer[i] for i in range(n)], axis=0).any())


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbouring words."""
    out = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for j in range(n):
        out = mix(out + hashes[j : j + len(out)])
    return out


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    size = end - begin
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Lookup:
    """Exact candidates: every passage around which an item can pass the checks.

    Verbatim: an item of n words may lack n - t of them, so that around the passage there
    are at least r - (n - t) places of its r rarest words (about half of it). Paraphrase:
    the answer's words stand there in one piece. Both are looked up in inverted indexes,
    so nothing depends on weights or on the latent space."""

    def __init__(self, items: list[np.ndarray], vocabulary: np.ndarray, idf: np.ndarray, verbatim: float, answer_words: int):
        rarity = idf[features_of(vocabulary)]
        self.sizes = np.array([len(w) for w in items], np.int64)
        self.need = np.zeros(len(items), np.int64)
        term, owner = [], []
        tails: dict[int, dict[int, list[int]]] = {}
        for i, item in enumerate(items):
            n = len(item)
            if not n:
                continue
            kinds, often = np.unique(np.searchsorted(vocabulary, item), return_counts=True)
            order = np.argsort(-rarity[kinds], kind="stable")
            held = np.cumsum(often[order])
            spared = n - int(np.ceil(verbatim * n - 1e-6))
            take = int(np.searchsorted(held, min(n, max(n // 2, spared + 1)))) + 1
            self.need[i] = held[take - 1] - spared
            term.append(kinds[order[:take]])
            owner.append(np.full(take, i))
            tail = min(n, answer_words)
            if tail:
                tails.setdefault(tail, {}).setdefault(int(rolled(item[-tail:], tail)[0]), []).append(i)
        term, self.owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (term, owner))
        order = np.argsort(term, kind="stable")
        self.owner = self.owner[order]
        self.begin = np.searchsorted(term[order], np.arange(len(vocabulary) + 2))
        self.tails = {n: (np.array(sorted(t), np.uint64), [t[k] for k in sorted(t)]) for n, t in tails.items()}

    def passages(self, hashes: np.ndarray, at: np.ndarray, possible: np.ndarray, n_passages: int) -> dict[int, np.ndarray]:
        """The passages of a text to check, by item."""
        found: dict[int, np.ndarray] = {}
        first = np.arange(n_passages) * STEP
        begin, end = self.begin[at], self.begin[at + 1]
        spot = np.repeat(np.arange(len(at)), end - begin)
        item = self.owner[ranges(begin, end)]
        keep = possible[item]
        spot, item = spot[keep], item[keep]
        order = np.argsort(item, kind="stable")
        spot, item = spot[order], item[order]
        bounds = np.searchsorted(item, np.arange(len(self.sizes) + 1))
        for i in np.flatnonzero((np.diff(bounds) >= self.need) & possible).tolist():
            here, need, n = spot[bounds[i] : bounds[i + 1]], max(int(self.need[i]), 1), int(self.sizes[i])
            if not (here[need - 1 :] - here[: len(here) - need + 1] < WINDOW + 2 * n).any():
                continue
            hits = np.flatnonzero(np.searchsorted(here, first + WINDOW + n) - np.searchsorted(here, first - n) >= need)
            if len(hits):
                found[i] = hits
        for tail, (known, owners) in self.tails.items():
            pieces = rolled(hashes, tail)
            if not len(pieces):
                continue
            place = np.minimum(np.searchsorted(known, pieces), len(known) - 1)
            spots: dict[int, list[int]] = {}
            for j in np.flatnonzero(known[place] == pieces).tolist():
                for i in owners[place[j]]:
                    if possible[i]:
                        spots.setdefault(i, []).append(j)
            for i, starts in spots.items():
                here, n = np.array(starts), int(self.sizes[i])
                hits = np.flatnonzero(np.searchsorted(here, first + WINDOW + n - tail, "right") > np.searchsorted(here, first - n))
                found[i] = np.union1d(found[i], hits) if i in found else hits
        return found


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rank: int = 96,
    least_cosine: float = 0.25,
    verbatim: float = 0.75,
    paraphrase: float = 0.5,
    answer_words: int = 4,
    sketch_rows: int = 192,
    block_items: int = 20000,
    second_look: bool = False,
) -> DataFrame:
    """Benchmark items in documents: id, text_hash (xxhash64 of the text), item_id,
    cosine, common_share, answer, first_word. One row per document and item.

    Every passage of every text (WINDOW words every STEP words) is compared with the
    passages of the items that the text has enough words of, in a latent space of rank
    dimensions; a cosine of least_cosine makes a candidate. With second_look so do an
    item's rarest words and its answer, which are looked up exactly (Lookup): then an item
    that passes the checks is found whatever its words weigh; the latent space alone has
    found all of these so far (README, tests). Items of which too many words are nowhere in the text can't pass the checks, nor can passages
    around which too many are missing. It is a leak if the longest common subsequence of
    the item and the text around the passage has the share verbatim of the item's words,
    or the share paraphrase and the item's answer, its last answer_words words, in one
    piece.

    The latent space is a randomised SVD of the TF-IDF passages of all texts: one pass
    counts each word's texts and adds every passage to a sketch of sketch_rows rows (see
    sketch), whose leading right singular vectors span the space. The benchmark is a
    stated query set: it is taken in blocks of block_items items, of which each is
    broadcast and takes a pass over the texts. Null and empty texts and items hold no
    words and match nothing; rows with the same id and text give one row for each item;
    rows of the benchmark that share an item_id give one row; null ids stay null; other
    columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    cells, df, total = sketch(rows.select("text", F.xxhash64("id", "text").alias("seed")), sketch_rows)
    # above zero for every word
    idf = np.log((total + 1) / (df + 0.5))
    latent = latent_of(cells, idf, rank)
    blocks = max(1, -(-items.count() // block_items))
    dealt = items if blocks == 1 else staged(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "items")
    kind, item_kind = dict(rows.dtypes)["id"], dict(items.dtypes)["item"]
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    parts = []
    for block in range(blocks):
        known = (dealt if blocks == 1 else dealt.where(F.col("block") == block).select("item", "text")).toArrow()
        words = [h for _, h in texts_of(known["text"].combine_chunks())] if known.num_rows else []
        shared = spark.sparkContext.broadcast((latent, words, idf))
        found = hashed.mapInArrow(_matches(shared, least_cosine, verbatim, paraphrase, answer_words, second_look), f"id {kind}, text_hash long, item int, cosine double, common_share double, answer boolean, first_word long")
        named = spark.createDataFrame([(i, v) for i, v in enumerate(known["item"].to_pylist())], f"item int, named {item_kind}")
        parts.append(found.join(F.broadcast(named), "item").drop("item"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = every.groupBy("id", "text_hash", "named").agg(F.max(F.struct("common_share", "cosine", "answer", "first_word")).alias("best"))
    return best.select(F.col("id").alias(id_col), "text_hash", F.col("named").alias(item_col), "best.cosine", "best.common_share", "best.answer", "best.first_word")


def _matches(shared, least_cosine: float, verbatim: float, paraphrase: float, answer_words: int, second_look: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent, words, idf = shared.value
        vectors = [latent.passages(features_of(w)) for w in words]
        item_of = np.repeat(np.arange(len(words)), [len(v) for v in vectors])
        sides = np.concatenate(vectors).T.copy() if vectors else np.zeros((latent.embed.shape[1], 0), np.float32)
        vocabulary, places = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_inverse=True)
        lengths = np.array([len(w) for w in words], np.int64)
        bounds, tails = np.concatenate([[0], np.cumsum(lengths)]), np.minimum(lengths, answer_words)
        sure, maybe = verbatim * lengths - 1e-6, paraphrase * lengths - 1e-6
        own = np.full(len(vocabulary) + 1, -1)
        kinds_of = []
        for a, b, tail in zip(bounds[:-1], bounds[1:], tails, strict=True):
            kinds, often = np.unique(places[a:b], return_counts=True)
            kinds_of.append((kinds, often, np.searchsorted(kinds, places[b - tail : b])))
        # a word's number by its low bits; where several share them it is searched for
        slot, crowded = np.full(1 << 18, len(vocabulary)), np.zeros(1 << 18, bool)
        low = (vocabulary & np.uint64(len(slot) - 1)).astype(np.int64)
        slot[low] = np.arange(len(vocabulary))
        crowded[low[slot[low] != np.arange(len(vocabulary))]] = True
        # the words of the items that have any, and of their answers (the place behind the vocabulary is always there)
        some = np.flatnonzero(lengths)
        starts = bounds[some]
        ends = np.full((len(words), max(answer_words, 1)), len(vocabulary))
        for i in some.tolist():
            ends[i, : tails[i]] = places[bounds[i + 1] - tails[i] : bounds[i + 1]]
        lookup = Lookup(words, vocabulary, idf, verbatim, answer_words) if second_look else None
        sides_of = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int64)
        for batch in batches:
            got: list[tuple] = []
            for row, hashes in texts_of(batch["text"]):
                if not len(hashes) or not len(vocabulary):
                    continue
                low = (hashes & np.uint64(len(slot) - 1)).astype(np.int64)
                at = slot[low]
                other = vocabulary[np.minimum(at, len(vocabulary) - 1)] != hashes
                at[other] = len(vocabulary)
                if len(again := np.flatnonzero(other & crowded[low])):
                    near = np.minimum(np.searchsorted(vocabulary, hashes[again]), len(vocabulary) - 1)
                    at[again] = np.where(vocabulary[near] == hashes[again], near, len(vocabulary))
                there = np.zeros(len(vocabulary) + 1, bool)
                there[at] = True
                most = np.zeros(len(words), np.int64)
                most[some] = np.add.reduceat(there[places].view(np.uint8), starts, dtype=np.int64)
                possible = (lengths > 0) & (most >= maybe)
                if not possible.any():
                    continue
                there[-1] = True
                possible &= (most >= sure) | there[ends].all(axis=1)
                if not possible.any():
                    continue
                passages = latent.passages(features_of(hashes))
                own_sides = np.flatnonzero(possible[item_of])
                exact = lookup.passages(hashes, at, possible, len(passages)) if lookup else {}
                best: dict[int, tuple] = {}
                for top in range(0, len(passages), 4096):
                    cosine = passages[top : top + 4096] @ sides[:, own_sides]
                    near = cosine >= least_cosine
                    alike = np.unique(item_of[own_sides[near.any(axis=0)]]).tolist()
                    for i in sorted({*alike, *exact}):
                        item, n, tail = words[i], len(words[i]), int(tails[i])
                        its = slice(*np.searchsorted(own_sides, sides_of[i : i + 2]))
                        wanted = near[:, its].any(axis=1)
                        sought = exact.get(i, np.zeros(0, np.int64)) - top
                        wanted[sought[(sought >= 0) & (sought < len(wanted))]] = True
                        passage = np.flatnonzero(wanted)
                        if not len(passage):
                            continue
                        begin, end = np.maximum((top + passage) * STEP - n, 0), (top + passage) * STEP + WINDOW + n
                        # only words of the item count, each as often as the item has it
                        kinds, often, tail_kinds = kinds_of[i]
                        own[kinds] = np.arange(len(kinds))
                        spots = np.flatnonzero(own[at[begin[0] : end[-1]]] >= 0) + begin[0]
                        so_far = np.zeros((len(kinds), len(spots) + 1), np.int32)
                        so_far[own[at[spots]], np.arange(1, len(spots) + 1)] = 1
                        own[kinds] = -1
                        np.cumsum(so_far, axis=1, out=so_far)
                        low, high = np.searchsorted(spots, begin), np.searchsorted(spots, end)
                        held = so_far[:, high] - so_far[:, low]
                        at_most = np.minimum(held, often[:, None]).sum(axis=0)
                        enough = np.flatnonzero((at_most >= sure[i]) | ((at_most >= maybe[i]) & (held[tail_kinds] > 0).all(axis=0)))
                        for p, a, b in zip(passage[enough].tolist(), low[enough].tolist(), high[enough].tolist(), strict=True):
                            first = (top + p) * STEP
                            region = hashes[max(0, first - n) : first + WINDOW + n]
                            share = common_words(item, hashes[spots[a:b]]) / n
                            if share < paraphrase or (i in best and share <= best[i][3]):
                                continue
                            answer = holds(region, item[-tail:])
                            if share >= verbatim or answer:
                                best[i] = (row, i, float(cosine[p, its].max()), share, answer, first)
                got += best.values()
            row, item, cosine, share, answer, first = (list(x) for x in zip(*got, strict=True)) if got else ([] for _ in range(6))
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(rows), batch["hash"].take(rows), pa.array(item, pa.int32()), pa.array(cosine, pa.float64()), pa.array(share, pa.float64()), pa.array(answer, pa.bool_()), pa.array(first, pa.int64())],
                ["id", "text_hash", "item", "cosine", "common_share", "answer", "first_word"],
            )

    return run


def without_leaks(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that find_leaks found something in; all columns stay."""
    gone_id, gone_hash = fresh(docs.columns, "leak_id"), fresh(docs.columns, "leak_hash")
    gone = leaks.select(F.col(id_col).alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct()
    text_hash = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)) & (text_hash == F.col(gone_hash)), "left_anti")


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = find_leaks(docs, benchmark)
    return out.select("doc_id", "item_id", F.round("common_share", 6).alias("common_share"), "answer")
