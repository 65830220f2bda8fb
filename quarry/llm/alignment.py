"""Cross-tokenizer alignment: where two tokenizers cut whole texts at the same bytes."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, staged
from quarry.llm.tokens import BYTE_LEVEL

#: Text of so many characters is aligned at once.
CHUNK = 4 << 20
#: A worker forgets its segments once they hold so many characters of text, some 300 MB.
REMEMBERED = 6 << 20
#: Salts of the first shuffle of pairs.
SALTS = 16
#: A segment ends where a space, not the last character, follows one that isn't white space.
EDGE = re.compile(r"(?<=\S)(?= .)", re.S)
#: White space before a space: only then are segments more than the parts between spaces.
WIDE = re.compile(r"\s ").search
BYTE = re.compile(r"<0x([0-9A-F]{2})>").fullmatch
NONE = np.zeros(0, np.int64)


class Vocabulary:
    """The bytes of each token, one after the other, and where they begin."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.comma = np.array([f"{i}," for i in range(len(tokens))], object)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.begin[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def byte_level(path: str):
    """An encoder of lists of segments by a byte-level tokenizers file, which gives all ids
    and how many each segment has, and its vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(path)
    inner.encode_special_tokens = True
    shown = {256 + i: b for b, i in ((b, i - 256) for b, i in BYTE_LEVEL.items())}
    names = [inner.id_to_token(i) or "" for i in range(inner.get_vocab_size())]
    vocabulary = Vocabulary([bytes(shown.get(ord(c), ord(c) & 0xFF) for c in name) for name in names])

    def encode(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # segments that end in other than white space are encoded as one text: their ends cut tokens
        runs, first = [], 0
        for i in [*[i for i, s in enumerate(segments) if s[-1:].isspace() or not s], len(segments)]:
            runs += [" " + " ".join(segments[first:i])] * (i > first) + [" " + s for s in segments[i : i + 1]]
            first = i + 1
        ids = np.array([x for e in inner.encode_batch_fast(runs, add_special_tokens=False) for x in e.ids], np.int64)
        ends = np.cumsum([len(s.encode()) + 1 for s in segments])
        return ids, np.diff(np.searchsorted(np.cumsum(vocabulary.size[ids]), ends, "right"), prepend=0)

    return encode, vocabulary


def pieces(path: str):
    """The same for a sentencepiece model, which adds the space in front."""
    import sentencepiece

    inner = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [inner.id_to_piece(i) for i in range(inner.get_piece_size())]
    if any("▁" in name.lstrip("▁") for name in names):
        raise ValueError(f"{path} has pieces that go on past a space: texts can't be taken apart at spaces")
    decoded = [bytes([int(m[1], 16)]) if (m := BYTE(name)) else name.replace("▁", " ").encode() for name in names]

    def encode(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = inner.encode(segments, num_threads=1)
        return np.array([x for some in ids for x in some], np.int64), np.array([len(some) for some in ids], np.int64)

    return encode, Vocabulary(decoded)


def segments(text: str) -> list[str]:
    """space + text, cut before each space that follows a character other than white
    space, without the space that each segment begins with."""
    if text[0] != " " and text[-1] != " " and not WIDE(text):
        return text.split(" ")
    return [s[1:] for s in EDGE.split(" " + text)]


class Aligner:
    """Aligns texts segment by segment; each distinct segment is encoded once.

    Neither tokenizer has a token that goes on past a segment's end: the byte-level one
    splits text there before it merges, and no piece holds a space after another character.
    So a segment's end is always a common cut, and a text's tokens, groups and links are
    those of its segments one after the other.
    """

    def __init__(self, a_path: str, b_path: str):
        (self.encode_a, self.a), (self.encode_b, self.b) = byte_level(a_path), pieces(b_path)
        self.pipe = np.array([f"{i}|" for i in range(len(self.a.size))], object)
        self.semicolon = np.array([f"{i};" for i in range(len(self.b.size))], object)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.held = 0
        self.counts = np.zeros((0, 4), np.int64)  # of tokens of A, of B, of groups, of links; -1: the bytes differ
        self.codes, self.begin = np.zeros(0, np.uint64), NONE

    def learn(self, new: list[str]) -> None:
        """Tokens, groups and links of segments, all in one pass of numpy."""
        raw = [(" " + s).encode() for s in new]
        (a, n_a), (b, n_b) = self.encode_a(new), self.encode_b(new)
        good = self.equal(raw, a, n_a, self.a) & self.equal(raw, b, n_b, self.b)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)

        a_end, b_end = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        cuts = np.intersect1d(a_end[np.diff(a_end, prepend=0) > 0], b_end[np.diff(b_end, prepend=0) > 0], assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)

        # links: each token of A that ends at a cut with each of B that does
        a_first, b_first = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
        a_many, b_many = np.searchsorted(a_end, cuts, "right") - a_first, np.searchsorted(b_end, cuts, "right") - b_first
        links = a_many * b_many
        at = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
        left = a[np.repeat(a_first, links) + at // np.repeat(b_many, links)]
        right = b[np.repeat(b_first, links) + at % np.repeat(b_many, links)]

        # each group as written: its tokens of A, then those of B
        last_a, last_b = np.diff(a_group, append=-1) != 0, np.diff(b_group, append=-1) != 0
        shown = np.concatenate([np.where(last_a, self.pipe[a], self.a.comma[a]), np.where(last_b, self.semicolon[b], self.b.comma[b])])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        shown = shown[order].tolist()

        ends = np.cumsum([len(r) if g else 0 for r, g in zip(raw, good, strict=True)])
        upto = np.searchsorted(cuts, ends, "right")
        n_groups = np.diff(upto, prepend=0)
        n_links = np.diff(np.concatenate([[0], np.cumsum(links)])[upto], prepend=0)
        shown_upto = np.cumsum(n_a + n_b)
        self.groups += ["".join(shown[e - n : e]) for e, n in zip(shown_upto.tolist(), (n_a + n_b).tolist(), strict=True)]
        self.begin = np.concatenate([self.begin, len(self.codes) + np.cumsum(n_links) - n_links])
        self.codes = np.concatenate([self.codes, left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)])
        counts = np.stack([n_a, n_b, n_groups, n_links], axis=1)
        counts[~good] = -1
        self.counts = np.concatenate([self.counts, counts])

    @staticmethod
    def equal(raw: list[bytes], ids: np.ndarray, n: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """Whether the joined bytes of a segment's tokens are the segment's."""
        size = np.array([len(r) for r in raw], np.int64)
        ends = np.concatenate([[0], np.cumsum(vocabulary.size[ids])])[np.cumsum(n)]
        same = np.diff(ends, prepend=0) == size
        if same.all():
            differ = np.flatnonzero(vocabulary.bytes_of(ids) != np.frombuffer(b"".join(raw), np.uint8))
            same[np.searchsorted(ends, differ, "right")] = False
            return same
        joined, begin = vocabulary.bytes_of(ids).tobytes(), np.concatenate([[0], ends])
        return np.array([joined[begin[i] : begin[i + 1]] == r for i, r in enumerate(raw)])

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
        """Counts, groups as written and link codes (a << 32 | b) of each text."""
        if self.held > REMEMBERED:
            self.forget()
        found, edge = [], [0]
        for text in texts:
            parts = segments(text) if text else []
            for part in parts:
                if part not in self.index:
                    self.index[part] = len(self.index)
                    self.held += len(part) + 1
            found += [self.index[part] for part in parts]
            edge.append(len(found))
        if len(self.index) > len(self.groups):
            self.learn(list(self.index)[len(self.groups) :])
        at, edge = np.array(found, np.int64), np.array(edge)
        total = np.zeros((len(texts), 4), np.int64)
        good = np.diff(np.concatenate([[0], np.cumsum(self.counts[at, 0] < 0)])[edge]) == 0
        for k in range(4):
            total[:, k] = np.where(good, np.diff(np.concatenate([[0], np.cumsum(self.counts[at, k])])[edge]), 0)
        groups, links = [], []
        for i in range(len(texts)):
            here = at[edge[i] : edge[i + 1]] if good[i] else NONE
            groups.append("".join([self.groups[j] for j in here.tolist()])[:-1])
            n = self.counts[here, 3]
            ends = np.cumsum(n)
            links.append(self.codes[np.repeat(self.begin[here] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)])
        return total, groups, links


_made: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """This worker's aligner, which keeps its segments between tasks."""
    if (a_path, b_path) not in _made:
        _made[a_path, b_path] = Aligner(a_path, b_path)
    return _made[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """For each row of docs: id, n_a, n_b, n_groups, n_links, groups_sha256, link_codes and
    link_counts (the distinct id pairs among its links, as little-endian 64-bit numbers
    a << 32 | b in rising order, and how often each occurs); with_groups adds groups, the
    groups as written: `a1,a2|b1;a3|b2,b3`.

    a_path is a byte-level file of tokenizers, b_path a sentencepiece model. Tokens of
    space + text; special tokens aren't added, and their names inside a text are text.
    Null and empty texts, and texts that either tokenizer doesn't give back byte by byte,
    have no tokens: zeros and ''. Repeated rows and null ids are rows like others; other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, link_codes binary, link_counts binary"
    schema += ", groups string" if with_groups else ""

    def shown(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = aligner(a_path, b_path)
        counts, groups, links = tool.align([t or "" for t in batch["text"].to_pylist()])
        distinct = [np.unique(x, return_counts=True) for x in links]
        columns = [
            batch["id"],
            *[pa.array(counts[:, k]) for k in range(4)],
            pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
            pa.array([x.astype("<u8").tobytes() for x, _ in distinct], pa.binary()),
            pa.array([n.astype("<u8").tobytes() for _, n in distinct], pa.binary()),
        ]
        names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "link_codes", "link_counts"]
        return pa.RecordBatch.from_arrays([*columns, pa.array(groups, pa.string())] if with_groups else columns, [*names, "groups"] if with_groups else names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch["text"].nbytes
            if size >= CHUNK:
                yield shown(together(held))
                held, size = [], 0
        if held:
            yield shown(together(held))

    return rows.mapInArrow(run, schema)


def together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def numbers(column: pa.Array) -> np.ndarray:
    """The 64-bit numbers in a binary column, row after row."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8")


def pair_counts(links: DataFrame) -> DataFrame:
    """(code, n): how many links of all rows hold the id pair.

    Each task sums its own pairs; the sums meet by pair and salt, then by pair, so a pair
    that half of all links hold is never more than SALTS rows at the second shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            codes, back = np.unique(np.concatenate([codes, numbers(batch["link_codes"])]), return_inverse=True)
            n = np.zeros(len(codes), np.uint64)
            np.add.at(n, back, np.concatenate([counts, numbers(batch["link_counts"])]))
            counts = n
        for i in range(0, len(codes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)].astype(np.int64)) for x in (codes, counts)], ["code", "n"])

    own = links.select("link_codes", "link_counts").mapInArrow(run, "code long, n long")
    salted = own.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy("code", "salt").agg(F.sum("n").alias("n"))
    return salted.groupBy("code").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256. An id pair's count is the number of links in all rows that hold it;
    n_best counts the row's links whose count is the highest of their B id, ties included,
    count_sum sums the counts over its links. Odd rows are treated as `aligned` says.

    The texts are encoded once, the links staged as distinct pairs per row. The table of
    pair counts is sent to all tasks; its size has a bound that doesn't depend on the
    texts: of two tokens that end together one is a suffix of the other, so there are at
    most as many pairs as the tokens of both vocabularies have bytes, twice where a byte
    also has a token of its own: about a million for 50 000 and 32 000 tokens, 17 MB.
    """
    spark = docs.sparkSession
    links = staged(aligned(docs, a_path, b_path, id_col, text_col), "links")
    counted = pair_counts(links).toArrow().sort_by("code")
    codes, n = counted["code"].to_numpy().astype(np.uint64), counted["n"].to_numpy()
    right = (codes & np.uint64(0xFFFFFFFF)).astype(np.int64)
    most = np.zeros(int(right.max()) + 1 if len(right) else 0, np.int64)
    np.maximum.at(most, right, n)
    shared = spark.sparkContext.broadcast((codes, n, n == most[right]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for batch in batches:
            at = np.searchsorted(known, numbers(batch["link_codes"]))
            times = numbers(batch["link_counts"]).astype(np.int64)
            edge = np.concatenate([[0], np.cumsum([len(x) // 8 for x in batch["link_codes"].to_pylist()], dtype=np.int64)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(times * value[at])])[edge]) for value in (best, count)]
            own = [batch[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
            names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(s.astype(np.int64)) for s in sums], batch["groups_sha256"]], names)

    id_type = links.schema["id"].dataType.simpleString()
    out = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return links.mapInArrow(run, out).withColumnRenamed("id", id_col)
