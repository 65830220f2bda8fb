"""Word and shingle hashes of whole texts, with numpy over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
ODD = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, known: list = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(known[0]) < n:
        x = np.full(max(n, 1024), ODD)
        x[0] = 1
        known[0] = np.multiply.accumulate(x)
    return known[0]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, at: np.ndarray, apart: np.ndarray = WHITE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, A-Z lower-cased, and n + 1 offsets of the rows in
    them. Words are runs of bytes that are not in the table apart, white space if not
    given. With prefixes the hashes have a column for each word and one for each prefix
    of so many bytes (0 where the word is not longer). Works on pieces of about CHUNK bytes that end at white space,
    so a long text needs no more memory than its words."""
    hashes, counts = [], np.zeros(len(at) - 1, np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    begin = 0
    while begin < len(data):
        end = min(begin + CHUNK, len(data))
        while end < len(data) and not apart[data[end]] and not first[end]:
            end += 1
        part = data[begin:end]
        solid = ~apart[part]
        start = solid.copy()
        start[1:] &= ~solid[:-1] | first[begin + 1 : end]
        starts = np.flatnonzero(start)
        if len(starts):
            length = np.diff(starts, append=len(part))
            inside = np.arange(starts[0], len(part)) - np.repeat(starts, length)
            value = (LOWER[part[starts[0] :]].astype(np.uint64) + np.uint64(1)) * solid[starts[0] :]
            value *= powers(int(length.max()))[inside]
            here = mix(np.add.reduceat(value, starts - starts[0]))
            if prefixes:
                columns = [here]
                for n in prefixes:
                    short = np.add.reduceat(np.where(inside < n, value, 0), starts - starts[0])
                    long = np.add.reduceat(solid[starts[0] :].astype(np.int64), starts - starts[0]) > n
                    columns.append(np.where(long, mix(short + np.uint64(n)), np.uint64(0)))
                here = np.stack(columns, axis=1)
            hashes.append(here)
            row = np.searchsorted(at, starts + begin, "right") - 1
            counts += np.bincount(row, minlength=len(counts))
        begin = end
    none = np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64)
    return (np.concatenate(hashes) if hashes else none), np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(column: pa.Array, k: int, budget: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles) for every row. Fewer than k
    words count as one shingle, no words as none. Rows are taken in groups of about
    budget bytes."""
    data, at = utf8(column)
    n, row = len(at) - 1, 0
    salt = [mix(np.array([j + 1], np.uint64))[0] | np.uint64(1) for j in range(k)]
    while row < n:
        upto = max(row + 1, int(np.searchsorted(at, at[row] + budget, "right")) - 1)
        words, begin = word_hashes(data[at[row] : at[upto]], at[row : upto + 1] - at[row])
        rolled = np.zeros(max(len(words) - k + 1, 0), np.uint64)
        for j in range(k):
            rolled += words[j : j + len(rolled)] * salt[j]
        rolled = mix(rolled)
        for i in range(upto - row):
            a, b = begin[i], begin[i + 1]
            if b - a >= k:
                s = np.sort(rolled[a : b - k + 1])
                yield row + i, s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                whole = (words[a:b] * np.array(salt[: b - a], np.uint64)).sum(dtype=np.uint64, keepdims=True)
                yield row + i, mix(whole + np.uint64(b - a))
            else:
                yield row + i, np.zeros(0, np.uint64)
        row = upto
