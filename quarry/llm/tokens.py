"""Token ids of whole texts by a public tokenizer, one encoding per distinct word."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quarry.llm.bytewords import WHITE, utf8, word_hashes

#: Stands between words while they are encoded together; words that hold it go alone.
MARK = "\x01"
#: Words that a worker remembers, some 60 MB.
REMEMBERED = 1 << 21
#: Runs of letters and punctuation that a worker remembers.
PIECES = 200_000
#: Words of Latin-1 letters within ASCII punctuation but for the apostrophe: normal forms
#: leave them as they are, and letters and punctuation are apart.
COMMON = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: Byte-level alphabet: printable bytes stand for themselves, the others follow from 256.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class WordTokenizer:
    """Encodes texts exactly as the tokenizer does without special tokens.

    Only for byte-level tokenizers that lower-case, keep no token across white space and
    split runs of letters from runs of punctuation, as word_bpe_49k.json does: then a
    text's ids are those of its words one after the other, and each distinct word needs
    encoding once. Common words go to the tokenizer's model as its own splitting would
    send them, all others through the whole tokenizer. Words are told apart by 64-bit
    hashes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        if self.inner.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path} has {self.inner.get_vocab_size()} ids; 65536 can be held")
        (self.mark,) = self.encode(MARK)
        self.pieces: dict[str, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.known, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def encode(self, text: str) -> list[int]:
        return self.inner.encode(text, add_special_tokens=False).ids

    def piece(self, text: str) -> list[int]:
        """The ids of a run of letters or of punctuation, in lower case."""
        if text not in self.pieces:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            self.pieces[text] = [t.id for t in self.inner.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_LEVEL))]
        return self.pieces[text]

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.forget()
        parts: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(words)
        plain = []
        for i, word in enumerate(words):
            text = word.decode()
            if (m := COMMON(text)) and "<|" not in text:
                parts[i] = np.array([x for run in m.groups() if run for x in self.piece(run.lower())], np.uint16)
            elif MARK in text or "<|" in text:
                parts[i] = np.array(self.encode(text), np.uint16)
            else:
                plain.append(i)
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            ids = np.array(self.encode(f" {MARK} ".join(words[j].decode() for j in some)), np.uint16)
            for j, part in zip(some, np.split(ids, np.flatnonzero(ids == self.mark)), strict=True):
                parts[j] = part[1:] if j != some[0] else part
        size = np.array([len(p) for p in parts], np.int64)
        begin = len(self.flat) + np.cumsum(size) - size
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.begin, self.size = np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]
        self.flat = np.concatenate([self.flat, *parts])

    def rows(self, column: pa.Array, budget: int = 1 << 21) -> Iterator[np.ndarray]:
        """The ids of each row of a string column; null is empty."""
        data, at = utf8(column)
        row, n = 0, len(at) - 1
        while row < n:
            upto = max(row + 1, int(np.searchsorted(at, at[row] + budget, "right")) - 1)
            part, bounds = data[at[row] : at[upto]], at[row : upto + 1] - at[row]
            hashes, words = word_hashes(part, bounds)
            unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            where = self.find(unique)
            if (new := np.flatnonzero(where < 0)).size:
                self.learn(unique[new], words_at(part, bounds, first[new]))
                where = self.find(unique)
                if (where < 0).any():  # what was remembered has been forgotten
                    gone = np.flatnonzero(where < 0)
                    self.learn(unique[gone], words_at(part, bounds, first[gone]))
                    where = self.find(unique)
            begin, size = self.begin[where][back], self.size[where][back]
            ends = np.cumsum(size)
            ids = self.flat[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
            edge = np.concatenate([[0], ends])[words]
            yield from (ids[edge[i] : edge[i + 1]] for i in range(upto - row))
            row = upto

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)


def words_at(data: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> list[bytes]:
    """The words with these numbers, as word_hashes counts them."""
    solid = ~WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:-1]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return [data[begin[i] : end[i]].tobytes() for i in wanted]


_made: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """This worker's tokenizer, which keeps its words between tasks."""
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]
