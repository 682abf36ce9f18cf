"""Encoding of texts whose tokens never cross word bounds: each distinct word is encoded once and then looked up."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np


class _Codes(dict):
    """Numbers words in the order of their first lookup and lists those not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, word) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class WordMemo:
    """Ids of texts from the ids of their words. Subclasses say how texts split and how new words are encoded.

    ``limit`` bounds the bytes that the remembered words take, by a rough count; past it the memory is started anew.
    """

    limit = 128_000_000
    per_word = 150  # a word's entry beside its characters and ids

    def __init__(self) -> None:
        self._reset()

    def split(self, text: bytes) -> list:
        raise NotImplementedError

    def encode_new(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids per word)."""
        raise NotImplementedError

    def _reset(self) -> None:
        self.held = 0
        self.codes = _Codes()
        self.flat = np.zeros(1 << 16, np.int32)
        self.bounds = np.zeros(1 << 16, np.int64)

    def _learn(self) -> None:
        new = self.codes.new
        n = len(self.codes) - len(new)  # codes before these
        used = int(self.bounds[n])
        ids, lengths = self.encode_new(new)
        total = used + len(ids)
        while len(self.flat) < total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.bounds) < len(self.codes) + 1:
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.flat[used:total] = ids
        self.bounds[n + 1 : n + 1 + len(new)] = used + np.cumsum(lengths)
        self.held += self.per_word * len(new) + sum(map(len, new)) + 4 * len(ids)
        new.clear()

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text), ``end`` appended to each where given."""
        words = [self.split(t) for t in texts]
        if self.held > self.limit:
            self._reset()
        counts = np.fromiter(map(len, words), np.int64, len(words))
        code = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if self.codes.new:
            self._learn()
        lo = self.bounds[code]
        n = self.bounds[code + 1] - lo
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(lo - before[:-1], n) + np.arange(int(before[-1]))]
        stop = before[np.cumsum(counts)]
        if end is not None:
            ids = np.insert(ids, stop, end)
            stop = stop + np.arange(1, len(stop) + 1)
        return ids, np.diff(np.concatenate([[0], stop]))


class LibraryWords(WordMemo):
    """Words through the tokenizers library, for vocabularies that drop white space, split at it and ignore case.

    New words go to the library many at a time with a special token behind each: it parts what is around it, so a word's
    ids are those that it has alone.
    """

    limit = 192_000_000
    together = 2_000
    _mark = re.compile(rb"[.,](?<=[a-z0-9][.,])(?!\S)")

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        fit = [i for i, t in special.items() if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        if not fit or not all(t.content.startswith("<|") for t in special.values()):
            raise ValueError("the vocabulary needs special tokens, and all of the form <|...")
        self.apart = max(fit)
        self.behind = special[self.apart].content.encode()

    def split(self, text: bytes) -> list:
        """Words as the vocabulary sees them: A-Z in lower case, an end mark behind a letter or digit apart."""
        if b"<|" in text or b"\xcc" in text or b"\xcd" in text:  # special tokens and combining marks are matched before any change of case
            return text.split()
        return self._mark.sub(rb" \g<0>", text.lower()).split()

    def encode_new(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, w in enumerate(words) if b"<|" in w]
        found, done = [], 0
        for i in [*odd, len(words)]:
            found.append(self._joined(words[done:i]))
            if i < len(words):
                ids = self.tokenizer.encode(words[i].decode(), add_special_tokens=False).ids
                found.append((np.array(ids, np.int32), np.array([len(ids)])))
            done = i + 1
        return np.concatenate([f for f, _ in found]), np.concatenate([n for _, n in found])

    def _joined(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        texts = [(self.behind.join(words[i : i + self.together]) + self.behind).decode() for i in range(0, len(words), self.together)]
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in got)])
        cut = np.flatnonzero(ids == self.apart)
        if len(cut) != len(words):
            raise ValueError("a word has the id of the special token")
        return np.delete(ids, cut), np.diff(cut, prepend=-1) - 1


@lru_cache(maxsize=1)
def library_words(path: str) -> LibraryWords:
    """One memo per worker process, kept from task to task."""
    return LibraryWords(path)
