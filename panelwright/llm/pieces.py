"""SentencePiece encoding and decoding by a Viterbi pass that words with a common prefix share.

Distinct marked words are sorted, which lays them out as a depth-first walk of their trie: a word keeps the
forward states of the prefix it shares with the word before and only extends the rest.

* Unigram models: the state of a prefix is its best score and the last piece that reaches it.
* BPE models (what the public vocabulary file is): merges, not scores, choose the pieces, so a state is the last
  piece of the prefix's encoding. Exactly one piece that ends there is consistent with the state before it, i.e. no merge
  across the seam would have come earlier than those that made the two pieces. The result is the library's own.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import frugal
from panelwright.llm.textnum import pieces, rows_of
from panelwright.llm.word_memo import WordMemo

MARK = "▁"


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model file with identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.encode("  a ", out_type=str)[-1][-1] != MARK:
            raise ValueError("the model changes white space: only identity normalisation is supported")
        n = sp.vocab_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in normal}
        self.rank = {self.names[i]: -sp.get_score(i) for i in normal}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.widest = max(map(len, self.ids))
        self.raw = [b"" if sp.is_control(i) else sp.decode([i]).encode() if sp.is_unknown(i) else self.names[i].replace(MARK, " ").encode() for i in range(n)]
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece goes on past a word's end")
        self.parts: dict[str, tuple[str, str] | None] = {}
        for p in self.ids:
            self.parts[p] = self._last_merge(p)

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The merge that completes a piece; None for characters and for pieces that merging never makes."""
        symbols = list(piece)
        last = None
        while len(symbols) > 1:
            ranked = [(self.rank[x], i) for i in range(len(symbols) - 1) if (x := symbols[i] + symbols[i + 1]) in self.rank]
            if not ranked:
                return None
            i = min(ranked)[1]
            last = symbols[i], symbols[i + 1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return last

    def ids_of(self, piece: str) -> list[int]:
        """A piece's id; an unknown character's bytes, or the unknown id where the model has no byte pieces."""
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in piece.encode()]

    def decode(self, ids: list[int]) -> bytes:
        """The text of a sequence of ids; the mark put before the first word goes."""
        return b"".join(map(self.raw.__getitem__, ids)).removeprefix(b" ")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class MergeStates:
    """Forward states of a BPE model: each prefix's last piece."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.usable = {p: i for p, i in vocab.ids.items() if len(p) == 1 or vocab.parts[p]}
        self.begins = {p[:k] for p in self.usable for k in range(1, len(p) + 1)}
        self.seams: dict[int, bool] = {}  # by both pieces' ids in one number
        self._start_places()

    def _start_places(self) -> None:
        """A place is the longest end of a prefix that begins a piece; it tells the pieces that end there, the longest first."""
        self.place = {"": 0}
        self.texts = [""]
        self.fits: list[list[tuple[int, int]]] = [[]]  # length and id
        self.moves: list[dict[str, int]] = [{}]
        self.n_moves = 0

    def _move(self, at: int, char: str) -> int:
        to = self.texts[at] + char
        while to and to not in self.begins:
            to = to[1:]
        new = self.place.get(to)
        if new is None:
            new = self.place[to] = len(self.texts)
            self.texts.append(to)
            self.fits.append([(len(to) - k, self.usable[to[k:]]) for k in range(len(to)) if to[k:] in self.usable])
            self.moves.append({})
        self.moves[at][char] = new
        self.n_moves += 1
        return new

    def seam_holds(self, left: str, right: str) -> bool:
        """Whether no merge across the seam comes before the merges that made ``left`` and ``right``."""
        rank, parts = self.vocab.rank, self.vocab.parts
        a, b, before, holds = left, right, float("inf"), True
        while True:
            across = rank.get(a + b)
            if across is not None and across < before:
                holds = False
                break
            ra = rank[a] if len(a) > 1 else -1.0
            rb = rank[b] if len(b) > 1 else -1.0
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # the younger piece is taken apart; of equals the right one is younger
                before, a = ra, parts[a][1]
            else:  # a merge across of the same rank stands further left, so it would come first
                before, b = rb + 0.5, parts[b][0]
        return holds

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        if self.n_moves > 200_000:
            self._start_places()
        seams, fits, moves, ids_of, names = self.seams, self.fits, self.moves, self.vocab.ids_of, self.vocab.names
        number: list[int] = [0]  # the last piece's id, -1 for an unknown character
        length: list[int] = [0]
        places: list[int] = [0]
        held = ""
        for word in words:
            same = 0
            for x, y in zip(held, word):  # noqa: B905
                if x != y:
                    break
                same += 1
            del number[same + 1 :], length[same + 1 :], places[same + 1 :]
            at, i = places[same], same
            for char in word[same:]:
                i += 1
                to = moves[at].get(char)
                at = self._move(at, char) if to is None else to
                places.append(at)
                for size, n in fits[at]:
                    j = i - size
                    if j:
                        left = number[j]
                        if left < 0:
                            if not self.seam_holds(word[j - 1 : j], names[n]):
                                continue
                        else:
                            holds = seams.get(left << 24 | n)
                            if holds is None:
                                holds = seams[left << 24 | n] = self.seam_holds(names[left], names[n])
                            if not holds:
                                continue
                    number.append(n)
                    length.append(size)
                    break
                else:  # an unknown character
                    number.append(-1)
                    length.append(1)
            held = word
            if len(seams) > 400_000:
                seams.clear()
            out, i = [], len(word)
            while i:
                if number[i] >= 0:
                    out.append(number[i])
                else:
                    out.extend(reversed(ids_of(word[i - 1])))
                i -= length[i]
            yield out[::-1]


class ScoreStates:
    """Forward states of a unigram model: best score and last piece of each prefix.

    Of paths with equal scores the library takes the one that single-precision sums from the text's beginning favour, which no
    word can tell by itself; here the one with the longest last piece stays.
    """

    def __init__(self, vocab: Vocabulary):
        self.ids_of = vocab.ids_of
        self.score = {p: -r for p, r in vocab.rank.items()}
        self.widest = vocab.widest
        self.unknown = min(self.score.values()) - 10.0

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        best: list[float] = [0.0]
        last: list[int] = [0]
        held = ""
        for word in words:
            same = 0
            for x, y in zip(held, word):  # noqa: B905
                if x != y:
                    break
                same += 1
            del best[same + 1 :], last[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                top, at = None, i - 1
                for j in range(max(0, i - self.widest), i):  # of equal paths the one with the longest last piece stays
                    score = self.score.get(word[j:i])
                    if score is None and j == i - 1:
                        score = self.unknown
                    if score is not None and (top is None or best[j] + score > top):
                        top, at = best[j] + score, j
                best.append(top)
                last.append(at)
            held = word
            out, i = [], len(word)
            while i:
                out.append(word[last[i] : i])
                i = last[i]
            yield [x for p in reversed(out) for x in self.ids_of(p)]


class MarkedWords(WordMemo):
    """Texts as marked words, each with the spaces before it; a line break stands alone.

    A memo key is the word behind its mark, or "\\x01" and the word where no mark stands before it (a line's first
    word). Texts for which that is ambiguous take a slower cut whose odd keys are the marked words' bytes.
    """

    limit = 64_000_000

    _cut = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    def __init__(self, path: str, model: str = "bpe") -> None:
        super().__init__()
        self.vocab = vocabulary(path)
        self.states = MergeStates(self.vocab) if model == "bpe" else ScoreStates(self.vocab)

    def split(self, text: bytes) -> list:
        if not text:
            return []
        t = text.decode()
        if t[0] != " " and "  " not in t and "\x01" not in t and MARK not in t:
            return t.replace("\n", " \n \x01").split(" ")
        words = self._cut.findall(MARK + t.replace(" ", MARK))
        return [w[1:] if w[0] == MARK and w[1:2] not in ("\x01", "\n") else w if w == "\n" else w.encode() if w[0] == MARK else "\x01" + w for w in words]

    @staticmethod
    def _marked(key: str | bytes) -> str:
        if isinstance(key, bytes):
            return key.decode()
        return key if key == "\n" else key[1:] if key[:1] == "\x01" else MARK + key

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As of the base class; without byte pieces a run of unknown characters is one unknown id, as in the library."""
        ids, n = super().encode(texts, end)
        if self.vocab.bytes or not len(ids):
            return ids, n
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == self.vocab.unknown) & (ids[:-1] == self.vocab.unknown)
        stop = np.cumsum(n)
        again[(stop - n)[n > 0]] = False  # a run ends with its text
        dropped = np.concatenate([[0], np.cumsum(again)])
        return ids[~again], n - (dropped[stop] - dropped[stop - n])

    def encode_new(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        marked = [self._marked(w) for w in words]
        order = sorted(range(len(words)), key=marked.__getitem__)
        out: list = [None] * len(words)
        for i, found in zip(order, self.states.encode_sorted([marked[i] for i in order]), strict=True):
            out[i] = found
        n = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int32, int(n.sum())), n


@lru_cache(maxsize=1)
def marked_words(path: str, model: str) -> MarkedWords:
    """One memo per worker process, kept from task to task."""
    return MarkedWords(path, model)


def encode_pieces(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", model: str = "bpe") -> DataFrame:
    """(key, n_tokens, ids, ids_crc32, decoded_sha256, round_trip): every text as ids, and what they decode to.

    One row per row of ``docs``, repeated rows repeated, rows without a key too. Null and empty texts have no ids; an empty
    table gives an empty one. ``round_trip`` tells whether the decoded text is the text; it is false only for texts that
    hold the mark character itself or, with a vocabulary without byte pieces, unknown characters. ``ids_crc32`` is over
    little-endian 32-bit ids. Texts are encoded in pieces of about a MB, a longer one by itself. Columns of ``docs`` other
    than key and text aren't read, so their names may clash with any here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = marked_words(model_path, model)
        for batch in batches:
            for keys, texts in pieces(rows_of(batch, "key", "text"), 1_000_000):
                ids, n = memo.encode(texts)
                ids = ids.astype("<i4")
                stop = np.cumsum(n)
                start = stop - n
                raw = memoryview(ids.tobytes())
                flat = ids.tolist()
                crc, digest, same = [], [], []
                for t, a, b in zip(texts, start.tolist(), stop.tolist(), strict=True):
                    back = memo.vocab.decode(flat[a:b])
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    digest.append(hashlib.sha256(back).hexdigest())
                    same.append(back == t)
                arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), arrays, pa.array(crc, pa.int64()), pa.array(digest), pa.array(same)], names=["key", "n_tokens", "ids", "ids_crc32", "decoded_sha256", "round_trip"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(frugal(run), "key long, n_tokens long, ids array<int>, ids_crc32 long, decoded_sha256 string, round_trip boolean")
    return out.withColumnRenamed("key", key)


def decode_pieces(tokens: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of encoded rows, in any order of rows and with other columns unread.

    Null ids give a null text, no ids an empty one, bytes that aren't UTF-8 the replacement character.
    """

    @F.pandas_udf("string")
    def text(rows):
        vocab = vocabulary(model_path)
        return rows.map(lambda x: None if x is None else vocab.decode(list(x)).decode(errors="replace")).astype(object)

    return tokens.select(F.col(key), text(F.col(ids)).alias("text"))
