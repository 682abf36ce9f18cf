"""Alignment of two tokenizers: tokens of both that cover the same bytes form groups, and id pairs are counted over the corpus.

Both tokenizers begin a new token at a space between two visible characters, so a text is cut there and each distinct word is
aligned once. In a batch of new words every token points to the farthest-right token of the other tokenizer that overlaps
it; doubling the pointers brings each token to the last one of its group, whose number names the group.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.pieces import MARK
from panelwright.llm.scratch import frugal, give_back, stored
from panelwright.llm.textnum import pieces, rows_of
from panelwright.llm.word_memo import _Codes

ID_BITS = 20  # a pair of ids is one number: the first id above the second
BLOCK_BYTES = 2_000_000
_AT_ONCE = 2_000_000  # links expanded together


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible bytes for themselves, others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Fixed value: how a byte-level vocabulary parts a text before it merges.
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level BPE of the tokenizers library; strings of special tokens count as plain text.

    Words of ASCII characters go to tiktoken with the same file's merges as ranks, which it takes less time over, if every
    merge makes the id of its own rank; on them both libraries agree, as they part ASCII alike. All others go to tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte = byte_characters()
        special = self.tokenizer.get_added_tokens_decoder()
        self.raw = [b""] * self.tokenizer.get_vocab_size()
        vocab = self.tokenizer.get_vocab()
        for token, i in vocab.items():
            self.raw[i] = b"" if i in special else bytes(byte[c] for c in token)
        spec = json.loads(self.tokenizer.to_str())
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        first = len(vocab) - len(special) - len(made)
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.ranked = None
        if plain and first == 256 and all(vocab[m] == first + i for i, m in enumerate(made)):
            self.ranked = tiktoken.Encoding("ranked", pat_str=PARTS, mergeable_ranks={r: i for i, r in enumerate(self.raw) if r}, special_tokens={})._core_bpe.encode_ordinary

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word by itself."""
        ranked = self.ranked
        out = [ranked(w) if ranked and w.isascii() else None for w in words]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for i, found in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = found.ids
        return out


class Pieces:
    """A SentencePiece model by its library, with the bytes of each piece; control pieces have none."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.model, self.model.vocab_size()
        self.raw = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, the model putting the space before it."""
        return self.model.encode(words, num_threads=1)


def join_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the tokens of two tilings of the same bytes, given each token's end; tokens of no bytes aren't allowed.

    Tokens are numbered first A then B. An A token points to the B token that covers its last byte, a B token to the A
    token that covers its last byte if that reaches further, else to itself: it ends its group.
    """
    n = len(ends_a)
    over = np.searchsorted(ends_a, ends_b)
    to = np.concatenate([n + np.searchsorted(ends_b, ends_a), np.where(ends_a[over] > ends_b, over, n + np.arange(len(ends_b)))])
    while True:
        twice = to[to]
        if np.array_equal(twice, to):
            break
        to = twice
    last = np.zeros(n + len(ends_b) + 1, np.int64)
    last[to] = 1
    number = np.cumsum(last) - 1  # ends of groups are B tokens, which stand in order
    return number[to[:n]], number[to[n:]]


def _counted_pairs(word: np.ndarray, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, pair, times) of all links, sorted by word and pair; ``word`` is that of each A token.

    Links are expanded some at a time and counted at once, so memory follows the different pairs.
    """
    per = np.bincount(gb, minlength=int(ga[-1]) + 1 if len(ga) else 0)
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    times = per[ga]
    reach = np.cumsum(times)
    keys, counts, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    done = []
    while at < len(ga):
        before = int(reach[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(reach, before + _AT_ONCE, "right")))
        t = times[at:to]
        start = np.cumsum(t) - t
        partner = np.repeat(first[ga[at:to]] - start, t) + np.arange(int(t.sum()))
        key = np.repeat((word[at:to] << 2 * ID_BITS) | (a[at:to] << ID_BITS), t) | b[partner]
        done.append(np.unique(key, return_counts=True))
        if len(done) == 8 or to == len(ga):
            keys, where = np.unique(np.concatenate([keys, *(k for k, _ in done)]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, *(c for _, c in done)]), len(keys)).astype(np.int64)
            done = []
        at = to
    return keys >> 2 * ID_BITS, keys & ((1 << 2 * ID_BITS) - 1), counts


class AlignedWords:
    """Alignments of words, each made once; past ``limit`` bytes, by a rough count, the memory is started anew."""

    limit = 144_000_000
    per_word = 260
    at_once = 50_000  # new words aligned together
    #: White space, to one library or another, beside the plain space and the line break.
    _spaces = "".join(map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
    _odd = re.compile(f"[{_spaces}]")
    _cut = re.compile(f"(?<=[^ \n{_spaces}]) (?=[^ \n{_spaces}])")

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a, self.size_b = (np.array([len(r) for r in x.raw], np.int64) for x in (self.a, self.b))
        widest = max(len(self.size_a), len(self.size_b))
        if widest >> ID_BITS:
            raise ValueError("a vocabulary has too many ids")
        names = [f"{i}{end}" for end in (",", "|", ";", "") for i in range(widest)]
        self._named = names, np.fromiter(map(len, names), np.int64, len(names))
        self._reset()

    def _reset(self) -> None:
        self.codes, self.held = _Codes(), 0
        self.groups: list[bytes] = []
        self.facts = np.zeros((5, 1 << 12), np.int64)  # A tokens, B tokens, groups, links, whether bytes agree
        self.bounds = np.zeros((1 << 12) + 1, np.int64)
        self.pair = np.zeros(1 << 14, np.int64)
        self.times = np.zeros(1 << 14, np.int64)

    def words(self, text: str) -> list[str]:
        """The text, a space before it, cut before each space between two visible characters; those spaces are left out."""
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or self._odd.search(text):
            return self._cut.split(" " + text if text[0].isspace() else text)
        return text.split(" ")

    @staticmethod
    def _spaced(word: str) -> str:
        return word if word[0] == " " else " " + word

    def look_up(self, words: Iterator[str], n: int) -> np.ndarray:
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, n)
        new = self.codes.new
        for at in range(0, len(new), self.at_once):
            self._learn(new[at : at + self.at_once])
        new.clear()
        return codes

    def _learn(self, keys: list[str]) -> None:
        words = [self._spaced(w) for w in keys]
        ids_a, ids_b = self.a.encode(words), self.b.encode([w[1:] for w in words])
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((ids_a, n_a), (ids_b, n_b)))
        good = self._agree(words, flat_a, n_a, flat_b, n_b)
        keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        flat_a, flat_b = flat_a[keep_a], flat_b[keep_b]
        ga, gb = join_groups(np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])) if len(flat_a) else (flat_a, flat_b)
        word_a = np.repeat(np.arange(len(words)), n_a)
        at, pair, times = _counted_pairs(word_a, flat_a, flat_b, ga, gb)
        opens = np.flatnonzero(np.diff(ga, prepend=-1))
        n_groups = np.bincount(word_a[opens], minlength=len(words))
        n_links = np.bincount(at, times, len(words)).astype(np.int64)
        texts = self._group_texts(flat_a, flat_b, ga, gb, n_a, n_b)
        self._keep(np.stack([n_a, n_b, n_groups, n_links, good.astype(np.int64)]), texts, np.bincount(at, minlength=len(words)), pair, times)
        self.held += self.per_word * len(keys) + sum(map(len, keys)) + sum(map(len, texts)) + 16 * len(pair)

    def _agree(self, words: list[str], flat_a: np.ndarray, n_a: np.ndarray, flat_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Whether both tokenizers' bytes are those of the word."""
        raw = [w.encode() for w in words]
        whole = b"".join(raw)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        good = np.ones(len(words), bool)
        for flat, n, table, size in ((flat_a, n_a, self.a.raw, self.size_a), (flat_b, n_b, self.b.raw, self.size_b)):
            parts, ends, stop = list(map(table.__getitem__, flat.tolist())), np.concatenate([[0], np.cumsum(size[flat])]), np.cumsum(n)
            if np.array_equal(ends[stop] - ends[stop - n], sizes) and b"".join(parts) == whole:
                continue
            good &= np.fromiter((b"".join(parts[e - k : e]) == r for r, e, k in zip(raw, stop.tolist(), n.tolist(), strict=True)), bool, len(raw))
        return good

    def _group_texts(self, flat_a: np.ndarray, flat_b: np.ndarray, ga: np.ndarray, gb: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
        """Per word, its groups as ``a1,a2|b1;a3|b2``: all words' tokens in order, each with what follows it, in one text that is then cut."""
        side = np.concatenate([np.zeros(len(ga), np.int64), np.ones(len(gb), np.int64)])
        place = np.concatenate([ga, gb]) * 2 + side
        order = np.argsort(place, kind="stable")  # two sorted runs
        place, ids = place[order], np.concatenate([flat_a, flat_b])[order]
        step = np.diff(place, append=place[-1:] + 1)
        stop = np.cumsum(n_a + n_b)
        behind = np.where(step == 0, 0, np.where(place % 2 == 0, 1, 2))  # , | ;
        behind[stop[(n_a + n_b) > 0] - 1] = 3
        names, sizes = self._named
        at = behind * (len(names) // 4) + ids
        text = "".join(map(names.__getitem__, at.tolist())).encode()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[np.concatenate([[0], stop])].tolist()
        return [text[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def _keep(self, facts: np.ndarray, texts: list[bytes], n_pairs: np.ndarray, pair: np.ndarray, times: np.ndarray) -> None:
        n, used = len(self.groups), int(self.bounds[len(self.groups)])
        while self.facts.shape[1] < n + len(texts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)], 1)
            self.bounds = np.concatenate([self.bounds, np.zeros(len(self.bounds) - 1, np.int64)])
        while len(self.pair) < used + len(pair):
            self.pair, self.times = np.concatenate([self.pair, np.zeros_like(self.pair)]), np.concatenate([self.times, np.zeros_like(self.times)])
        self.facts[:, n : n + len(texts)] = facts
        self.bounds[n + 1 : n + 1 + len(texts)] = used + np.cumsum(n_pairs)
        self.pair[used : used + len(pair)], self.times[used : used + len(pair)] = pair, times
        self.groups += texts

    def pairs_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs of each word, how many, and their times) of words by code."""
        lo = self.bounds[codes]
        n = self.bounds[codes + 1] - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.pair[at], n, self.times[at]


@lru_cache(maxsize=1)
def aligned_words(path_a: str, path_b: str) -> AlignedWords:
    """One memory per worker process, kept from task to task."""
    return AlignedWords(path_a, path_b)


_LISTS = ["doc_ids", "n_a", "n_b", "n_groups", "n_links"]
BLOCK = "block long, " + ", ".join(f"{c} array<long>" for c in _LISTS) + ", shas array<string>, pairs array<long>, docs array<long>, words binary"


def _packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.int64(len(a)).tobytes() + a.astype("<i4").tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(raw):
        n = int(np.frombuffer(raw, "<i8", 1, at)[0])
        out.append(np.frombuffer(raw, "<i4", n, at + 8).astype(np.int64))
        at += 8 + 4 * n
    return out


def _block(memo: AlignedWords, number: int, keys: list, texts: list[bytes]) -> pa.RecordBatch:
    """Documents aligned together: what is final of them, the id pairs they hold, and their words as numbers of pairs."""
    if memo.held > memo.limit:
        memo._reset()
        give_back()
    split = [memo.words(t.decode()) for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    codes = memo.look_up(chain.from_iterable(split), int(n.sum()))
    del split
    sums = np.concatenate([np.zeros((5, 1), np.int64), np.cumsum(memo.facts[:, codes], axis=1)], axis=1)
    stop = np.cumsum(n)
    held = sums[:, stop] - sums[:, stop - n]
    good = (held[4] == n) & (n > 0)
    held[:, ~good] = 0
    listed, shas = codes.tolist(), []
    for ok, a, b in zip(good.tolist(), (stop - n).tolist(), stop.tolist(), strict=True):
        shas.append(hashlib.sha256(b";".join(map(memo.groups.__getitem__, listed[a:b]))).hexdigest() if ok else "")
    code_of = np.repeat(np.where(good, np.arange(len(n)), -1), n)
    used = code_of >= 0
    both, times = np.unique(code_of[used] << 32 | codes[used], return_counts=True)
    doc, word = both >> 32, both & 0xFFFFFFFF
    own, word = np.unique(word, return_inverse=True)
    pair, per_word, per_pair = memo.pairs_of(own)
    pairs, pair = np.unique(pair, return_inverse=True)
    first = np.cumsum(per_word) - per_word
    k = per_word[word]
    at = np.repeat(first[word] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
    each = np.unique(np.repeat(doc, k) * max(1, len(pairs)) + pair[at])
    docs = np.bincount(each % max(1, len(pairs)), minlength=len(pairs))
    row = [pa.array([number]), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (np.array(keys, object), *held[:4])), pa.array([shas], pa.list_(pa.string()))]
    row += [pa.array([pairs], pa.list_(pa.int64())), pa.array([docs], pa.list_(pa.int64()))]
    row.append(pa.array([_packed(np.bincount(doc, minlength=len(n)), word, times, per_word, pair, per_pair)], pa.binary()))
    return pa.RecordBatch.from_arrays(row, names=["block", *_LISTS, "shas", "pairs", "docs", "words"])


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _judged(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a block with the corpus-wide counts of their pairs."""
    pair = right.column("pair").to_numpy()
    order = np.argsort(pair)
    count, best = right.column("count").to_numpy()[order], right.column("best").to_numpy().astype(np.int64)[order]
    out = []
    for row in left.to_pylist():
        words, word, times, per_word, of_pair, per_pair = _unpacked(row["words"])
        spread = np.repeat(np.arange(len(per_word)), per_word)
        sums = []
        for value in (best, count):
            by_word = np.zeros(len(per_word), np.int64)
            np.add.at(by_word, spread, per_pair * value[of_pair])
            by_doc = np.zeros(len(words), np.int64)
            np.add.at(by_doc, np.repeat(np.arange(len(words)), words), times * by_word[word])
            sums.append(by_doc)
        arrays = [pa.array(row[c], pa.int64()) for c in _LISTS] + [pa.array(s) for s in sums] + [pa.array(row["shas"], pa.string())]
        out.append(pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
    return pa.Table.from_batches(out)


def align_blocks(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in blocks of about 2 MB of text (a longer one is a block of its own), aligned; see ``align_tokenizers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        memo = aligned_words(path_a, path_b)
        for batch in batches:
            for keys, texts in pieces(rows_of(batch, "key", "text"), BLOCK_BYTES):
                yield _block(memo, number, keys, texts)
                number += 1

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, a, b, count, best): how many documents hold each id pair linked, and whether no pair of that A id has more."""
    held = blocks.select(F.inline(F.arrays_zip("pairs", "docs"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("count"))
    counts = stored(held.select("pair", F.shiftright("pair", ID_BITS).alias("a"), F.col("pair").bitwiseAND((1 << ID_BITS) - 1).alias("b"), "count"), "pairs")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))  # a row for each id of the vocabulary at most
    return counts.join(F.broadcast(top), "a").select("pair", "a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    A is a byte-level BPE of the tokenizers library over a space and the text, B a SentencePiece BPE over the text. Groups lie
    between byte offsets where tokens of both end. Links are all pairs of an A and a B token of one group; a pair's count
    is the number of rows that hold it linked, ``n_best`` the links whose count is the highest of their A id (ties included), and
    ``count_sum`` the sum of the counts over all links.

    Null and empty texts, and those whose tokens don't give back their bytes (texts with U+2581), have zeros and an empty
    digest. Repeated rows count each, rows without a key too; an empty table gives an empty one. Columns of ``docs`` other than
    key and text aren't read, so their names may clash with any here. Work goes by blocks of about 2 MB of text: a block
    sends each of its pairs once, gets the pair's count once, and no row is made for a document's pair.
    """
    blocks = stored(align_blocks(docs, path_a, path_b, key, text), "aligned")
    counts = stored(pair_counts(blocks).select("pair", "count", "best"), "counts")
    asked = blocks.select(F.col("block").alias("asks"), F.explode("pairs").alias("pair"))
    answers = asked.join(counts.hint("merge"), "pair")
    left = blocks.drop("pairs", "docs").groupBy("block")  # its own name on the other side: both stem from one table
    return left.cogroup(answers.groupBy("asks")).applyInArrow(_judged, _OUT).withColumnRenamed("doc_id", key)
