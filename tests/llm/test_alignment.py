"""Alignment of two tokenizers against the libraries and a plain walk over both tilings."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwright.llm.alignment import AlignedWords, align_tokenizers, byte_characters, join_groups

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(texts):
    a, b, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_characters()
    a.encode_special_tokens = True
    groups = []
    for text in texts:
        want = (" " + (text or "")).encode()
        ids_a = a.encode(want.decode(), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            groups.append(None)
            continue
        own, left, right, i, j, end_a, end_b = [], [], [], 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            if end_a <= end_b and i < len(ids_a):
                end_a += len(raw_a[i])
                left.append(ids_a[i])
                i += 1
            else:
                end_b += len(raw_b[j])
                right.append(ids_b[j])
                j += 1
            if end_a == end_b:
                own.append((left, right))
                left, right = [], []
        groups.append(own)
    links = [None if g is None else [(x, y) for left, right in g for x in left for y in right] for g in groups]
    count = Counter(p for one in links if one for p in set(one))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(n, top.get(x, 0))
    for g, one in zip(groups, links, strict=True):
        if g is None:
            yield (0,) * 6 + ("",)
        else:
            said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            yield sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(one), sum(count[p] == top[p[0]] for p in one), sum(count[p] for p in one), hashlib.sha256(said.encode()).hexdigest()


def test_odd_texts(spark):
    rng = random.Random(5)
    parts = [*"abcdefgABC  \n\t0123456789.,'", "é", "ñ", "▁", "　", "\xa0", "\x85", "᠎", "​", "﻿", "\x1c", " ", "😀", "中", " the", " ing", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "'s", "  ", "\x00", "\x01", "\x0b", "\x0c", "\x1f", "\x7f", "\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["a" * 5000, "ab" * 3000, " " * 3000, "\n" * 500, "€" * 2000, None, "", "a copy of this", "a copy of this"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "block", "pairs", "pair", "docs", "count", "best", "n_a")}).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in align_tokenizers(df, A, B).collect()}
    for i, want in enumerate(brute(texts)):
        assert got[i] == want, texts[i][:80]
    assert align_tokenizers(df.limit(0), A, B).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in align_tokenizers(docs, A, B).collect()}
    assert [got[r.doc_id] for r in rows] == list(brute([r.text for r in rows]))


def test_repeated_rows_and_rows_without_a_key(spark):
    rows = [(1, "one text"), (1, "one text"), (None, "one text"), (None, None), (2, "x ▁ y")]
    got = sorted((r.doc_id or 0, r.n_a, r.count_sum, r.groups_sha256 == "") for r in align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect())
    assert got == [(0, 0, 0, True), (0, 2, 6, False), (1, 2, 6, False), (1, 2, 6, False), (2, 0, 0, True)]


@pytest.mark.parametrize("seed", range(20))
def test_pointers_find_the_components(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 400))
    ends = [np.unique(np.append(rng.integers(1, size + 1, int(rng.integers(0, size + 1))), size)) for _ in range(2)]
    both = np.intersect1d(*ends)
    for found, e in zip(join_groups(*ends), ends, strict=True):
        assert found.tolist() == np.searchsorted(both, e).tolist()


def test_memory_started_anew():
    texts = [f"word{i} and wörd{i}x again" for i in range(300)]
    memo = AlignedWords(A, B)
    words = [w for t in texts for w in memo.words(t)]
    codes = memo.look_up(iter(words), len(words))
    before = [memo.groups[c] for c in codes.tolist()]
    memo._reset()
    memo.at_once = 7
    codes = memo.look_up(iter(words[::-1]), len(words))[::-1]
    assert [memo.groups[c] for c in codes.tolist()] == before
