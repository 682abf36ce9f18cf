"""Token ids in Simple-8b words, in files ordered by document.

A 64-bit word holds a selector in its top 4 bits and equal-width ids below: as many as the widest of them allows.
Ids of 60 bits or more are escaped: a word of selector 15 with all data bits set, then the id as a raw word.
A block holds whole documents: its ids as words, and the documents' keys and lengths, so any block decodes by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import NO_KEY, frugal, scratch_path, shuffle_partitions
from panelwright.llm.textnum import pieces, rows_of
from panelwright.llm.word_memo import library_words

#: Ids per word and bits per id of each selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_MASK = np.uint64((1 << 60) - 1)
_CHUNK = 1 << 20


def _pack(x: np.ndarray) -> np.ndarray:
    """Words of ids under 2^60 - 1."""
    n = len(x)
    step = np.ones(n, np.int16)
    choice = np.full(n, 15, np.int8)
    top = int(x.max()) if n else 0
    bad = np.zeros(n + 1, np.int32)
    for s in range(14, -1, -1):  # from few to many ids a word: the last that fits stays
        c, b = int(COUNTS[s]), int(BITS[s])
        if c > n or (s < 14 and top < (1 << int(BITS[s + 1])) and COUNTS[s + 1] > n):
            continue
        if top < 1 << b:  # wide enough for every id
            step[: n - c + 1], choice[: n - c + 1] = c, s
            continue
        np.cumsum(x >= np.uint64(1 << b), dtype=np.int32, out=bad[1:])
        fits = bad[c:] == bad[:-c]
        if b < 15 and not fits.any():
            break  # narrower selectors hold more ids: none fits either
        np.copyto(step[: len(fits)], c, where=fits)
        np.copyto(choice[: len(fits)], s, where=fits)
    following, starts, i = (np.arange(n) + step).tolist(), [], 0
    put = starts.append
    while i < n:
        put(i)
        i = following[i]
    at = np.array(starts, np.int64)
    sel = choice[at]
    out = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        if BITS[s] == 0:
            continue
        rows = np.flatnonzero(sel == s)
        shift = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        out[rows] |= np.bitwise_or.reduce(x[at[rows][:, None] + np.arange(COUNTS[s])] << shift, axis=1)
    return out


def encode_words(ids: np.ndarray) -> bytes:
    """Simple-8b words, little-endian; all ids from 0 to 2^64 - 1."""
    x = np.asarray(ids, np.uint64)
    large = np.flatnonzero(x >= _MASK)
    out, done = [], 0
    for i in [*large.tolist(), len(x)]:
        for a in range(done, i, _CHUNK):
            out.append(_pack(x[a : min(i, a + _CHUNK)]))
        if i < len(x):
            out.append(np.array([np.uint64(0xFFFFFFFFFFFFFFFF), x[i]], np.uint64))
        done = i + 1
    return np.concatenate(out or [np.zeros(0, np.uint64)]).astype("<u8").tobytes()


def decode_words(data: bytes) -> np.ndarray:
    """The ids of :func:`encode_words`, one selector at a time over all words."""
    w = np.frombuffer(data, "<u8").astype(np.uint64)
    escaped = np.flatnonzero(w == np.uint64(0xFFFFFFFFFFFFFFFF))
    raw = np.zeros(len(w), bool)
    for i in escaped.tolist():  # a raw word may look like an escape itself
        if not raw[i]:
            raw[i + 1] = True
    sel = (w >> np.uint64(60)).astype(np.int64)
    head = np.zeros(len(w), bool)
    head[np.flatnonzero(raw) - 1] = True
    n = np.where(raw, 1, np.where(head, 0, COUNTS[sel]))
    offset = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(offset[-1]), np.uint64)
    plain = ~raw & ~head
    for s in np.unique(sel[plain]):
        if BITS[s] == 0:
            continue
        rows = np.flatnonzero(plain & (sel == s))
        shift = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        out[offset[rows][:, None] + np.arange(COUNTS[s])] = (w[rows][:, None] >> shift) & mask
    out[offset[:-1][raw]] = w[raw]
    return out


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("keys", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary())])
BLOCK = "part int, block int, ids_before long, n_docs int, n_ids long, keys binary, lengths binary, words binary"


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end: int | None = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every text and writes the blocks to ``path`` in ascending order of ``key``, a file per range of keys and text hashes.

    So rows of one key, or without one, are dealt to several files where they are many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        encoder, block, before = library_words(tokenizer), 0, 0
        for batch in batches:
            for keys, texts in pieces(rows_of(batch, "key", "text"), 1_000_000):
                ids, n = encoder.encode(texts, end)
                x = np.array(keys, np.int64)
                row = [part, block, before, len(keys), len(ids), x.astype("<i8").tobytes(), encode_words(n), encode_words(ids)]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)
                block, before = block + 1, before + len(ids)

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "key", "h").sortWithinPartitions("key", "h", "text").drop("h")
    ordered.mapInArrow(frugal(run), BLOCK).write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            keys = np.frombuffer(row["keys"], "<i8")
            n = decode_words(row["lengths"])[: len(keys)].astype(np.int64)
            ids = decode_words(row["words"])[: row["n_ids"]].astype("<u4")
            stop = np.cumsum(n)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((stop - n).tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row["part"], np.int32)), pa.array(keys), pa.array(row["ids_before"] + stop - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "key", "local", "n_tokens", "ids_crc32"])


def read_token_file(spark, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, decoded from the files.

    The totals of the parts, one row per file, give each part's first id; they are few enough to be broadcast.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    from pyspark.sql import Window

    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    docs = blocks.mapInArrow(frugal(_read), "part int, key long, local long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(base), "part").select(F.nullif(F.col("key"), F.lit(NO_KEY)).alias(key), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_file(docs: DataFrame, tokenizer: str, end: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all documents' ids as a token file and returns its index, read back from it.

    A null text is empty and has the end id alone; without one it has no ids and keeps its row. Rows with one key
    follow each other in the order of a hash of their texts, those without a key come first (as does the least long, which stands for none). An empty table gives an empty index.
    Texts are encoded in pieces of about a MB, a longer one by itself, and a text's ids are never split. Columns of ``docs``
    other than key and text aren't read, so their names may clash with any here.
    """
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_file(docs, path, tokenizer, end, key, text)
    return read_token_file(docs.sparkSession, path, key)
