"""Exact repeated word windows by super-k-mer partitioning.

Consecutive windows that share a minimiser (the least hash of the ``m``-word grams inside the window) travel as
one packed string to the bucket of that minimiser. Equal windows have equal minimisers, so each bucket holds
every copy of its windows; there the windows are sorted and counted, equal hashes being confirmed byte by byte.

Hot passages: a string that repeats inside a map task is settled there and travels once without its places.
Minimisers with more distinct strings than half a bucket's share are found by a first pass; their windows
are dealt singly by their first and last words as well, which spreads the many edges of one common passage.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import NO_KEY, frugal, shuffle_partitions
from panelwright.llm.textnum import Words, mix, pieces, rows_of, sliding_min

FLUSH_BYTES = 16_000_000
BUCKET_BYTES = 16_000_000  # of text, in the mean: what one task holds at a time
_SPANS = pa.schema([(c, pa.int64()) for c in ("key", "row", "s", "e")])
_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("payload", pa.binary())])


def _runs(words: Words, k: int, m: int, hot: np.ndarray):
    """First and last window of each super-k-mer and its deal value; windows of hot minimisers stay single."""
    grams, _ = words.grams(m)
    least = sliding_min(grams, k - m + 1)
    n = words.n - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    inside = words.doc[:n] == words.doc[k - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    value = least[at]
    deal = value
    single = np.isin(value, hot) if len(hot) else np.zeros(len(at), bool)
    if single.any():
        ends, _ = words.grams(1)
        deal = np.where(single, mix(value ^ mix(ends[at]) ^ (mix(ends[at + k - 1]) * np.uint64(3))), value)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (value[1:] != value[:-1]) | single[1:] | single[:-1]
    begin = np.flatnonzero(new)
    last = np.concatenate([begin[1:] - 1, [len(at) - 1]])
    return at[begin], at[last], value[begin], deal[begin]


def _count_minimisers(k: int, m: int, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for _, texts in pieces(rows_of(batch, key, text)):
                words = Words(texts)
                a, b, value, _ = _runs(words, k, m, none)
                if not len(a):
                    continue
                grams, _ = words.grams(k)
                whole = mix(grams[a] ^ mix(grams[b]) ^ (b - a).astype(np.uint64))
                one = np.unique(np.stack([value, whole], 1), axis=0)[:, 0]
                least, n = np.unique(one, return_counts=True)
                often = n >= 2
                values = np.concatenate([least[often].view(np.int64), [0]])
                total = np.concatenate([np.zeros(often.sum(), bool), [True]])
                size = np.concatenate([np.zeros(often.sum(), np.int64), [len(words.bytes)]])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(total), pa.array(np.concatenate([n[often], [len(one)]])), pa.array(size)], names=["value", "total", "n", "size"])

    return run


def _identified(batch: pa.RecordBatch, key: str, text: str) -> Iterator[tuple[tuple[int, int], bytes]]:
    for (i, t), row in zip(rows_of(batch, key, text), batch.column("row").to_pylist(), strict=True):
        yield (i, row), t


def _send(k: int, m: int, key: str, text: str, buckets: int, hot_values: list[int]):
    hot = np.array(hot_values, np.int64).view(np.uint64)

    def flush(held: dict[int, dict[bytes, list]], turn: int) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        settled: list[tuple[int, int, int, int]] = []
        out: list[tuple[int, int, bytes]] = []
        for bucket, strings in held.items():
            names = sorted(strings)
            twice = np.zeros(len(names), np.uint8)
            places_of = np.zeros((3, len(names)), np.int64)  # key, row, first word
            for i, s in enumerate(names):
                places = strings[s]
                if len(places) > 1:
                    twice[i] = 1
                    n = s.count(b" ") + 1
                    settled.extend((d, r, o, o + n) for d, r, o in places)
                else:
                    places_of[:, i] = places[0]
            body = struct.pack("<q", len(names)) + twice.tobytes() + places_of.tobytes() + b"\n".join(names)
            out.append((bucket, 0, pack.compress(body)))
        for i in range(0, len(settled), 50_000):
            out.append(((turn * 7919 + i // 50_000) % buckets, 1, pack.compress(np.array(settled[i : i + 50_000], np.int64).tobytes())))
        for i in range(0, len(out), 64):
            x = out[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in x], pa.int32()), pa.array([r[1] for r in x], pa.int8()), pa.array([r[2] for r in x], pa.binary())], schema=_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        turn = context.partitionId() if context else 0
        held: dict[int, dict[bytes, list]] = defaultdict(dict)
        size = 0
        for batch in batches:
            for keys, texts in pieces(_identified(batch, key, text)):
                words = Words(texts)
                a, b, _, deal = _runs(words, k, m, hot)
                if not len(a):
                    continue
                doc = words.doc[a]
                to = (mix(deal) % np.uint64(buckets)).astype(np.int64)
                lo, hi = words.start[a], words.end[b + k - 1]
                off = a - words.first[doc]
                data = words.bytes
                for d, t, x, y, o in zip(doc.tolist(), to.tolist(), lo.tolist(), hi.tolist(), off.tolist(), strict=True):
                    s = data[x:y]
                    places = held[t].get(s)
                    if places is None:
                        held[t][s] = [(*keys[d], o)]
                        size += y - x + 200
                    else:
                        places.append((*keys[d], o))
                        size += 80
                if size > FLUSH_BYTES:
                    yield from flush(held, turn)
                    held, size = defaultdict(dict), 0
                    turn += 1
        yield from flush(held, turn)

    return run


def _repeated(data: bytes, lo: np.ndarray, hi: np.ndarray, grams: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Which windows occur twice or more: sorted by hash, each run of equal hashes confirmed by its bytes."""
    order = np.argsort(grams, kind="stable")
    sorted_grams = grams[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_grams[1:] != sorted_grams[:-1]
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    length = np.diff(np.concatenate([begin, [len(order)]]))
    sums = np.add.reduceat(times[order], begin) if len(order) else np.zeros(0, np.int64)
    hit = (sums >= 2)[group]
    for i in np.flatnonzero(length > 1):
        rows = order[begin[i] : begin[i] + length[i]].tolist()
        first = data[lo[rows[0]] : hi[rows[0]]]
        if all(data[lo[r] : hi[r]] == first for r in rows[1:]):
            continue
        real: dict[bytes, int] = defaultdict(int)  # unequal windows with one hash
        for r in rows:
            real[data[lo[r] : hi[r]]] += int(times[r])
        hit[begin[i] : begin[i] + length[i]] = [real[data[lo[r] : hi[r]]] >= 2 for r in rows]
    out = np.zeros(len(order), bool)
    out[order] = hit
    return out


def _count_bucket(parts: list[bytes], k: int) -> np.ndarray:
    """(key, row, first word, end word) spans of the repeated windows of one bucket."""
    where: dict[bytes, int] = {}
    times: list[int] = []
    owner, places = [], []
    for body in parts:
        n = struct.unpack_from("<q", body)[0]
        twice = np.frombuffer(body, np.uint8, n, 8)
        place = np.frombuffer(body, np.int64, 3 * n, 8 + n).reshape(3, n)
        ids = np.empty(n, np.int64)
        for i, s in enumerate(body[8 + 25 * n :].split(b"\n") if n else []):
            j = where.setdefault(s, len(times))
            if j == len(times):
                times.append(0)
            times[j] += 1 + int(twice[i])
            ids[i] = j
        single = twice == 0
        owner.append(ids[single])
        places.append(place[:, single])
    if not times:
        return np.zeros((0, 4), np.int64)
    strings = list(where)
    spans: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
    words = Words(strings)
    grams, inside = words.grams(k)
    at = np.flatnonzero(inside)
    hit = at[_repeated(words.bytes, words.start[at], words.end[at + k - 1], grams[at], np.array(times, np.int64)[words.doc[at]])]
    if len(hit):
        doc = words.doc[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        last = np.concatenate([begin[1:] - 1, [len(hit) - 1]])
        run_doc = doc[begin]
        s, e = hit[begin] - words.first[run_doc], hit[last] + k - words.first[run_doc]
        first_run = np.searchsorted(run_doc, np.arange(len(strings)))
        n_runs = np.bincount(run_doc, minlength=len(strings))
        own, (key, version, off) = np.concatenate(owner), np.concatenate(places, axis=1)
        n = n_runs[own]
        row = np.repeat(np.arange(len(own)), n)
        run = first_run[own][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        spans.append(np.stack([key[row], version[row], off[row] + s[run], off[row] + e[run]], 1))
    return np.concatenate(spans)


def _receive(k: int):
    def batch_of(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(x), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[i : i + 100_000, c])) for c in range(4)], schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        now, parts = None, []
        for batch in batches:
            for bucket, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = unpack.decompress(payload)
                if kind == 1:
                    yield from batch_of(np.frombuffer(body, np.int64).reshape(-1, 4))
                    continue
                if bucket != now:
                    yield from batch_of(_count_bucket(parts, k))
                    now, parts = bucket, []
                parts.append(body)
        yield from batch_of(_count_bucket(parts, k))

    return run


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, text): ``row`` tells apart the texts of one key, and of the rows without a key."""
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.col(text).cast("string").alias("text"))
    return texts.select("key", F.xxhash64("text").alias("row"), "text")


def repeated_spans(rows: DataFrame, k: int = 35, m: int = 5) -> DataFrame:
    """(key, row, s, e): word spans of the rows (key, row, text) covered by windows of ``k`` words that start more than once.

    Null and empty texts, and texts under ``k`` words, have no window. A repeated row is another place of each of its
    windows. The number of buckets follows the bytes of all texts, so a bucket's size doesn't.
    """
    spark = rows.sparkSession
    counts = rows.mapInArrow(frugal(_count_minimisers(k, m, "key", "text")), "value long, total boolean, n long, size long")
    counts = counts.groupBy("total", "value").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).persist()
    try:
        total, size = counts.where("total").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        buckets = max(8 * shuffle_partitions(spark), math.ceil(size / BUCKET_BYTES))
        # at most 2 * buckets values can hold half a bucket's share or more
        hot = [r.value for r in counts.where(~F.col("total") & (F.col("n") * 2 * buckets >= total) & (F.col("n") >= 64)).select("value").collect()]
    finally:
        counts.unpersist()
    sent = rows.mapInArrow(frugal(_send(k, m, "key", "text", buckets, hot)), "bucket int, kind tinyint, payload binary")
    dealt = sent.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(frugal(_receive(k)), "key long, row long, s long, e long")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("key")
        kept, n_words, n_removed, digest = [], [], [], []
        for t, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans"), strict=True):
            words = (t.as_py() or b"").split()
            n_words.append(len(words))
            if spans.is_valid:
                drop = np.zeros(len(words) + 1, np.int32)
                flat = spans.values.flatten()
                np.add.at(drop, flat[0].to_numpy(), 1)
                np.add.at(drop, flat[1].to_numpy(), -1)
                gone = np.cumsum(drop)[:-1] > 0
                n_removed.append(int(gone.sum()))
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words))
            digest.append(hashlib.sha256(kept[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest), pa.array(kept, pa.binary()).cast(pa.string())], names=["key", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 35, m: int = 5) -> DataFrame:
    """Every document without the words that a repeated ``k``-word window covers.

    Returns (key, n_words, n_removed, kept_sha256, kept_text), one row per row of ``docs``. Windows are judged on
    the input; all copies of a repeated window go, the first too. Null text counts as empty: no words, the
    digest of the empty string. Every row is judged by its own text, with or without a key, and also where rows of one key have
    different texts; a repeated row makes all its windows repeated. Long texts are cut into windows where they lie. Other
    columns of ``docs`` aren't read, so their names may clash with any here; an empty table gives an empty one.
    """
    texts = _rows(docs, key, text)
    spans = repeated_spans(texts, k, m).groupBy("key", "row").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    kept = texts.join(spans, ["key", "row"], "left").select("key", "text", "spans").mapInArrow(frugal(_keep), "key long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return kept.select(F.nullif(F.col("key"), F.lit(NO_KEY)).alias(key), "n_words", "n_removed", "kept_sha256", "kept_text")
