"""Near-duplicate documents by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, banded and verified.

Each (shingle, weight) is a Poisson process over the weights [0, w): the unit interval, then [1, 2), [2, 4), [4, 8) and so
on, each with its own sequence of points at a rate of its length, drawn from the shingle's hash alone. A point
falls on a weight of its interval and counts where that is below w, which is what splitting the interval further would
decide, so weights need no rounding. A register keeps the earliest point dealt to it; two multisets agree in
a register with a chance of their weighted Jaccard similarity. Points are drawn in order of time and a process stops
when it is later than all registers, so a long document costs little more than one point per shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.components import connected_components
from panelwright.llm.scratch import frugal, join_spread, shuffle_partitions, stored
from panelwright.llm.textnum import Words, mix, pieces, rows_of

SHINGLE = 5
BANDS, ROWS = 28, 6
REGISTERS = BANDS * ROWS
LEADERS = 8
BUCKET_BLOCK = 2048
BLOCK_SHINGLES = 500  # a document counts once for so many in a block
SALT_MEMBERS = 256


def shingle_counts(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of the distinct ``k``-word shingles, sorted by document and hash.

    A document of fewer words than ``k`` has one shingle, all its words; one without words has none.
    """
    words = Words(texts)
    grams, inside = words.grams(k)
    at = np.flatnonzero(inside)
    doc, gram = words.doc[at], grams[at]
    n_words = np.diff(words.first)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for n in np.unique(n_words[short]):
            pick = n_words[short] == n
            g, _ = words.grams(int(n))
            own[pick] = mix(g[words.first[short[pick]]] + np.uint64(n))
        doc, gram = np.concatenate([doc, short]), np.concatenate([gram, own])
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], gram[begin], np.diff(np.concatenate([begin, [len(doc)]]))


def bag_signatures(doc: np.ndarray, gram: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """The registers (times of their first points; infinite without shingles) of each document."""
    sig = np.full(n_docs * registers, np.inf)
    e_doc, e_seed, e_low, e_rate, e_w = [doc], [mix(gram)], [np.zeros(len(doc))], [np.ones(len(doc))], [weight]
    low = 1
    while len(weight) and low < weight.max():
        pick = weight > low
        e_doc.append(doc[pick])
        e_seed.append(mix(gram[pick] + np.array([0x632BE59BD9B4E019], np.uint64) * np.array([low], np.uint64)))
        e_low.append(np.full(pick.sum(), float(low)))
        e_rate.append(np.full(pick.sum(), float(low)))  # [low, 2 * low)
        e_w.append(weight[pick])
        low *= 2
    d, seed, lo, rate, w = (np.concatenate(x) for x in (e_doc, e_seed, e_low, e_rate, e_w))
    t = np.zeros(len(d))
    drawn = np.uint64(0)
    unit = 1.0 / (1 << 53)
    while len(d):
        burst = 1 if len(d) > 20_000 else 4 if len(d) > 2_000 else 16
        c = drawn + np.arange(1, burst + 1, dtype=np.uint64)
        bits = mix(seed[:, None] + c * np.uint64(0x9E3779B97F4A7C15))
        more = mix(bits ^ np.uint64(0xD6E8FEB86659FD93))
        gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * unit) / rate[:, None]
        times = np.cumsum(np.concatenate([t[:, None], gap], axis=1), axis=1)[:, 1:]  # one order of sums whatever the burst
        register = ((more >> np.uint64(40)) % np.uint64(registers)).astype(np.int64)
        spot = lo[:, None] + rate[:, None] * ((more & np.uint64(0xFFFFFFFFFF)).astype(np.float64) / (1 << 40))
        ok = spot < w[:, None]
        np.minimum.at(sig, (d[:, None] * registers + register)[ok], times[ok])
        drawn += np.uint64(burst)
        live = times[:, -1] < sig.reshape(n_docs, registers).max(axis=1)[d]
        d, seed, lo, rate, w, t = d[live], seed[live], lo[live], rate[live], w[live], times[live, -1]
    return sig.reshape(n_docs, registers)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, -1)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2]).copy()
    for i in range(bits.shape[2]):
        key = mix(key * np.uint64(3) + bits[:, :, i])
    return key.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        named = zip(batch.column("key").to_pylist(), batch.column("digest").to_pylist(), strict=True)
        for names, texts in pieces(((name, t) for name, (_, t) in zip(named, rows_of(batch, "key", "text"), strict=True))):
            doc, gram, n = shingle_counts(texts)
            sig = bag_signatures(doc, gram, n, len(texts))
            some = np.bincount(doc, minlength=len(texts)) > 0
            bands = band_keys(sig)
            low = (mix(sig.view(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*names, strict=True), (pa.int64(), pa.binary()), strict=True)), pa.array([b.tolist() if s else [] for b, s in zip(bands, some.tolist(), strict=True)], pa.list_(pa.int64())), pa.array([x.tobytes() for x in low], pa.binary()), pa.array(np.bincount(doc, minlength=len(texts)), pa.int64())], names=["key", "digest", "bands", "sketch", "size"])


def _overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sums of the lesser and of the greater counts of two multisets."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), max(0, len(b[0]) - 1))
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    low = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return low, int(a[1].sum() + b[1].sum()) - low


def _verify(similarity: float):
    """Reads rows sorted by (leader, salt, member), the leader's own row first, and keeps members like the leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bag = None, None
        for batch in batches:
            lead, salt = batch.column("a").to_pylist(), batch.column("salt").to_pylist()
            ids = batch.column("b").to_pylist()
            texts = batch.column("text").cast(pa.binary())
            at = 0
            found: list[tuple[int, int, float]] = []
            for _, part in pieces(((0, x.as_py() or b"") for x in texts)):
                doc, gram, n = shingle_counts(part)
                bound = np.searchsorted(doc, np.arange(len(part) + 1))
                for i in range(len(part)):
                    own = gram[bound[i] : bound[i + 1]], n[bound[i] : bound[i + 1]]
                    if (lead[at], salt[at]) != now:
                        now, bag = (lead[at], salt[at]), None
                    if ids[at] is None:  # the leader's row
                        bag = own
                    elif bag is not None:
                        low, high = _overlap(bag, own)
                        if high and low >= similarity * high - 1e-9:
                            found.append((lead[at], ids[at], low / high))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return run


def _least_agreement(similarity: float, registers: int = REGISTERS) -> float:
    """Four standard deviations below the similarity: signatures that agree less rule it out."""
    return similarity - 4 * (similarity * (1 - similarity) / registers) ** 0.5


def _likely(similarity: float, registers: int = REGISTERS):
    """Pairs whose signatures don't rule the similarity out."""
    least = _least_agreement(similarity, registers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, registers) for c in ("sa", "sb"))
            keep = (x == y).mean(axis=1) >= least if len(x) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """((band, at, i, j), its rows of (key, class, own, value)) of batches sorted by block pair."""
    now, rows = None, []
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != value}
        for r, v in enumerate(_values(batch, value)):
            group = (c["band"][r], c["at"][r], c["i"][r], c["j"][r])
            if group != now:
                if rows:
                    yield now, rows
                now, rows = group, []
            rows.append((c["key"][r], c["c"][r], c["own"][r], v))
    if rows:
        yield now, rows


def _values(batch: pa.RecordBatch, value: str) -> Iterator:
    """(sketch, band keys) of a batch, or (shingles, counts) of each text, so that no more than a piece of texts is held."""
    if value == "marks":
        marks = batch.column(value)
        yield from zip(marks.field("sketch").to_pylist(), marks.field("bands").flatten().to_numpy().reshape(-1, BANDS), strict=True)
        return
    for _, texts in pieces(((0, x.as_py() or b"") for x in batch.column(value).cast(pa.binary()))):
        doc, gram, n = shingle_counts(texts)
        bound = np.searchsorted(doc, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            yield gram[bound[i] : bound[i + 1]].copy(), n[bound[i] : bound[i + 1]].astype(np.int32)


def _sides(cls: np.ndarray, own: np.ndarray, same_block: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(x, those to be compared with x): all pairs of different classes, reached from outside of the largest class."""
    names, at, n = np.unique(cls, return_inverse=True, return_counts=True)
    for x in np.flatnonzero(at != n.argmax()):
        yield int(x), np.flatnonzero((at != at[x]) & (same_block | (own != own[x])))


def _bucket_members(similarity: float):
    """The rows of each block pair that have a likely partner of another class in it.

    A pair counts in the first band whose full key it shares only, so it is judged once, not once per band.
    """
    least = _least_agreement(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, at, i, j), rows in _groups(batches, "marks"):
            key, cls, own = (np.array([r[k] for r in rows]) for k in range(3))
            sketch = np.frombuffer(b"".join(r[3][0] for r in rows), np.uint8).reshape(-1, REGISTERS)
            bands = np.array([r[3][1] for r in rows])
            keep = np.zeros(len(rows), bool)
            for x, others in _sides(cls, own, i == j):
                others = others[(sketch[others] == sketch[x]).mean(axis=1) >= least]
                others = others[(bands[others] == bands[x]).argmax(axis=1) == at]
                keep[others] = True
                keep[x] |= len(others) > 0
            n = int(keep.sum())
            if n:
                same = [pa.array([v] * n, t) for v, t in ((band, pa.int64()), (at, pa.int32()), (i, pa.int32()), (j, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(key[keep]), pa.array(cls[keep]), pa.array(own[keep])], names=["band", "at", "i", "j", "key", "c", "own"])

    return run


def _bucket_links(similarity: float):
    """Links that join the classes of a block pair: exact overlaps of all its pairs, and one pair for each union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, i, j), rows in _groups(batches, "text"):
            key, cls, own = (np.array([r[k] for r in rows]) for k in range(3))
            size = np.array([len(r[3][0]) for r in rows])
            total = np.array([int(r[3][1].sum()) for r in rows])
            _, gram, seen = np.unique(np.concatenate([r[3][0] for r in rows]), return_inverse=True, return_counts=True)
            shared = seen[gram] > 1  # a shingle of one document only adds to no overlap
            doc, count = np.repeat(np.arange(len(rows)), size)[shared], np.concatenate([r[3][1] for r in rows])[shared]
            gram = gram[shared]
            bound = np.searchsorted(doc, np.arange(len(rows) + 1))
            own_count = np.zeros(len(seen), np.int32)
            parent = {c: c for c in cls.tolist()}

            def root(c: int, parent: dict = parent) -> int:
                while parent[c] != c:
                    c = parent[c]
                return c

            found = []
            for x, others in _sides(cls, own, i == j):
                mine = slice(bound[x], bound[x + 1])
                own_count[gram[mine]] = count[mine]
                sums = np.concatenate([[0], np.cumsum(np.minimum(count, own_count[gram]), dtype=np.int64)])
                own_count[gram[mine]] = 0
                low = sums[bound[others + 1]] - sums[bound[others]]
                high = total[x] + total[others] - low
                for k in np.flatnonzero((low >= similarity * high - 1e-9) & (high > 0)):
                    p, q = root(int(cls[x])), root(int(cls[others[k]]))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        found.append((*sorted((int(key[x]), int(key[others[k]]))), low[k] / high[k]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return run


class _Corpus:
    def __init__(self, docs: DataFrame, sketches: DataFrame, similarity: float):
        self.docs, self.sketches, self.similarity = docs, sketches, similarity

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), a < b, whose multisets overlap enough: sketches first, then the texts themselves.

        The text of a pair's first document meets those of its partners in one sorted run; a document with many
        partners has its text sent to several runs, ``SALT_MEMBERS`` partners or so in each.
        """
        s = self.sketches
        near = pairs.join(s.select(F.col("key").alias("a"), F.col("sketch").alias("sa")).hint("merge"), "a").join(s.select(F.col("key").alias("b"), F.col("sketch").alias("sb")).hint("merge"), "b")
        near = stored(near.select("a", "b", "sa", "sb").mapInArrow(frugal(_likely(self.similarity)), "a long, b long"), "near")
        return self.confirmed(near)

    def confirmed(self, near: DataFrame) -> DataFrame:
        """Those of the pairs whose texts' multisets overlap enough."""
        many = near.groupBy("a").agg(F.ceil(F.count("*") / SALT_MEMBERS).alias("salts"))
        members = near.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b", F.col("b").alias("key"))
        leaders = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("key"))
        texts = self.docs.join(members.unionByName(leaders).hint("merge"), "key").select("a", "salt", "b", "text")
        runs = texts.repartition(shuffle_partitions(self.docs.sparkSession), "a", "salt").sortWithinPartitions(F.col("a"), F.col("salt"), F.col("b").asc_nulls_first())
        return stored(runs.mapInArrow(frugal(_verify(self.similarity)), "a long, b long, similarity double").dropDuplicates(["a", "b"]), "links")

    def by_block(self, rows: DataFrame, of: DataFrame, value: str) -> DataFrame:
        """``rows`` with the ``value`` of their key, those of a block pair together."""
        group = ("band", "at", "i", "j")
        met = rows.join(of.select("key", value).hint("merge"), "key")
        return met.repartition(shuffle_partitions(self.docs.sparkSession), *group).sortWithinPartitions(*group, "key").select(*group, "key", "c", "own", value)


def _ordered(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def minhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """(key, text_md5, class_id, n_links, kept), one row per row of ``docs``.

    Two texts are linked where the weighted Jaccard similarity of their multisets of five-word shingles is ``similarity`` or more;
    classes are what links connect, named by the least key of their rows; the rows that have it are kept. ``n_links`` counts the verified links of a
    text to others that were needed to find the classes; which ones these are can differ between runs.
    Keys are longs. Rows are judged by their own texts: a repeated row shares the decision of its first, and of a key with several texts
    each row goes with the class of its text, ``text_md5`` telling them apart. Null, empty and blank texts are
    never duplicates and keep a class of their own; a row without a key is compared with nothing and kept, its class null.
    An empty table gives an empty one. Other columns, whatever their names, are not read.

    Equal texts are met first by digest and are one from there on, under a number of their own. Each bucket of a band then compares its members with its least and its
    greatest, then, where several classes are left in it, with ``LEADERS`` random members. What still lies apart is
    compared within the bucket by signatures, in block pairs of ``BUCKET_BLOCK`` members (fewer long ones); the members
    that these don't rule out meet again in their block with their texts, all pairs of different classes are verified
    there, and the links that join classes come out. So no link across classes is lost to the choice of leaders, and
    no pairs are put out to be dropped.
    """
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    blank = F.length(F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))) == 0
    docs = docs.withColumn("digest", F.unhex(F.md5("text"))).withColumn("judged", F.col("key").isNotNull() & F.coalesce(~blank, F.lit(False)))
    digests = stored(docs.select("key", "digest", "judged"), "digests")
    firsts = digests.where("judged").groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    firsts = stored(firsts.withColumn("node", F.monotonically_increasing_id()), "firsts")
    own = firsts.select("digest", F.col("least").alias("key"), "node")  # where a text stands
    sketches = stored(docs.where("judged").mapInArrow(frugal(_sketch), "key long, digest binary, bands array<long>, sketch binary, size long"), "sketches")
    sketches = sketches.join(own.hint("merge"), ["digest", "key"]).dropDuplicates(["node"])
    sketches = stored(sketches.select(F.col("node").alias("key"), "bands", "sketch", "size").where("size(bands) > 0"), "sketches")
    rows = sketches.select(F.posexplode("bands").alias("at", "band"), "key", F.greatest(F.lit(1.0), F.col("size") / BLOCK_SHINGLES).alias("weight"))
    ends = rows.groupBy("band", "at").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).where("n > 1")
    full = stored(rows.join(ends.hint("merge"), ["band", "at"]).select("band", "at", "key", "weight", "lo", "hi", "n"), "buckets")
    met = own.join(full.select(F.col("key").alias("node")).distinct().hint("merge"), "node")
    texts = docs.join(met.hint("merge"), ["digest", "key"]).select(F.col("node").alias("key"), "text").dropDuplicates(["key"])
    corpus = _Corpus(stored(texts, "texts"), sketches.select("key", "sketch"), similarity)
    stars = full.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("key").alias("b")), F.struct(F.col("hi").alias("a"), F.col("key").alias("b")))).alias("p")).select("p.*")
    links = corpus.verified(_ordered(stars))
    classes = stored(connected_components(links), "classes")
    for last in (False, True):
        # what the leaders left apart
        held = full.where("n > 2").join(classes.withColumnRenamed("node", "key"), "key", "left").select("band", "at", "key", "weight", F.coalesce("component", "key").alias("c"))
        apart = held.groupBy("band", "at").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.sum("weight").alias("weight"), *[F.min(F.struct(F.xxhash64("key", F.lit(r)).alias("h"), F.col("key").alias("a"), F.col("c").alias("ca"))).alias(f"l{r}") for r in range(LEADERS)]).where("c0 <> c1")
        left = stored(held.drop("weight").join(apart.hint("merge"), ["band", "at"]), "apart")
        if left.isEmpty():
            break
        if not last:
            leaders = F.array(*[F.struct(F.col(f"l{r}.a").alias("a"), F.col(f"l{r}.ca").alias("ca")) for r in range(LEADERS)])
            others = F.array_distinct(F.filter(leaders, lambda x: x["ca"] != F.col("c")))  # of other classes only, each once
            stars = left.select("key", F.explode(others).alias("l"))
            pairs = _ordered(stars.select(F.col("l.a").alias("a"), F.col("key").alias("b"))).join(links.select("a", "b"), ["a", "b"], "left_anti")
            more = corpus.verified(pairs)
        else:
            blocks = F.greatest(F.ceil(F.col("weight") / BUCKET_BLOCK), F.lit(1)).cast("int")
            rows = left.select("band", "at", "key", "c", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
            rows = rows.withColumn("x", F.explode(F.expr("sequence(0, blocks - 1)"))).select("band", "at", "key", "c", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), (F.col("block") <= F.col("x")).alias("own"))
            marks = sketches.select("key", F.struct("bands", "sketch").alias("marks"))
            near = corpus.by_block(rows, marks, "marks").mapInArrow(frugal(_bucket_members(similarity)), "band long, at int, i int, j int, key long, c long, own boolean")
            near = corpus.by_block(stored(near, "near"), corpus.docs, "text")
            more = stored(near.mapInArrow(frugal(_bucket_links(similarity)), "a long, b long, similarity double").dropDuplicates(["a", "b"]), "links")
        if not more.isEmpty():
            links = stored(links.unionByName(more), "links")
            classes = stored(connected_components(links), "classes")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    joined = stored(classes.join(degree, "node").join(firsts, "node").select("digest", "least", "component", "n_links"), "joined")
    names = joined.groupBy("component").agg(F.min("least").alias("class"), F.count("*").alias("members"))
    named = join_spread(joined, stored(names, "names"), "component", "members").select("digest", "class", "n_links")
    facts = firsts.join(named.hint("merge"), "digest", "left").select("digest", "n", F.coalesce("class", "least").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    judged = join_spread(digests.where("judged"), stored(facts, "facts"), "digest", "n")
    rest = digests.where("NOT judged").withColumns({"class": F.col("key"), "n_links": F.lit(0).cast("long")})
    out = judged.unionByName(rest)
    return out.select(F.col("key").alias(key), F.lower(F.hex("digest")).alias("text_md5"), F.col("class").alias("class_id"), "n_links", F.col("class").eqNullSafe(F.col("key")).alias("kept"))
