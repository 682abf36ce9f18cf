"""Near-duplicate vectors by sorted projection passes.

In each pass the vectors are put in the lexicographic order of a concatenation of random sign hashes, cut into blocks
of equal length, and each block is compared with itself and the next; similar vectors share long prefixes in some
pass and so meet in a window. Links are verified and counted where the blocks meet.

The number of passes counts on vectors that share their first log2(n / block) hashes to meet. Where more than a window
of them do, as in a cluster with a large share of the rows, all pairs of blocks of such a prefix are compared as well,
block by block.

A pair may meet in many passes. Every vector carries its blocks and prefixes of all passes, so a block
comparison knows by itself whether two vectors have met before: each link counts in its first pass only, and what comes out is a
row for each vector, not for each pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.components import connected_components
from panelwright.llm.scratch import frugal, join_spread, shuffle_partitions, stored

BLOCK = 512
HASH_BITS = 48
HITS = 1 << 20  # hits times passes looked at together


def passes_needed(n: int, threshold: float, miss: float, block: int = BLOCK) -> int:
    """Passes after which a pair at the threshold has failed to meet with a chance of ``miss`` at most.

    Two vectors at angle a agree in a sign hash with chance 1 - a / pi, and meet where they agree in the
    first log2(n / block) of them.
    """
    if n <= 2 * block:
        return 1
    agree = (1 - math.acos(threshold) / math.pi) ** math.log2(n / block)
    return max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def prefix_bits(n: int, block: int = BLOCK) -> int:
    """The hashes which ``passes_needed`` counts on, rounded down: vectors that agree in them are all compared."""
    return min(HASH_BITS, max(0, math.floor(math.log2(max(1, n) / block))))


def _keys(passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        power = (np.int64(1) << np.arange(HASH_BITS, dtype=np.int64))[::-1]
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                part = batch.take(pa.array(rows))
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(d))
                if int(d) not in planes:
                    planes[int(d)] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), passes * HASH_BITS))
                bits = (x @ planes[int(d)] > 0).reshape(len(rows), passes, HASH_BITS)
                code = bits @ power
                n = len(rows) * passes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(passes, dtype=np.int32), len(rows))), pa.array(np.full(n, d, np.int32)), pa.array(code.ravel()), part.column("digest").take(pa.array(np.repeat(np.arange(len(rows)), passes)))], names=["pass", "dim", "code", "digest"]
                )

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the part and each row's place in it, counted per (pass, dim)."""
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        p, d = batch.column("pass").to_numpy(), batch.column("dim").to_numpy()
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
        begin = np.flatnonzero(new)
        at = np.arange(len(p)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(p)]])))
        for i, n in zip(begin.tolist(), np.diff(np.concatenate([begin, [len(p)]])).tolist(), strict=True):
            k = (int(p[i]), int(d[i]))
            at[i : i + n] += seen.get(k, 0)
            seen[k] = seen.get(k, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), part, np.int32)), batch.column("pass"), batch.column("dim"), pa.array(at), batch.column("prefix"), batch.column("digest")], names=["part", "pass", "dim", "at", "prefix", "digest"])


def _hits(table: pa.Table, threshold: float, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (p, q) of a block comparison that are linked and haven't met in an earlier pass, a part of the block at a time."""
    own = np.array(table.column("own").to_pylist(), bool)
    n = len(own)
    x, blocks, prefixes = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("v", "blocks", "prefixes"))
    a, b = np.flatnonzero(own), np.flatnonzero(~own)
    step = max(1, HITS // max(1, n * blocks.shape[1]))
    for k in range(0, len(a), step):
        rows = a[k : k + step]
        for others in (b, a) if within else (b,):
            at = np.argwhere(x[rows] @ x[others].T >= threshold)
            p, q = rows[at[:, 0]], others[at[:, 1]]
            if others is a:
                p, q = p[p < q], q[p < q]
            new = ~((np.abs(blocks[p] - blocks[q]) <= 1) | (prefixes[p] == prefixes[q])).any(axis=1)
            if new.any():
                yield p[new], q[new]


def _compare(threshold: float, within: bool):
    """For each vector of a block comparison with new links: how many rows they lead to, and the least key they connect it with."""

    def run(table: pa.Table) -> pa.Table:
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        n = np.zeros(len(ids), np.int64)
        order = np.argsort(ids, kind="stable")
        root = np.empty(len(ids), np.int64)  # a row's place in the order of keys
        root[order] = np.arange(len(ids))
        for p, q in _hits(table, threshold, within):
            other = ids[p] != ids[q]
            np.add.at(n, p, np.where(other, copies[q], 0))
            np.add.at(n, q, np.where(other, copies[p], 0))
            while True:
                before = root.copy()
                np.minimum.at(root, p, root[q])
                np.minimum.at(root, q, root[p])
                root = root[order][root]  # the root's own root
                if (before == root).all():
                    break
        some = np.flatnonzero(n)
        return pa.table({"digest": table.column("digest").take(pa.array(some)), "id": pa.array(ids[some]), "n": pa.array(n[some]), "root": pa.array(ids[order[root[some]]])})

    return run


def _pairs(threshold: float, within: bool):
    """The new links of a block comparison themselves."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        found = [np.sort(np.stack([ids[p], ids[q]], 1), axis=1) for p, q in _hits(table, threshold, within)]
        both = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        both = both[both[:, 0] != both[:, 1]]
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    return run


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The comparable rows at length 1 in double precision, and the digest of the vector as given."""
    for batch in batches:
        length = pc.fill_null(pc.list_value_length(batch.column("v")), 0).to_numpy(zero_copy_only=False)
        some = (length > 0) & batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        for d in np.unique(length[some]):
            rows = np.flatnonzero(some & (length == d))
            part = batch.take(pa.array(rows))
            x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), int(d)) + 0.0  # no signed zeros
            top = np.abs(x).max(axis=1)
            good = np.flatnonzero(np.isfinite(x).all(axis=1) & (top > 0))
            x = np.ascontiguousarray(x[good])
            digest = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x]
            x = x / top[good][:, None]  # no overflow in the squares
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(d)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(good)), pa.array(np.full(len(x), d, np.int32)), lists, pa.array(digest, pa.binary())], names=["id", "dim", "v", "digest"])


def _unit(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return stored(rows.mapInArrow(frugal(_unit_rows), "id long, dim int, v array<double>, digest binary"), "unit")


def _first_of_each(unit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, rep, copies) of every vector, and the rows of the reps with their copies."""
    firsts = stored(unit.groupBy("digest").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies")), "firsts")
    reps = unit.join(firsts.withColumnRenamed("rep", "id").hint("merge"), ["id", "digest"]).dropDuplicates(["id", "digest"])
    return firsts, stored(reps.select("digest", "id", "copies", "dim", "v"), "reps")


def _met(reps: DataFrame, threshold: float, miss: float, seed: int, compare, out: str) -> DataFrame:
    """What ``compare`` puts out on all block comparisons of all passes."""
    spark = reps.sparkSession
    n = reps.count()
    passes = passes_needed(n, threshold, miss)
    codes = reps.select("digest", "dim", "v").mapInArrow(frugal(_keys(passes, seed)), "pass int, dim int, code long, digest binary")
    ordered = codes.repartitionByRange(shuffle_partitions(spark), "pass", "dim", "code", "digest").sortWithinPartitions("pass", "dim", "code", "digest")
    ordered = ordered.select("pass", "dim", F.shiftright("code", HASH_BITS - prefix_bits(n)).alias("prefix"), "digest")
    placed = stored(ordered.mapInArrow(_number, "part int, pass int, dim int, at long, prefix long, digest binary"), "order")
    sizes = placed.groupBy("pass", "dim", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("pass", "dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each part and pass at most
    base = F.broadcast(sizes.select("pass", "dim", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    ranked = placed.join(base, ["pass", "dim", "part"]).select("pass", "dim", "prefix", "digest", F.floor((F.col("base") + F.col("at")) / BLOCK).cast("long").alias("block"))
    hot = ranked.groupBy("pass", "dim", "prefix").agg(F.min("block").alias("s"), F.max("block").alias("e")).where("e - s >= 2")
    places = ranked.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("pass", "block", "prefix"))).alias("at"))  # one for each pass
    vectors = stored(reps.join(places.hint("merge"), "digest"), "vectors")
    every = vectors.select("digest", "id", "copies", "dim", "v", "at", F.posexplode("at.block").alias("pass", "block")).withColumns({"prefix": F.get("at.prefix", "pass"), "blocks": F.slice("at.block", F.lit(1), F.col("pass")), "prefixes": F.slice("at.prefix", F.lit(1), F.col("pass"))})
    payload = ["digest", "id", "copies", "v", "blocks", "prefixes"]
    ends = F.array(F.struct(F.col("block").alias("i"), F.lit(True).alias("own")), F.struct((F.col("block") - 1).alias("i"), F.lit(False).alias("own")))
    dealt = every.select("pass", "dim", *payload, F.inline(ends)).where("i >= 0")
    found = stored(dealt.groupBy("pass", "dim", "i").applyInArrow(compare(threshold, True), out), "found")
    hot = stored(hot, "hot")
    if hot.isEmpty():
        return found
    meets = hot.select("pass", "dim", "prefix", "s", "e", F.explode(F.expr("sequence(s, e - 2)")).alias("x")).select("pass", "dim", "prefix", "x", F.explode(F.expr("sequence(x + 2, e)")).alias("y"))
    sides = F.array(F.struct(F.col("x").alias("block"), F.lit(True).alias("own")), F.struct(F.col("y").alias("block"), F.lit(False).alias("own")))
    meets = meets.select("pass", "dim", "prefix", "x", "y", F.inline(sides))
    wide = every.select("pass", "dim", "prefix", "block", *payload).join(meets, ["pass", "dim", "prefix", "block"])
    return found.unionByName(stored(wide.groupBy("pass", "dim", "prefix", "x", "y").applyInArrow(compare(threshold, False), out), "found"))


def similar_pairs(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, miss: float = 0.01, seed: int = 7) -> DataFrame:
    """(a, b), a < b: pairs of different vectors whose cosine, in double precision, is ``threshold`` or more, by their least keys.

    None below the threshold is returned; a pair at the threshold is missed with a chance of ``miss`` at most. Null,
    zero and non-finite vectors, and vectors of different lengths, link with nothing; nor do rows without a key.
    Equal vectors are one, under the least of their keys.
    """
    return _met(_first_of_each(_unit(vectors, key, vector))[1], threshold, miss, seed, _pairs, "a long, b long").distinct()


def embedding_dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, miss: float = 0.01, seed: int = 7) -> DataFrame:
    """(key, n_links, component_id, kept), one row per row of ``vectors``.

    ``component_id`` is the least key reachable by links, itself included; ``kept`` marks the row that has it. Vectors
    that can't be compared (null, empty, zero, with null or non-finite components) stand alone, as do rows without a key,
    whose component is null and which are kept. Repeated rows of one key don't link with each other, and a key with several
    vectors has the links of each. An empty table gives an empty one. Other columns aren't read, so their names may
    clash with any here.

    Equal vectors are met by digest, and only the first of each goes on to be compared; the others have its links and
    each other's. Links are counted where blocks meet, without a row for a pair.
    """
    unit = _unit(vectors, key, vector)
    firsts, reps = _first_of_each(unit)
    found = _met(reps, threshold, miss, seed, _compare, "digest binary, id long, n long, root long")
    others = found.groupBy("digest").agg(F.sum("n").alias("others"))
    classes = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    named = firsts.join(others.hint("merge"), "digest", "left").join(classes.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    named = named.select("digest", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"), "copies")
    own = stored(unit.select("id", "digest").distinct(), "own")
    by_key = join_spread(own, stored(named, "named"), "digest", "copies").groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component").alias("component"))
    out = vectors.select(F.col(key).alias("key")).join(by_key.hint("merge"), F.col("key") == F.col("id"), "left")
    component = F.coalesce("component", F.col("key").cast("long"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
