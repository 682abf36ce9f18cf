"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The rows X stay in blocks where Spark reads them; the driver holds vectors of the embedding's length only. A left vector u is
always X p for a p of that length, so u is never stored: one pass over the blocks forms w = X q, its products with all earlier
left vectors, and X'w. Full reorthogonalisation is arithmetic with these sums, repeated by a second pass where it takes away much.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import frugal, stored

SCALE, SHIFT = 1024.0, 100_000
_ROWS = 4_096  # rows of a block
_LARGEST = float(1 << 53)  # past it the scaled entry is no exact integer any more and counts as this one
_TINY = 1e-13  # of the largest value: a direction below it is none


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of one length as scaled integers, with the sums of each."""
    for batch in batches:
        length = batch.column("v").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        for d in np.unique(length):
            rows = np.flatnonzero(length == d)
            for at in range(0, len(rows), _ROWS):
                part = batch.take(pa.array(rows[at : at + _ROWS]))
                c = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, int(d))
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(SCALE * c), -_LARGEST, _LARGEST).astype(np.int64) + SHIFT
                ids = pa.array([part.column("id").to_pylist()], pa.list_(pa.int64()))
                sums = pa.array([_sum_exact(x)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([int(d)], pa.int32()), pa.array([len(x)], pa.int64()), ids, pa.array([x.astype("<i8").tobytes()], pa.binary()), sums], names=["dim", "n", "ids", "x", "sums"])


def _sum_exact(x: np.ndarray) -> list[str]:
    """Sums of the columns; 4096 numbers of 54 bits may pass a long."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [str((h << 32) + w) for h, w in zip(high.sum(0).tolist(), low.sum(0).tolist(), strict=True)]


class Centre:
    """Number and exact sums of the rows, and how a block is centred before anything is multiplied."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.near = [round(Fraction(s, n)) for s in sums]  # whole numbers next to the means: taken off exactly
        self.rest = np.array([float(Fraction(s, n) - m) for s, m in zip(sums, self.near, strict=True)])

    def rows(self, data: bytes) -> np.ndarray:
        x = np.frombuffer(data, "<i8").reshape(-1, len(self.sums))
        return (x - np.array(self.near, np.int64)).astype(np.float64) - self.rest

    def deviations(self, data: bytes) -> list[int | None]:
        """Sums of squares of n x - S, exact; null where a long can't hold it."""
        x = np.frombuffer(data, "<i8").reshape(-1, len(self.sums))
        reach = max(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n, *map(abs, self.sums), 0) * 2
        if reach <= isqrt((1 << 62) // max(1, len(self.sums))):
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(1).tolist()
        found = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [f if f < 1 << 63 else None for f in found]


def _summed(blocks: DataFrame, centre: Centre, product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of what ``product`` makes of a block's centred rows: a vector of a length that no row count enters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("x"):
                found = product(centre.rows(data.as_py()))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "s"])

    parts = blocks.select("x").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(len(parts))
    for r in parts:
        out[r.i] = r.s
    return out


def bidiagonalise(blocks: DataFrame, centre: Centre, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(right vectors as columns, upper bidiagonal matrix) of the centred rows: X V = U B with orthonormal U and V.

    A pass for each step. It runs until V spans the space, so equal singular values are found as often as they occur; where a
    step leads nowhere new, the next one starts from a fresh vector.
    """
    d = len(centre.sums)
    rng = np.random.default_rng(seed)
    right, back = np.zeros((d, 0)), np.zeros((d, 0))  # v_j, and p_j with u_j = X p_j
    forth = np.zeros((d, 0))  # X'u_j
    main, above = [], []
    v, beta, scale = _fresh(right, rng), 0.0, 0.0
    while right.shape[1] < d:
        k = right.shape[1]
        q = v - (beta * back[:, -1] if k else 0.0)
        for again in range(2):
            left = back

            def product(x: np.ndarray, q=q, left=left) -> np.ndarray:
                w = x @ q
                return np.concatenate([[w @ w], x.T @ w, (x @ left).T @ w])

            sums = _summed(blocks, centre, product)
            if not len(sums):
                sums = np.zeros(1 + d + k)
            ww, xw, onto = float(sums[0]), sums[1 : 1 + d], sums[1 + d :]
            q, xw = q - back @ onto, xw - forth @ onto
            kept = ww - float(onto @ onto)
            if again or kept > 0.5 * ww or kept <= (_TINY * scale) ** 2:
                break
        alpha = float(np.sqrt(max(kept, 0.0)))
        scale = max(scale, alpha)
        right = np.column_stack([right, v])
        if alpha <= _TINY * scale or alpha == 0.0:
            alpha, p, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            p, z = q / alpha, xw / alpha
        main.append(alpha)
        back, forth = np.column_stack([back, p]), np.column_stack([forth, z])
        if right.shape[1] == d:
            break
        z = z - alpha * v
        for _ in range(2):
            z = z - right @ (right.T @ z)
        beta = float(np.linalg.norm(z))
        scale = max(scale, beta)
        if beta <= _TINY * scale or beta == 0.0:
            v, beta = _fresh(right, rng), 0.0
        else:
            v = z / beta
        above.append(beta)
    return right, np.diag(main) + np.diag(above, 1)


def _fresh(right: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A unit vector orthogonal to the columns of ``right``."""
    v = rng.standard_normal(len(right))
    for _ in range(2):
        v = v - right @ (right.T @ v)
        v = v / np.linalg.norm(v)
    return v


class Whitening:
    """Components (rows of ``vectors``), their variances and the total variance of fitted rows."""

    def __init__(self, centre: Centre, vectors: np.ndarray, variances: np.ndarray, total: float):
        self.centre, self.vectors, self.variances, self.total = centre, vectors, variances, total


def fit_whitening(blocks: DataFrame, components: int) -> Whitening | None:
    """The leading components of all stored blocks; None where there is no row.

    Signs are such that a component's largest entry is positive. Directions without variance are no components.
    """
    found = blocks.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    if not found:
        return None
    centre = Centre(found[0].n, [int(r.s) for r in found])
    right, small = bidiagonalise(blocks, centre)
    _, values, turned = np.linalg.svd(small)
    kept = values[:components] > _TINY * values[0] if len(values) else np.zeros(0, bool)
    vectors = (turned @ right.T)[:components][kept]
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    variances = values[:components][kept] ** 2 / centre.n
    spread = _summed(blocks, centre, lambda x: np.array([(x * x).sum()]))
    return Whitening(centre, vectors, variances, float(spread[0]) / centre.n)


def _identity_error(blocks: DataFrame, fitted: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity; their mean comes off first."""
    turn = (fitted.vectors / np.sqrt(fitted.variances)[:, None]).T
    mean = _summed(blocks, fitted.centre, lambda x: (x @ turn).sum(0)) / fitted.centre.n

    def product(x: np.ndarray) -> np.ndarray:
        w = x @ turn - mean
        return (w.T @ w).ravel()

    cov = _summed(blocks, fitted.centre, product).reshape(turn.shape[1], -1) / fitted.centre.n
    return float(np.abs(cov - np.eye(len(cov))).max())


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): each row's leading components, whitened.

    Rows whose vector is null, empty or has null or non-finite entries are dropped. So are vectors of another length than the commonest (of
    equally common ones the shortest). Entries are scaled by 1024, rounded down and shifted by 100000; scaled entries past 2^53
    count as that. ``deviation`` is null where a long can't hold it. Components without variance have no rows, so equal
    vectors, a single one and an empty table give none. Rows without a key and repeated rows stay and count each. Columns other
    than key and vector aren't read, so their names may clash with any here.

    Every pass reads the stored blocks and returns sums whose length depends on the vectors' length alone.
    """
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.coalesce(finite, F.lit(False)) & (F.size(v) > 0))
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    blocks = stored(rows.mapInArrow(frugal(_block_rows), "dim int, n long, ids array<long>, x binary, sums array<string>"), "blocks")
    dims = blocks.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").first()  # a row for each length
    if dims is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", key)
    blocks = blocks.where(F.col("dim") == dims.dim)
    fitted = fit_whitening(blocks, components)
    if not len(fitted.vectors):
        return spark.createDataFrame([], schema).withColumnRenamed("id", key)
    error = _identity_error(blocks, fitted)
    centre, variances, k = fitted.centre, fitted.variances, len(fitted.vectors)
    turn = (fitted.vectors / np.sqrt(variances)[:, None]).T
    explained = variances / fitted.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = centre.rows(row["x"]) @ turn
                m = len(w)
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [pa.array(row["ids"], pa.int64()).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n))]
                columns += [pa.array(centre.deviations(row["x"]), pa.int64()).take(each), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.select("ids", "x").mapInArrow(frugal(run), schema).withColumnRenamed("id", key)
