"""Whitening of embeddings: the leading eigenvectors of their covariance by matrix-free block Lanczos.

The covariance is never formed. A pass of all rows multiplies it with a block of vectors: each task centres its rows and sums
x (x^T B), and Spark adds the tasks' sums. The driver keeps a basis of such blocks, orthogonal to each other in full, twice over; the
Ritz vectors of the basis are accepted when the residuals of all wanted ones, taken from the products themselves, are at rounding. A block that
falls into the basis (breakdown) is filled up with fresh directions, and before the pairs are accepted a restart from fresh directions must find none above them. The driver holds dimension x basis numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.llm.arrow import pieces

SCALE, SHIFT = 64, 1_000_000
#: Vectors multiplied in one pass.
BLOCK = 16
#: A Ritz pair is accepted if its residual is under this share of the largest eigenvalue.
RESIDUAL = 1e-13
#: Components whose eigenvalue is under this share of the largest are not there: their whitened values would be noise.
LEAST_SHARE = 1e-10
#: Quantized components beyond are held there, so that products of integers stay exact.
_MOST = 1 << 40


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], dimension: int, k: int, block: int = BLOCK, residual: float = RESIDUAL, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues of a symmetric matrix known by its products, their unit eigenvectors as columns, and how many products were taken."""
    draw = np.random.default_rng(seed)
    basis, image = np.zeros((dimension, 0)), np.zeros((dimension, 0))
    scale, passes, k = 0.0, 0, min(k, dimension)
    fresh = np.zeros((dimension, 0))
    probe, held = 0, np.inf  # where the last restart began, and the k-th value then
    while True:
        width = min(block, dimension - basis.shape[1])
        fresh = _orthogonal(fresh, basis, scale)[:, :width]
        while fresh.shape[1] < width:  # the first block, a restart or a breakdown
            more = draw.standard_normal((dimension, width - fresh.shape[1]))
            fresh = np.hstack([fresh, _orthogonal(more, np.hstack([basis, fresh]), 1.0)])
        made = product(fresh)
        passes += 1
        basis, image = np.hstack([basis, fresh]), np.hstack([image, made])
        fresh = made
        values, vectors = _symmetric(basis, image)
        scale = max(float(np.abs(values).max(initial=0)), 1e-300)
        ritz = basis @ vectors[:, :k]
        if basis.shape[1] == dimension:
            return values[:k], ritz, passes
        if basis.shape[1] < k or np.linalg.norm(image @ vectors[:, :k] - ritz * values[:k], axis=0).max() > residual * scale:
            continue
        if probe and values[k - 1] - held <= 1e-9 * scale:
            # a block finds no more copies of an eigenvalue than it is wide: what a fresh start finds beside the accepted pairs must stay under them
            top, turn = _symmetric(basis[:, probe:], image[:, probe:])
            off = image[:, probe:] @ turn[:, 0] - top[0] * (basis[:, probe:] @ turn[:, 0])
            off = np.linalg.norm(off - ritz @ (ritz.T @ off))
            if top[0] + off < values[k - 1] or off <= 1e-6 * scale and top[0] <= values[k - 1] + 1e-9 * scale:
                return values[:k], ritz, passes
        else:
            probe, held, fresh = basis.shape[1], values[k - 1], fresh[:, :0]


def _symmetric(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values in falling order, and their coordinates in the basis."""
    small = basis.T @ image
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], vectors[:, ::-1]


def _orthogonal(block: np.ndarray, basis: np.ndarray, scale: float) -> np.ndarray:
    """Orthonormal directions of the block outside the basis; those that vanish beside scale are left out."""
    norms = np.linalg.norm(block, axis=0)
    if not block.shape[1] or not scale:
        return block[:, :0] if not scale else block
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    q, s, _ = np.linalg.svd(block, full_matrices=False)
    q = q[:, s > 1e-11 * max(scale, float(norms.max()))]
    for _ in range(2):  # what was small has lost digits
        q = q - basis @ (basis.T @ q)
        q, _ = np.linalg.qr(q)
    return q


def quantized(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(64 * component) + 1000000 of the vectors that take part, and which rows those are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    rows = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (np.diff(offsets) == dimension))
    at = offsets[:-1][rows][:, None] + np.arange(dimension)
    x = np.floor(SCALE * values[at]) if len(rows) else np.zeros((0, dimension))
    return np.clip(x, -_MOST, _MOST).astype(np.int64) + SHIFT, rows


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: mean as whole + part / n, eigenvectors as columns, eigenvalues, shares of the trace."""

    n: int
    whole: np.ndarray
    part: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    identity_error: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def spread(self, x: np.ndarray) -> np.ndarray:
        """The deviations as doubles, of any size."""
        return ((self.n * (x - self.whole).astype(np.float64) - self.part) ** 2).sum(axis=1)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """sum of (n x - S)^2; masked where that passes 64 bits."""
        apart = x - self.whole
        fits = self.spread(x) < 9e18
        exact = ((self.n * np.where(fits[:, None], apart, 0) - np.where(fits[:, None], self.part, 0)) ** 2).sum(axis=1)
        return np.ma.array(exact, mask=~fits)


def _summed(rows: DataFrame, dimension: int, make: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all rows of what make gives for a batch of them, flat: summed in each task, then by Spark, cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in pieces(batches, 4096):
            x, _ = quantized(batch.column("vector"), dimension)
            if len(x):
                total = make(x) if total is None else total + make(x)
        if total is not None:
            flat = total.reshape(-1)
            values = pa.array(flat.tolist(), pa.decimal128(38, 0)) if kind.startswith("decimal") else pa.array(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), values], ["cell", "value"])

    sums = rows.select("vector").mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(sums), object if kind.startswith("decimal") else np.float64)
    for cell, value in sums:
        out[cell] = int(value) if kind.startswith("decimal") else value
    return out


def fit(vectors: DataFrame, column: str = "embedding", k: int = 32) -> Whitening | None:
    """The whitening of a column of vectors; None if none takes part or they are all equal. Vectors whose length is not the commonest (of equally common ones the greatest) take no part."""
    rows = vectors.select(F.col(column).cast("array<double>").alias("vector")).filter("vector is not null")
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sizes = rows.filter(finite & (F.size("vector") > 0)).groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if sizes is None:
        return None
    d, n = sizes
    totals = _summed(rows, d, lambda x: x.sum(axis=0).astype(object), "decimal(38,0)")
    whole = np.array([t // n for t in totals], np.int64)
    part = np.array([t % n for t in totals], np.int64)
    mean = Whitening(n, whole, part, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0, 0)

    def product(block: np.ndarray) -> np.ndarray:
        def make(x: np.ndarray) -> np.ndarray:
            y = mean.centred(x)
            return y.T @ (y @ block)

        return _summed(rows, d, make).reshape(d, -1) / n

    spread = float(_summed(rows, d, lambda x: np.array([mean.spread(x).sum()]))[0]) / float(n) ** 3  # the trace, from the rows' deviations
    if spread <= 0:
        return None
    values, basis, passes = block_lanczos(product, d, k)
    there = values > LEAST_SHARE * values[0]
    values, basis = values[there], basis[:, there]
    fitted = Whitening(n, whole, part, basis, values, values / spread, 0.0, passes)
    centre = _summed(rows, d, lambda x: fitted.whitened(x).sum(axis=0)) / n

    def products(x: np.ndarray) -> np.ndarray:
        w = fitted.whitened(x) - centre
        return w.T @ w

    covariance = _summed(rows, d, products).reshape(len(values), -1) / n
    return Whitening(n, whole, part, basis, values, values / spread, float(np.abs(covariance - np.eye(len(values))).max()), passes)


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each row's projection on each of the k leading components, scaled to variance 1.

    Other columns are ignored. Vectors that are null, empty or of an uncommon length, or hold null or non-finite components, take no part; rows with a null id and repeated rows do, each by itself. Quantized
    components beyond 2^40 are held there; a deviation beyond 64 bits is null. Components without variance are left out, so that equal vectors, a single one and an empty table give no rows.
    Ties: eigenvectors of one eigenvalue are some orthonormal basis of their space, the same for all rows.
    """
    schema = f"vec_id {dict(vectors.dtypes)[id_column]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, column, k)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, many = len(model.whole), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            x, rows = quantized(batch.column("vector"), d)
            if not len(x):
                continue
            deviation = model.deviations(x)
            ids = batch.column("vec_id").take(pa.array(np.repeat(rows, many)))
            size = len(x) * many
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))), pa.array(np.full(size, model.n, np.int64)),
                    pa.array(np.repeat(deviation.data, many), mask=np.repeat(np.ma.getmaskarray(deviation), many)), pa.array(model.whitened(x).reshape(-1)),
                    pa.array(np.tile(model.shares, len(x))), pa.array(np.full(size, model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.select(F.col(id_column).alias("vec_id"), F.col(column).cast("array<double>").alias("vector")).filter("vector is not null").mapInArrow(run, schema)
