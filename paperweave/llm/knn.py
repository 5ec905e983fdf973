"""Exact top-k search by inner product: a Voronoi join.

Pivots split the vectors into cells. Tasks pack each cell's vectors into blocks; a summary of each cell tells how far its
vectors lie from the pivot. A query's product with a vector of a cell is at most its product with the pivot plus its own length times that
distance, and at least k vectors score as high as its k-th best pivot does. So a query is replicated only to cells whose bound
reaches that score, and blocks of queries meet blocks of the cell's vectors there. Each task keeps its k best of a query; the
k best of those are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperweave.llm.arrow import pieces
from paperweave.llm.scratch import cut

SCALE = 256
MAX_PIVOTS = 256
BLOCK = 1024
QUERY_BLOCK = 256
#: Blocks of a cell, about, that share a key of the join; a cell with more is split, and its queries meet each part.
PART_BLOCKS = 64
_BIG = 1 << 62


def quantized(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * component) of each usable vector, padded with zeros to width, and which rows those are. Values beyond 2**62 are held there."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    usable = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]))
    out = np.zeros((len(usable), width), np.int64)
    for row, i in enumerate(usable):
        x = values[offsets[i] : offsets[i + 1]]
        out[row, : len(x)] = np.clip(np.floor(SCALE * x), -_BIG, _BIG).astype(np.int64)
    return out, usable


def _packed(x: np.ndarray) -> bytes:
    """Integers in the fewest bytes; the number of vectors tells the type."""
    most = int(np.abs(x).max(initial=0))
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _unpacked(raw: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // (n * width)}").reshape(n, width).astype(np.int64)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products: by floating point where every sum stays under 2**53, else by integers."""
    if int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1] < 1 << 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query, ties to smaller ids."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate([first, [len(query)]])))
    keep = rank < k
    return query[keep], vec[keep], score[keep]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors (vec_id, embedding; other columns are ignored) with the highest product for each row that is_query picks.

    Components become floor(256 * x). A row's own vec_id is never among its results; ties go to the smaller vec_id. Vectors that are null
    or hold null or non-finite components, and rows with a null vec_id, take no part; shorter vectors, and so empty ones, count as padded with zeros. Rows that repeat a vec_id are
    all candidates, and as queries share one ranking. A query without candidates and an empty table give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), is_query.alias("query"))
    n, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = max(1, width or 0)
    pivots_wanted = int(min(MAX_PIVOTS, max(8, n**0.5 / 4)))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sampled = rows.filter(finite).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots_wanted).select("vec_id", "embedding").toArrow()
    pivots, which = quantized(sampled["embedding"].combine_chunks() if sampled.num_rows else pa.array([], pa.list_(pa.float64())), width)
    pivot_ids = np.array(sampled["vec_id"].to_pylist(), np.int64)[which]
    schema = "query_id long, rank int, vec_id long, score long"
    if not len(pivots):
        return spark.createDataFrame([], schema)
    centre = pivots.astype(np.float64)
    lengths = (centre * centre).sum(axis=1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        sizes: dict[int, int] = {}

        def sent(cell: int) -> pa.RecordBatch:
            ids, x, far = (np.concatenate(p) for p in zip(*held.pop(cell), strict=True))
            sizes.pop(cell)
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids[order].tobytes()]), pa.array([_packed(x[order])]), pa.array([float(far.max())])], ["cell", "n", "ids", "vectors", "radius"])

        for batch in pieces(batches, 2048):
            x, usable = quantized(batch.column("embedding"), width)
            ids = batch.column("vec_id").to_numpy()[usable]
            asks = batch.column("query").to_numpy(zero_copy_only=False)[usable].astype(bool)
            f = x.astype(np.float64)
            square = np.maximum((f * f).sum(axis=1)[:, None] - 2 * (f @ centre.T) + lengths, 0)
            cell = square.argmin(axis=1) if len(f) else np.zeros(0, np.int64)
            far = np.sqrt(((f - centre[cell]) ** 2).sum(axis=1))
            # queries go, besides, into blocks of their own, in the order of their cells
            for of, rows_of in [(int(c), np.flatnonzero(cell == c)) for c in np.unique(cell)] + [(-1, np.flatnonzero(asks)[np.argsort(cell[asks], kind="stable")])]:
                for at in range(0, len(rows_of), QUERY_BLOCK):
                    some = rows_of[at : at + QUERY_BLOCK]
                    held.setdefault(of, []).append((ids[some], x[some], far[some]))
                    sizes[of] = sizes.get(of, 0) + len(some)
                    if sizes[of] >= (BLOCK if of >= 0 else QUERY_BLOCK):
                        yield sent(of)
        for of in list(held):
            yield sent(of)

    blocks = cut(rows.mapInArrow(pack, "cell int, n int, ids binary, vectors binary, radius double"))
    data = blocks.filter("cell >= 0")
    radius, parts = np.full(len(pivots), -1.0), [1] * len(pivots)
    for cell, far, n_blocks in data.groupBy("cell").agg(F.max("radius"), F.count("*")).collect():
        radius[cell], parts[cell] = far, -(-n_blocks // PART_BLOCKS)
    parts_of_cell = F.element_at(F.lit(parts), F.col("cell") + 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n_q, raw_ids, raw in zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "vectors")), strict=True):
                ids, q = np.frombuffer(raw_ids, np.int64), _unpacked(raw, n_q, width)
                f = q.astype(np.float64)
                product = f @ centre.T
                own = ids[:, None] == pivot_ids[None, :]
                known = np.where(own, -np.inf, product)
                floor = np.sort(known, axis=1)[:, -k] if len(pivots) >= k else np.full(n_q, -np.inf)
                bound = product + np.sqrt((f * f).sum(axis=1))[:, None] * np.maximum(radius, 0)
                slack = 1e-9 * (np.abs(bound) + np.abs(product)) + 1  # floating point may err; the bound must not
                need = (radius >= 0) & (bound + slack >= floor[:, None])
                out = [(c, np.flatnonzero(need[:, c])) for c in range(len(pivots))]
                out = [(c, r) for c, r in out if len(r)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int32()), pa.array([len(r) for _, r in out], pa.int32()), pa.array([ids[r].tobytes() for _, r in out]), pa.array([_packed(q[r]) for _, r in out])], ["cell", "n_q", "q_ids", "q_vectors"])

    asked = blocks.filter("cell = -1").select("n", "ids", "vectors").mapInArrow(route, "cell int, n_q int, q_ids binary, q_vectors binary")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts_of_cell - 1)))
    data = data.select("cell", F.pmod(F.xxhash64("ids"), parts_of_cell).cast("int").alias("part"), "n", "ids", "vectors")
    met = asked.join(data, ["cell", "part"]).drop("cell", "part")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _best(*(np.concatenate(p) for p in zip(*held, strict=True)), k)

        for batch in pieces(batches, 16):
            for n_q, raw_q, q, m, raw_x, x in zip(*(batch.column(c).to_pylist() for c in ("n_q", "q_ids", "q_vectors", "n", "ids", "vectors")), strict=True):
                q_ids, ids = np.frombuffer(raw_q, np.int64), np.frombuffer(raw_x, np.int64)
                score = _products(_unpacked(q, n_q, width), _unpacked(x, m, width))
                other = q_ids[:, None] != ids[None, :]
                if m > k:
                    masked = np.where(other, score, np.iinfo(np.int64).min)
                    other &= score >= np.partition(masked, m - k, axis=1)[:, m - k, None]
                a, b = np.nonzero(other)
                if len(a):
                    held.append(_best(q_ids[a], ids[b], score[a, b], k))
                if sum(len(h[0]) for h in held) > 200_000:
                    held = [merged()]
                    if len(held[0][0]) > 100_000:  # very many queries in one task
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], ["query_id", "vec_id", "score"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], ["query_id", "vec_id", "score"])

    part = met.mapInArrow(solve, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
