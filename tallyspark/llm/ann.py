"""Nearest neighbours by a block matrix join on int8.

Vectors are quantised to int8 with one scale each.  A block of queries times a block of candidates is one int8
product tile; the norms of the quantisation errors bound how far each product is from the true one.  A pair whose
upper bound is below the k-th best lower bound (or below the k-th best score found so far) cannot be among the k
nearest; the surviving pairs are recomputed in double precision and go through a heap per query.  The heaps of all
blocks are merged by heaps again.  No pair that could count is lost, so recall is 1 by construction.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch
from tallyspark.llm.tiles import matrix, tiles, valid_vectors

K, CHUNK = 20, 512
FOUND = ["rid", "query_id", "vec_id", "score"]
FOUND_DDL = "rid long, query_id long, vec_id long, score double"


class Quantised:
    """Rows as largest * (int8 / 127 + error), with the norms, of the row over its largest component, that bound the
    error of a product; so no norm overflows."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.largest = np.maximum(np.abs(x).max(axis=1, initial=0), np.finfo(float).tiny)
        unit = x / self.largest[:, None]
        self.q = np.rint(unit * 127).astype(np.int8)
        near = self.q / 127
        self.norm, self.near, self.error = (np.sqrt((v * v).sum(axis=1)) for v in (unit, near, unit - near))


def tile(a: Quantised, b: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Approximate products and the bound on their error; a bound of infinity where they are beyond double precision."""
    kind = np.float32 if a.x.shape[1] <= 1000 else np.float64  # sums of int8 products are exact in it
    p = (a.q.astype(kind) @ b.q.astype(kind).T).astype(float) / 127**2
    bound = np.outer(a.error, b.norm) + np.outer(a.near, b.error) + 1e-9 * np.outer(a.norm, b.norm)
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.outer(a.largest, b.largest)
        # The last term covers products that underflow.
        p, bound = p * size, bound * size + a.x.shape[1] * np.finfo(float).tiny
        known = np.isfinite(size) & (size * a.x.shape[1] < np.finfo(float).max)
    return np.where(known, p, 0.0), np.where(known, bound, np.inf)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component to the last: equal vectors give equal scores.  Where
    infinities of both signs meet, the sum counts as the least of all."""
    s = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(a.shape[1]):
            s += a[:, d] * b[:, d]
    return np.where(np.isnan(s), -np.inf, s)


def push(heap: list, k: int, items: Iterator[tuple[float, int]]) -> None:
    """The k best of (score, -id): highest score, then smallest id."""
    for it in items:
        if len(heap) < k:
            heapq.heappush(heap, it)
        elif it > heap[0]:
            heapq.heapreplace(heap, it)


def _search(dim: int, k: int):
    def task(b: pa.RecordBatch):
        rid, name = b.column("rid").to_numpy(), b.column("vec_id").to_numpy()
        q = matrix(b.column("v"), dim)
        heaps: list[list] = [[] for _ in rid]
        floor = np.full(len(rid), -np.inf)
        blocks = [(i, Quantised(q[i:i + CHUNK])) for i in range(0, len(q), CHUNK)]
        order = np.argsort(rid)

        def step(c: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if c is None:
                rows = [(rid[i], name[i], -v, s) for i, h in enumerate(heaps) for s, v in h]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=FOUND)
                return
            x, c_rid, c_id = Quantised(matrix(c.column("v"), dim)), c.column("rid").to_numpy(), c.column("vec_id").to_numpy()
            at = np.minimum(np.searchsorted(rid[order], c_rid), len(rid) - 1)
            own = rid[order][at] == c_rid
            mine, theirs = order[at[own]], np.flatnonzero(own)
            for i, part in blocks:
                p, bound = tile(part, x)
                here = (mine >= i) & (mine < i + CHUNK)
                other = np.ones(p.shape, bool)
                other[mine[here] - i, theirs[here]] = False
                least = np.where(other, p - bound, -np.inf)
                if p.shape[1] > k:
                    least = np.partition(least, p.shape[1] - k, axis=1)[:, p.shape[1] - k]
                    limit = np.maximum(floor[i:i + len(p)], least)
                else:
                    limit = floor[i:i + len(p)]
                r, f = np.nonzero((p + bound >= limit[:, None]) & other)
                if not len(r):
                    continue
                s = np.concatenate([exact(part.x[r[j:j + 65536]], x.x[f[j:j + 65536]]) for j in range(0, len(r), 65536)])
                best = np.lexsort((c_id[f], -s, r))
                r, f, s = r[best], f[best], s[best]
                start = np.searchsorted(r, np.arange(len(p) + 1))
                for g in np.unique(r):
                    e = slice(start[g], min(start[g] + k, start[g + 1]))
                    h = heaps[i + g]
                    push(h, k, zip(s[e].tolist(), (-c_id[f[e]]).tolist(), strict=True))
                    if len(h) == k:
                        floor[i + g] = h[0][0]

        return step

    return task


def _merge(k: int):
    """Rows dealt by query: a heap for each query of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, tuple[int, list]] = {}
        for b in batches:
            for rid, query, vec, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                push(heaps.setdefault(rid, (query, []))[1], k, [(s, -vec)])
        rows = [(query, n, -v, s) for query, h in heaps.values() for n, (s, v) in enumerate(sorted(h, reverse=True), 1)]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i:i + 50_000], strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)],
                                             names=["query_id", "rank", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products (double precision, original vectors) per query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own; ties go to the
    smaller id.  With fewer candidates than k all are returned.  A product beyond double precision
    is an infinity.  Vectors that are null, zero, or hold a null or a
    non-finite component, and rows with a null id take no part; a shorter vector counts as filled up with zeros.
    Rows that repeat an id are rows of their own.  Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    rows = valid_vectors(vectors, id_col, vec_col, scratch, zero=False)
    n, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(0))).first()
    found = tiles(rows.where(F.col("vec_id") % every == 0), rows, n, _search(dim, k), FOUND_DDL)
    return found.repartition("rid").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
