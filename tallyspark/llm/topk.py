"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query, block by block.  Round by round, each block counts its scores in
BINS bins of the range in which a query's k-th score is known to lie; the counts are added up per query, and the bin
that holds the k-th score is the range of the next round, until a bin is one integer wide.  A last pass keeps the
scores above that value and, of those equal to it, the least ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch
from tallyspark.llm.tiles import matrix, tiles, valid_vectors

K, SCALE, BINS, CHUNK = 20, 64, 256, 512


def scores(q: np.ndarray, c: np.ndarray, q_rid: np.ndarray, c_rid: np.ndarray, top: float) -> np.ndarray:
    """Integer inner products as float64 (exact below 2**53); a query's own row is -inf."""
    kind = np.float32 if top < 2**24 else np.float64
    s = (q.astype(kind) @ c.astype(kind).T).astype(np.float64)
    order = np.argsort(q_rid)
    at = np.minimum(np.searchsorted(q_rid[order], c_rid), len(q_rid) - 1)
    own = q_rid[order][at] == c_rid
    s[order[at[own]], np.flatnonzero(own)] = -np.inf
    return s


def _count(dim: int, scale: int, k: int, top: float):
    """Counts per query and bin, from the highest bin down to the block's own k-th score."""

    def task(b: pa.RecordBatch):
        q, rid = np.floor(matrix(b.column("v"), dim) * scale), b.column("rid").to_numpy()
        lo, hi, width, need = (b.column(c).to_numpy() for c in ("lo", "hi", "width", "need"))
        count = np.zeros((len(q), BINS), np.int64)

        def step(c: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if c is not None:
                x, c_rid = np.floor(matrix(c.column("v"), dim) * scale), c.column("rid").to_numpy()
                for i in range(0, len(q), CHUNK):
                    e = slice(i, i + CHUNK)
                    s = scores(q[e], x, rid[e], c_rid, top)
                    r, f = np.nonzero((s >= lo[e, None]) & (s < hi[e, None]))
                    code = r * BINS + ((s[r, f] - lo[e][r]) // width[e][r]).astype(np.int64)
                    count[e] += np.bincount(code, minlength=len(s) * BINS).reshape(-1, BINS)
                return
            above = np.cumsum(count[:, ::-1], axis=1)[:, ::-1] - count
            r, f = np.nonzero((count > 0) & (above < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(rid[r]), pa.array(f.astype(np.int32)), pa.array(count[r, f])], names=["rid", "bin", "n"])

        return step

    return task


def _keep(dim: int, scale: int, k: int, top: float):
    """Scores above the k-th, and the least ids among those equal to it."""

    def task(b: pa.RecordBatch):
        q, rid, name, lo = np.floor(matrix(b.column("v"), dim) * scale), b.column("rid").to_numpy(), b.column("vec_id").to_numpy(), b.column("lo").to_numpy()

        def step(c: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if c is None:
                return
            c = c.take(pa.array(np.argsort(c.column("vec_id").to_numpy(), kind="stable")))
            x, c_rid, c_id = np.floor(matrix(c.column("v"), dim) * scale), c.column("rid").to_numpy(), c.column("vec_id").to_numpy()
            for i in range(0, len(q), CHUNK):
                e = slice(i, i + CHUNK)
                s = scores(q[e], x, rid[e], c_rid, top)
                equal = (s == lo[e, None]) & np.isfinite(s)
                r, f = np.nonzero((s > lo[e, None]) | (equal & (np.cumsum(equal, axis=1) <= k)))
                yield pa.RecordBatch.from_arrays([pa.array(rid[i + r]), pa.array(name[i + r]), pa.array(c_id[f]), pa.array(s[r, f].astype(np.int64))],
                                                 names=["rid", "query_id", "vec_id", "score"])

        return step

    return task


def exact_topk(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, every: int = 20, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of floor(scale * x) per query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own; ties go to the
    smaller id.  With fewer candidates than k all are returned.  Vectors that are null, or hold a null or a
    non-finite component, and rows with a null id take no part; a shorter vector counts as filled up with zeros.
    Rows that repeat an id are rows of their own: each is a candidate, and each query row has its own result.
    Integer scores are exact up to 2**53.  Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = valid_vectors(vectors, id_col, vec_col, scratch, zero=True)
    n, dim, most = _extent(rows, scale)
    result = "rid long, query_id long, vec_id long, score long"
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top = float(dim) * most * most
    width = max(1.0, float(np.ceil((2 * top + 1) / BINS)))
    state = rows.where(F.col("vec_id") % every == 0).select("rid", F.lit(-top).alias("lo"), F.lit(top + 1).alias("hi"), F.lit(width).alias("width"), F.lit(k).cast("long").alias("need"))
    state, turn = scratch.save(state, "state0"), 0
    while True:
        asked = rows.join(state, "rid")
        counted = tiles(asked, rows, n, _count(dim, scale, k, top), "rid long, bin int, n long").groupBy("rid", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("rid").orderBy(F.desc("bin"))
        cum = counted.withColumn("cum", F.sum("n").over(down)).join(state, "rid")
        # The first bin from the top in which the count reaches what is needed; none: there are fewer candidates.
        hit = cum.where((F.col("cum") >= F.col("need")) & (F.col("cum") - F.col("n") < F.col("need"))).select("rid", "bin", (F.col("need") - F.col("cum") + F.col("n")).alias("left"))
        finer = F.greatest(F.lit(1.0), F.ceil(F.col("width") / BINS))
        at = F.col("lo") + F.coalesce("bin", F.lit(0)) * F.col("width")
        state = state.join(hit, "rid", "left").select(
            "rid", at.alias("lo"), F.when(F.col("bin").isNull(), F.col("lo")).otherwise(F.least("hi", at + F.col("width"))).alias("hi"),
            finer.alias("width"), F.coalesce("left", "need").alias("need"))
        turn += 1
        state = scratch.save(state, f"state{turn}")
        if width <= 1:
            break
        width = max(1.0, float(np.ceil(width / BINS)))
    kept = tiles(rows.join(state, "rid"), rows, n, _keep(dim, scale, k, top), result)
    best = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _largest(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = max((float(np.abs(np.floor(np.frombuffer(v, np.float64) * scale)).max(initial=0)) for v in b.column(1).to_pylist()), default=0.0)
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64()), pa.array([max(b.column(0).to_pylist(), default=0)], pa.int32()), pa.array([most])], names=["n", "dim", "most"])

    return run


def _extent(rows: DataFrame, scale: int) -> tuple[int, int, float]:
    """Number of vectors, largest dimension, largest magnitude of a scaled component."""
    r = rows.select("dim", "v").mapInArrow(_largest(scale), "n long, dim int, most double").agg(F.sum("n"), F.max("dim"), F.max("most")).first()
    return r[0] or 0, r[1] or 0, r[2] or 0.0
