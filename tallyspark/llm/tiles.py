"""A stated query set against all vectors, in blocks: each task holds one block of queries and streams one block of
candidates past it.  A block is a hash range of stable row numbers, so repeated ids or vectors never fill one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, rows_of, single

QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 4096
ROW_DDL = "rid long, vec_id long, dim int, v binary"


def _valid(zero: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, out = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                if np.isfinite(x).all() and (zero or x.any()):
                    ids.append(i)
                    dims.append(len(x))
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "v"])

    return run


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, scratch: Scratch, zero: bool) -> DataFrame:
    """Saved rows (rid, vec_id, dim, v: doubles) of the vectors that take part.  A null id takes no part."""
    src = single(df, id_col, vec_col).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    saved = scratch.save(src.mapInArrow(_valid(zero), "vec_id long, dim int, v binary"), "vectors")
    return saved.select(F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("rid"), "vec_id", "dim", "v")


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles; a shorter vector is filled up with zeros."""
    raw = col.to_pylist()
    if all(len(r) == 8 * dim for r in raw):
        return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dim)
    return np.frombuffer(b"".join(r + bytes(8 * dim - len(r)) for r in raw), np.float64).reshape(len(raw), dim)


def tiles(queries: DataFrame, rows: DataFrame, n_rows: int, task: Callable[[pa.Table], Callable], ddl: str) -> DataFrame:
    """queries: rid, vec_id, dim, v and what the task needs besides.  ``task(query block)`` gives a function that
    takes candidate batches (and None at the end) and yields record batches."""
    q_blocks, c_blocks = max(1, -(-rows_of(queries) // QUERY_BLOCK)), max(1, -(-n_rows // CANDIDATE_BLOCK))
    more = [c for c in queries.columns if c not in ("rid", "vec_id", "dim", "v")]
    at_q, at_c = F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(q_blocks)), F.pmod(F.xxhash64("rid", F.lit(2)), F.lit(c_blocks))
    q = queries.withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(c_blocks - 1)), lambda x: x + at_q * c_blocks))).withColumn("kind", F.lit(0))
    c = rows.withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(q_blocks - 1)), lambda x: x * c_blocks + at_c))).withColumn("kind", F.lit(1))
    types = dict(queries.dtypes)
    c = c.select("*", *[F.lit(None).cast(types[m]).alias(m) for m in more])
    both = q.unionByName(c).repartition(q_blocks * c_blocks, "tile").sortWithinPartitions("tile", "kind", "rid")
    return both.mapInArrow(_run(task), ddl)


def _run(task: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, step = None, [], None
        for b in batches:
            t, kind = b.column("tile").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(t) != 0) | (np.diff(kind) != 0)) + 1), len(t)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j == i:
                    continue
                if t[i] != tile:
                    if step:
                        yield from step(None)
                    tile, held, step = t[i], [], None
                part = b.slice(i, j - i)
                if kind[i] == 0:
                    held.append(part)
                    continue
                if held and step is None:
                    step = task(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                if step:
                    yield from step(part)
        if step:
            yield from step(None)

    return run
