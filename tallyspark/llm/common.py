"""Helpers shared by the operators: scratch tables in the shared folder, Arrow text access, word hashing."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import shared_path

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def single(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, resolved case-sensitively when the frame also holds columns that clash by case."""
    out = []
    for c in cols:
        at = [i for i, n in enumerate(df.columns) if n == c] or [i for i, n in enumerate(df.columns) if n.lower() == c.lower()]
        if not at:
            raise ValueError(f"column {c!r} is missing; the frame has {df.columns}")
        out.append(at[0])
    if len({n.lower() for n in df.columns}) < len(df.columns):
        df = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
        return df.select(*[F.col(f"_c{i}").alias(c) for i, c in zip(out, cols, strict=True)])
    return df.select(*[F.col(f"`{df.columns[i]}`").alias(c) for i, c in zip(out, cols, strict=True)])


def unclashed(df: DataFrame, *cols: str) -> tuple[DataFrame, list[str]]:
    """The frame with the named columns under exactly these names and no two names that clash by case; and its own
    names, which ``out.toDF(*names)`` gives back to a frame of the same columns."""
    at = {}
    for c in cols:
        found = [i for i, n in enumerate(df.columns) if n == c] or [i for i, n in enumerate(df.columns) if n.lower() == c.lower()]
        if not found:
            raise ValueError(f"column {c!r} is missing; the frame has {df.columns}")
        at[found[0]] = c
    taken, names = {c.lower() for c in cols}, []
    for i, n in enumerate(df.columns):
        name = at.get(i, n)
        while i not in at and name.lower() in taken:
            name = f"_{i}_{name}"
        taken.add(name.lower())
        names.append(name)
    return df.toDF(*names), df.columns


class Scratch:
    """Tables of one run in the shared folder (``spark.checkpoint.dir``).

    A written table cuts lineage and survives the loss of any executor.  ``drop`` removes a table that later
    steps no longer read; what the caller's result still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_path(spark, "llm", name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now (it does so when their plans are collected)."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(n))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# ---------------------------------------------------------------- Arrow text


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column (null rows are empty)."""
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]] if len(off) else data[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def one_by_one(b: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch of large values, only one of them as Python objects at a time."""
    for i in range(len(b)):
        yield b.slice(i, 1).to_pylist()[0]


def slices(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (a longer row stands alone)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# -------------------------------------------------------------- word hashing

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE, _SPAN = 0x9E3779B97F4A7C15 | 1, 1 << 18
_POW = np.concatenate([np.ones(1, U64), np.cumprod(np.full(_SPAN, _BASE, U64))])
_INV = np.concatenate([np.ones(1, U64), np.cumprod(np.full(_SPAN, pow(_BASE, -1, 2**64), U64))])
_MULT = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space (0x20, 0x09-0x0D)."""
    word = np.empty(len(data) + 2, np.int8)
    word[0] = word[-1] = 0
    np.logical_not(_SPACE[data], out=word[1:-1].view(bool))
    edge = np.flatnonzero(np.diff(word))
    return edge[::2], edge[1::2]


def row_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends over several rows, and the index of each row's first word (one more at the end).

    Words never cross a row's end.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    sep = np.insert(data, off[1:-1], 0x20)
    starts, ends = word_bounds(sep)
    cut = off[1:-1] + np.arange(len(off) - 2)  # places of the inserted separators
    back = np.searchsorted(cut, starts, "left")
    starts, ends = starts - back, ends - back
    return starts, ends, np.searchsorted(starts, off, "left")


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every task and on every machine."""
    out = np.zeros(len(starts), U64)
    byte = _BYTE[_LOWER] if lower else _BYTE
    i, n = 0, len(starts)
    while i < n:
        a = starts[i]
        j = int(np.searchsorted(ends, a + _SPAN, "right"))
        if j <= i:  # a word longer than the table: piece by piece
            h = np.zeros(1, U64)
            for k in range(int(a), int(ends[i]), _SPAN):
                v = byte[data[k:min(k + _SPAN, int(ends[i]))]]
                h = mix(h * _MULT[0] + (v * _POW[:len(v)]).sum(dtype=U64))
            out[i], i = h[0], i + 1
            continue
        b = ends[j - 1]
        s = np.zeros(b - a + 1, U64)
        np.cumsum(byte[data[a:b]] * _POW[:b - a], out=s[1:])
        x, y = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (s[y] - s[x]) * _INV[x]
        i = j
    return mix(out + (ends - starts).astype(U64) * _MULT[1])


def hash_grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words (len(words) - k + 1 of them, none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if k <= 8:
        h = words[:n] * _MULT[2]
        for j in range(1, k):
            h = h + words[j:j + n] * _MULT[2 + j]
        return mix(h)
    p = _POW[np.arange(len(words)) % _SPAN]
    if len(words) > _SPAN:  # the same polynomial in pieces that overlap by k - 1 words
        step = _SPAN - k
        return np.concatenate([hash_grams(words[i:i + step + k - 1], k) for i in range(0, n, step)])
    s = np.concatenate([np.zeros(1, U64), np.cumsum(words * p)])
    return mix((s[k:] - s[:-k]) * _INV[:n])


def ceil_div(a, b: int):
    return -((-a) // b)


def rows_of(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
