"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed character n-gram (n = 3, 4, 5) in the ASCII- and BMP-lower-cased text.  From
the labelled texts each feature gets its log-count ratio r (how much more often it is present in texts with label
1).  Every n-gram of at least LEAST_ROWS sample texts enters a logistic regression, with r as its value; the closer r
is to what chance gives, the smaller its value is made, so rare n-grams count without drowning the sure ones.

Labels are learned from a bounded sample (FIT_ROWS rows, FIT_BYTES of text; a text that no longer fits is skipped,
the ones after it are not); scores cover every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import _MULT, U64, Scratch, single, slices, text_buffers
from tallyspark.llm.linear import Sparse, fit_logistic, sigmoid

#: n -> bits of its hash space.
GRAMS = {3: 18, 4: 20, 5: 20}
SIZE = sum(1 << b for b in GRAMS.values())
#: Bounds of the sample that is learned from: the rows with the least hash of their id.
FIT_ROWS, FIT_BYTES = 8192, 96 << 20
#: A ratio so many standard errors from 0 counts half.  An n-gram of one single text says nothing of others.
HALF_Z, LEAST_ROWS = 4.0, 2
L2, BYTES = 1.0, 1 << 20
#: Text whose n-grams are held at once in scoring, where several tasks share an executor.
SCORE_BYTES = 1 << 17

_LOWER = np.arange(1 << 16, dtype=np.uint32)
_LOWER[:] = [ord(s) if len(s := chr(c).lower()) == 1 else c for c in range(1 << 16)]


def gram_rows(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the row and the feature of every character n-gram within a row."""
    if not len(data):
        return
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    low = np.minimum(chars, 0xFFFF)
    chars = np.where(chars > 0xFFFF, chars, _LOWER[low])
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = lead[off]
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(first))
    base = 0
    for n, bits in GRAMS.items():
        m = len(chars) - n + 1
        if m > 0:
            h = chars[:m].astype(U64) * _MULT[50]
            for k in range(1, n):
                h += chars[k:k + m] * _MULT[50 + k]
            inside = row[n - 1:] == row[:m]
            yield row[:m][inside], ((h ^ (h >> U64(29))) * _MULT[60] >> U64(64 - bits)).astype(np.int64)[inside] + base
        base += 1 << bits


def present(data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every distinct n-gram of each row; with wanted, only features that it marks."""
    out = []
    for row, f in gram_rows(data, off):
        if wanted is not None:
            keep = wanted[f]
            row, f = row[keep], f[keep]
        out.append(row.astype(np.int64) * SIZE + f)
    code = _distinct(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return code // SIZE, code % SIZE


def _distinct(code: np.ndarray) -> np.ndarray:
    code = np.sort(code)
    return code[np.flatnonzero(np.diff(code, prepend=-1))]


def by_feature(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same pairs by feature: rows, features, and in how many rows each feature is."""
    bits = len(off).bit_length()
    for row, f in gram_rows(data, off):
        code = _distinct((f << bits) + row)
        f = code >> bits
        at = np.flatnonzero(np.diff(f, prepend=-1))
        yield code & (1 << bits) - 1, f[at], np.diff(at, append=len(f))


def fit(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, the weights, and the intercept."""
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    kind = np.uint16 if len(texts) <= 1 << 16 else np.int64
    with_1, with_0, pairs = np.zeros(SIZE, np.int32), np.zeros(SIZE, np.int32), []
    for i, j in slices(off, BYTES):
        for row, f, n in by_feature(np.frombuffer(b"".join(texts[i:j]), np.uint8), off[i:j + 1] - off[i]):
            if len(row):
                ones = np.add.reduceat((labels[i + row] == 1).astype(np.int32), np.cumsum(n) - n)
                with_1[f] += ones
                with_0[f] += n - ones
                pairs.append(((i + row).astype(kind), f.astype(np.int32), n.astype(np.int32)))
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    wanted = with_1 + with_0 >= LEAST_ROWS if n1 and n0 else np.zeros(SIZE, bool)
    feature = np.flatnonzero(wanted)
    in_1, in_0 = with_1[feature], with_0[feature]
    del with_1, with_0
    ratio = np.log((in_1 + 1) / (n1 + 2)) - np.log((in_0 + 1) / (n0 + 2))
    z2 = ratio ** 2 / (1 / (in_1 + 1) + 1 / (in_0 + 1))
    value = ratio * z2 / (z2 + HALF_Z ** 2)
    place = np.zeros(SIZE, np.int32)
    place[feature] = np.arange(len(feature))
    x = Sparse(value, len(texts))
    while pairs:
        row, f, n = pairs.pop()
        keep = wanted[f]
        x.add(row[np.repeat(keep, n)], place[f[keep]], n[keep])
    w, b = fit_logistic(x, labels.astype(float), l2=L2, rest=0.1)
    return feature, w * value, b


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels, size = [], [], 0
    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = (t or "").encode()
            if size + len(t) <= FIT_BYTES:
                size += len(t)
                texts.append(t)
                labels.append(y)
    f, w, b = fit(texts, np.array(labels, np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([f.astype(np.int64).tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([b])],
                                     names=["feature", "weight", "bias"])


def _score_task(feature: np.ndarray, weight: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(SIZE, np.float64)
        w[feature] = weight
        wanted = np.zeros(SIZE, bool)
        wanted[feature] = True
        for b in batches:
            data, off = text_buffers(b.column(1))
            z = np.full(len(b), bias)
            for i, j in slices(off, SCORE_BYTES):
                row, f = present(data[off[i]:off[j]], off[i:j + 1] - off[i], wanted)
                z[i:j] += np.bincount(row, weights=w[f], minlength=j - i)
            p = sigmoid(z)
            toxic = (p >= 0.5) & (len(feature) > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(toxic.astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def held_out(col: str = "doc_id"):
    """A fifth of the ids, never learned from (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """docs (doc_id, text), labels (doc_id, <label>): a null label or id teaches nothing, repeated ones count by majority."""
    known = (single(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id")
             .agg((F.avg(label) >= 0.5).cast("int").alias("y")).where(~held_out()))
    # A bounded number of (id, label) pairs, so the broadcast is bounded too.
    sample = scratch.save(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS), "sample")
    texts = docs.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(FIT_ROWS).select("text", "y")
    m = texts.coalesce(1).mapInArrow(_fit_task, "feature binary, weight binary, bias double").first()
    if m is None:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.frombuffer(m[0], np.int64), np.frombuffer(m[1], np.float64), m[2]


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5; always 0 if no
    feature could be learned).

    Learned from labelled documents that are not held out.  Null and empty texts have no n-gram and get the score of
    the intercept.  With labels of one class only (or none) all scores are the smoothed share of label 1.  Rows that
    repeat an id are scored one by one; an empty table gives no rows.  Only id and text are read.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    src = single(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(src, labels, scratch)
    out = src.mapInArrow(_score_task(*model), "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without those predicted toxic, all columns kept; all documents if no feature could be learned."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(src, labels, scratch)
    return docs.mapInArrow(_keep_task(docs.columns.index("text"), *model), docs.schema)


def _keep_task(at: int, feature: np.ndarray, weight: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _score_task(feature, weight, bias)
        for b in batches:
            only = pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.int64()), b.column(at)], names=["doc_id", "text"])
            for s in score(iter([only])):
                yield b.filter(pa.array(s.column(2).to_numpy() == 0))

    return run
