"""Document quality by co-training of two classifiers.

The text view sees statistics of the content alone (per document, and the mean and the extreme over its lines); the
metadata view sees lang, source and the declared length alone.  Both start from the labelled documents.  In each
round every document without a label is scored by both views, and each view hands its most confident documents of
either class to the other as pseudo-labels; what a view was given has left its pool, so each round brings others.  After the last round each view's log odds are calibrated on labelled
documents kept aside, the calibrated views are added up, and all documents are scored.

A fit uses a bounded sample (FIT_ROWS labelled rows, at most FIT_ROWS / 8 pseudo-labels per round, view and class); features,
scores and the choice of the most confident documents cover all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, hash_words, row_words, rows_of, single, slices, text_buffers
from tallyspark.llm.linear import Dense, fit_logistic, platt, sigmoid

ROUNDS, FIT_ROWS = 3, 16_384
#: Pseudo-labels per round, view and class: this share of the unlabelled documents, but not fewer than GIVEN_LEAST, and
#: (as a fit is bounded) not more than FIT_ROWS / 8.
GIVEN, GIVEN_LEAST = 0.01, 64
#: A pseudo-label counts less than a label, and must be at least so sure (calibrated).
PSEUDO_WEIGHT, SURE = 0.25, 0.95
L2, BYTES = 1.0, 1 << 20
META = 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in ".,;:'\"-()?"]] = True
_SYMBOL = ~(_LETTER | _DIGIT | _POINT)
_SYMBOL[[32, 9, 10, 11, 12, 13]] = False
LINE_STATS = 6
TEXT = 6 + 2 * LINE_STATS


def _shares(marks: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    n = np.maximum(hi - lo, 1)
    out = []
    for m in marks:
        s = np.concatenate([[0], np.cumsum(m)])
        out.append((s[hi] - s[lo]) / n)
    return out


def _distinct(w: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct words in each group."""
    order = np.lexsort((w, group))
    new = np.ones(len(w), bool)
    new[1:] = (w[order][1:] != w[order][:-1]) | (group[order][1:] != group[order][:-1])
    return np.bincount(group[order][new], minlength=n)


def text_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Statistics of each row's text (all 0 for an empty one)."""
    n = len(off) - 1
    out = np.zeros((n, TEXT), np.float32)
    if not len(data):
        return out
    starts, ends, first = row_words(data, off)
    h = hash_words(data, starts, ends, lower=True)
    words = np.diff(first)
    row = np.repeat(np.arange(n), words)
    marks = [_UPPER[data], _DIGIT[data], _SYMBOL[data]]
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.minimum(np.log1p(np.diff(off) / np.maximum(words, 1)), 6)
    out[:, 2:5] = np.stack(_shares(marks, off[:-1], off[1:]), axis=1)
    out[:, 5] = np.log1p(words) - np.log1p(_distinct(h, row, n))
    # Lines: cut at line feeds and at row ends.
    cuts = np.unique(np.concatenate([off, np.flatnonzero(data == 10) + 1]))
    lo, hi = cuts[:-1], cuts[1:]
    of = np.searchsorted(off, lo, "right") - 1
    wl = np.searchsorted(lo, starts, "right") - 1
    k = np.bincount(wl, minlength=len(lo))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (wl[1:] == wl[:-1])
    again = np.bincount(wl, weights=same, minlength=len(lo)) / np.maximum(k, 1)
    alone = (ends - starts == 1) & _SYMBOL[data[np.minimum(starts, len(data) - 1)]]
    signs = np.bincount(wl, weights=alone, minlength=len(lo)) / np.maximum(k, 1)
    rare = 1 - _distinct(h, wl, len(lo)) / np.maximum(k, 1)
    stats = np.stack([*_shares(marks, lo, hi), again, signs, np.where(k >= 8, rare, 0)], axis=1)
    keep = k >= 3
    stats, of, k = stats[keep], of[keep], k[keep]
    weight = np.bincount(of, weights=k, minlength=n)
    for c in range(LINE_STATS):
        out[:, 6 + c] = np.bincount(of, weights=k * stats[:, c], minlength=n) / np.maximum(weight, 1)
        top = np.zeros(n)
        np.maximum.at(top, of, stats[:, c])
        out[:, 6 + LINE_STATS + c] = top
    return out


def _bucket(field: str, value: object, size: int) -> int:
    return zlib.crc32(f"{field}={value}".encode()) % size


def meta_features(langs: list, sources: list, chars: list) -> np.ndarray:
    """One-hot lang, source and power-of-two length class, hashed; null is a value of its own."""
    out = np.zeros((len(langs), META), np.float32)
    known: dict = {}
    for i, row in enumerate(zip(langs, sources, [None if c is None else int(max(c, 0)).bit_length() for c in chars], strict=True)):
        at = known.get(row)
        if at is None:
            at = known[row] = [_bucket("lang", row[0], 16), 16 + _bucket("source", row[1], 32), 48 + _bucket("chars", row[2], 16)]
            if len(known) > 100_000:
                known.clear()
        out[i, at] = 1
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = text_buffers(b.column(1))
        x = np.concatenate([text_features(data[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in slices(off, BYTES)] or [np.zeros((0, TEXT), np.float32)])
        m = meta_features(*(b.column(c).to_pylist() for c in (2, 3, 4)))
        cols = [pa.array([r.tobytes() for r in v], pa.binary()) for v in (x, m)]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "text_x", "meta_x"])


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, width).astype(np.float64)
    return np.concatenate([x, np.square(x)], axis=1) if width == TEXT else x


class View:
    """A standardised logistic regression with calibrated log odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, cal_x: np.ndarray, cal_y: np.ndarray):
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.w, self.b = fit_logistic(Dense(self.standard(x)), y, l2=L2, weight=weight)
        self.a, self.c = platt(self.raw(cal_x), cal_y) if len(set(cal_y.tolist())) == 2 else (1.0, 0.0)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.w + self.b

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.a * self.raw(x) + self.c


def _fit_views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bounded sample (text_x, meta_x, y, kind: fit, cal, text = pseudo-label for the text view, meta) -> both views."""
    import pickle

    t = pa.Table.from_batches(list(batches), schema=pa.schema([("text_x", pa.binary()), ("meta_x", pa.binary()), ("y", pa.int32()), ("kind", pa.string())])).combine_chunks()
    kind, y = np.array(t["kind"].to_pylist()), t["y"].to_numpy().astype(float)
    views = []
    for name, width in (("text", TEXT), ("meta", META)):
        x = _matrix(t[f"{name}_x"].combine_chunks(), width) if len(t) else np.zeros((0, width * (1 + (width == TEXT))))
        own, cal = (kind == "fit") | (kind == name), kind == "cal"
        views.append(View(x[own], y[own], np.where(kind[own] == "fit", 1.0, PSEUDO_WEIGHT), x[cal], y[cal]))
    known = y[(kind == "fit") | (kind == "cal")]
    prior = float(np.log((known.sum() + 1) / (len(known) - known.sum() + 1)))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((*views, prior))], pa.binary())], names=["views"])


def _score(views: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        text, meta, prior = pickle.loads(views)
        for b in batches:
            zt, zm = text.logit(_matrix(b.column(1), TEXT)), meta.logit(_matrix(b.column(2), META))
            z = prior + (zt - prior) + (zm - prior)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(sigmoid(v)) for v in (zt, zm, z))], names=["doc_id", "text_score", "meta_score", "score"])

    return run


def _calibration(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0


def _learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str) -> tuple[DataFrame, bytes]:
    """The saved features of all documents and the two views after the last round."""
    src = single(docs, "doc_id", "text", "lang", "source", "n_chars")
    src = src.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    x = scratch.save(src.mapInArrow(_features, "doc_id long, text_x binary, meta_x binary"), "features")
    known = (single(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id")
             .agg((F.avg(label) >= 0.5).cast("int").alias("y")))
    known = scratch.save(known, "known")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.orderBy(*order).limit(FIT_ROWS).withColumn("kind", F.when(_calibration(), "cal").otherwise("fit"))
    sample = scratch.save(x.join(F.broadcast(sample), "doc_id").orderBy(*order, "text_x", "meta_x").limit(FIT_ROWS).select("text_x", "meta_x", "y", "kind"), "sample")
    pool = x.join(known, "doc_id", "left_anti")

    def views(given: DataFrame) -> bytes:
        r = given.coalesce(1).mapInArrow(_fit_views, "views binary").first()
        return r[0] if r else next(_fit_views(iter(()))).column(0)[0].as_py()  # no task runs on an empty frame

    now = views(sample)
    size = rows_of(pool)
    most = min(max(GIVEN_LEAST, int(size * GIVEN)), FIT_ROWS // 8)
    told = []  # what each round has handed over
    for turn in range(ROUNDS):
        scored = pool.mapInArrow(_score(now), "doc_id long, text_score double, meta_score double, score double")
        scored = scratch.save(scored, f"scored{turn}")
        picks = []
        for view, other in (("text", "meta"), ("meta", "text")):
            # A document is handed to a view once: it has left that view's pool.
            fresh = scored
            for c in told:
                fresh = fresh.join(F.broadcast(c.where(F.col("kind") == other).select("doc_id")), "doc_id", "left_anti")
            for y, s in ((1, F.col(f"{view}_score")), (0, 1 - F.col(f"{view}_score"))):
                best = fresh.where((s >= SURE) & F.col("doc_id").isNotNull()).orderBy(F.desc(s), *order).limit(most)
                picks.append(best.select("doc_id", F.lit(y).alias("y"), F.lit(other).alias("kind")))
        chosen = picks[0]
        for p in picks[1:]:
            chosen = chosen.unionByName(p)
        chosen = scratch.save(chosen, f"chosen{turn}")
        told.append(chosen)
        # At most FIT_ROWS / 2 ids, so the broadcast is bounded; a repeated id brings one of its rows.
        extra = x.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "kind", "y").agg(F.min(F.struct("text_x", "meta_x")).alias("v"))
        sample = scratch.save(sample.unionByName(extra.select("v.text_x", "v.meta_x", "y", "kind")), f"sample{turn}")
        now = views(sample.orderBy("kind", "text_x", "meta_x", "y"))
    return x, now


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, score (probability of label 1), keep (1 if score >= 0.5).

    docs needs doc_id, text, lang, source, n_chars; other columns are not read.  A null text is an empty one, a null
    in a metadata column a value of its own.  A null label or id teaches nothing, repeated labels count by majority.
    With labels of one class only (or none) the scores are the smoothed share of label 1.  Rows that repeat an id are
    scored one by one; an empty table gives no rows.
    """
    x, views = _learn(docs, labels, Scratch(docs.sparkSession, "cotraining"), label)
    out = x.mapInArrow(_score(views), "doc_id long, text_score double, meta_score double, score double")
    return out.withColumn("keep", (F.col("score") >= 0.5).cast("int"))


def without_low_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """documents that the combined views keep, all columns kept."""
    at = [docs.columns.index(c) for c in ("doc_id", "text", "lang", "source", "n_chars")]
    views = _learn(docs, labels, Scratch(docs.sparkSession, "cotraining"), label)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            only = pa.RecordBatch.from_arrays([b.column(i) for i in at], names=["doc_id", "text", "lang", "source", "n_chars"])
            for s in _score(views)(_features(iter([only]))):
                yield b.filter(pa.array(s.column(3).to_numpy() >= 0.5))

    return docs.mapInArrow(run, docs.schema)
