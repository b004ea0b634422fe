import zlib

import duckdb
import numpy as np

from tallyspark.llm import cotraining as C
from tallyspark.llm.common import table
from tallyspark.llm.cotraining import META, TEXT, meta_features, quality_scores, text_features, without_low_quality
from tallyspark.llm.linear import Dense, Sparse, fit_logistic, sigmoid

SF01 = "/root/testdata/sf0.01"


def test_logistic_regression():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x @ [2, -1, 0, 0, 1] + 0.5 + rng.logistic(size=400) > 0).astype(float)
    w, b = fit_logistic(Dense(x), y, l2=0.1)
    r = sigmoid(x @ w + b) - y
    assert np.abs(x.T @ r + 0.1 * w).max() < 0.05 and abs(r.sum()) < 0.05  # the gradient vanishes
    # Presence features with a value each, dense and by blocks of (row, feature) pairs.
    on, value = rng.random((400, 6)) < 0.4, np.array([1.0, -2.0, 0.5, 3.0, 1.5, -0.7])
    sparse = Sparse(value, 400)
    for cols in (range(0, 3), range(3, 6)):
        at = [np.flatnonzero(on[:, c]) for c in cols]
        sparse.add(np.concatenate(at), np.array(cols), np.array([len(a) for a in at]))
    w1, b1 = fit_logistic(Dense(on * value), y, l2=0.1)
    w2, b2 = fit_logistic(sparse, y, l2=0.1)
    assert np.allclose(w1, w2) and np.isclose(b1, b2)


def test_text_features_of_a_row_do_not_depend_on_others():
    texts = ["Some words, in a line.\nAND!! ANOTHER!! LINE!!", "", "a | b | c | d", "same same same same", "é" * 50, "x\n\n\ny 1 2 3 4"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    x = text_features(np.frombuffer(b"".join(raw), np.uint8), off)
    assert x.shape == (6, TEXT) and not x[1].any()
    for i, r in enumerate(raw):
        assert np.allclose(x[i], text_features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0])
    m = meta_features(["en", None], ["s", None], [5, None])
    assert m.shape == (2, META) and (m.sum(axis=1) == 3).all()


def test_quality(spark):
    got = {r.doc_id: r for r in quality_scores(table(spark, SF01, "documents"), table(spark, SF01, "labels")).collect()}
    want = duckdb.sql(f"select doc_id, quality from '{SF01}/labels.parquet'").fetchall()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.keep == int(r.score >= 0.5) for r in got.values())
    aside = [(got[d].keep, y) for d, y in want if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(k == y for k, y in aside) >= 0.95 * len(aside)
    assert sum(k for k, y in aside if y) >= 0.97 * sum(y for _, y in aside)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5, 1), (1, "a b c", "en", "s", 5, 1), (None, None, None, None, None, 1), (2, "", "en", "s", -1, 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long, KEEP int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == 4 and len({round(r.score, 9) for r in got}) == 1  # one class only: the smoothed share
    assert without_low_quality(docs, labels).columns == docs.columns and without_low_quality(docs, labels).count() == 4
    assert quality_scores(docs.limit(0), labels.limit(0)).collect() == []


def test_rounds_pick_different_documents(spark, monkeypatch):
    """What a view was given has left its pool; the views' picks follow the size of the pool."""
    picked: list = []
    real = C.Scratch.save

    def save(self, df, name):
        out = real(self, df, name)
        if name.startswith("chosen"):
            picked.append({(r.doc_id, r.kind) for r in out.collect()})
        return out

    monkeypatch.setattr(C.Scratch, "save", save)
    monkeypatch.setattr(C, "GIVEN_LEAST", 20)
    quality_scores(table(spark, SF01, "documents"), table(spark, SF01, "labels"))
    assert len(picked) == C.ROUNDS and picked[0] and not picked[0] & picked[1] and not (picked[0] | picked[1]) & picked[2]
    assert all(0 < len(p) <= 4 * 20 for p in picked)


def test_two_views_teach_each_other(spark):
    """Two independent informative views: what both say together is better than either view trained alone."""
    rng = np.random.default_rng(11)
    n, good = 1500, "the plain words of a quiet and useful page about rivers and old towns "
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.5)
        text = good * int(rng.integers(1, 4)) if (rng.random() < 0.85) == bool(y) else "BUY!! NOW!! " * int(rng.integers(2, 9))
        rows.append((i, text, "en", f"s{int(rng.integers(4)) + 4 * ((rng.random() < 0.85) == bool(y))}", len(text)))
        if i < 60:
            labels.append((i, y))
        rows[-1] = (*rows[-1], y)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, truth int")
    got = quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    right = lambda col: np.mean([(r[col] >= 0.5) == bool(rows[r.doc_id][5]) for r in got if r.doc_id >= 60])
    assert right("score") >= 0.8 and right("score") >= max(right("text_score"), right("meta_score")) - 0.01
