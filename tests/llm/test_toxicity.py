import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import toxicity
from tallyspark.llm.common import table
from tallyspark.llm.toxicity import GRAMS, fit, present, toxicity_scores, without_toxic
SF01 = "/root/testdata/sf0.01"


def test_ngrams_stay_within_rows():
    texts = ["ABc dÉf", "", "ab", "abc", "😀xyz"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    row, f = present(np.frombuffer(b"".join(raw), np.uint8), off)
    want = {i: sum(len({t.lower()[k:k + n] for k in range(len(t) - n + 1)}) for n in GRAMS) for i, t in enumerate(texts)}
    assert {i: int((row == i).sum()) for i in want} == want
    low = present(np.frombuffer("abc déf".encode(), np.uint8), np.array([0, 8]))[1]
    assert set(low) == set(f[row == 0])


def test_one_class_or_none():
    f, w, b = fit([b"a b c"] * 3, np.zeros(3, np.int64))
    assert not len(f) and b < 0
    f, w, b = fit([], np.zeros(0, np.int64))
    assert not len(f) and b == 0


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    got = {r.doc_id: r for r in toxicity_scores(docs, labels).collect()}
    want = duckdb.sql(f"select doc_id, toxic from '{SF01}/labels.parquet'").fetchall()
    assert len(got) == docs.count() and all((zlib.crc32(str(d).encode()) % 5 == 0) == r.held_out for d, r in got.items())
    test = [(got[d].predicted, y) for d, y in want if got[d].held_out]
    assert sum(p == y for p, y in test) >= 0.93 * len(test)
    hit = [p for p, y in test if y == 1]
    assert sum(hit) >= 0.6 * len(hit)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (1, "you idiot"), (None, "x"), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "1 as score", "'a' as Y")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity_scores(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert got[0].score == got[1].score
    assert toxicity_scores(docs.limit(0), labels.limit(0)).collect() == []
    assert without_toxic(docs, labels).columns == docs.columns


def _planted(n1, n0):
    """Texts of common words; of the made-up words, each is in five toxic texts and in no clean one."""
    common = "the river runs past old houses while people walk slowly along quiet streets under warm light".split()
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("bcdfgjkqvxz"), 9)) for _ in range(n1 // 5)]
    texts = [list(rng.choice(common, 12)) for _ in range(n1 + n0)]
    for i in range(n1):
        texts[i].insert(5, words[i // 5])
    return [" ".join(t) for t in texts], [1] * n1 + [0] * n0, words


def _stage(spark, n1, n0):
    """Labelled rows by ids that are not held out; unlabelled rows with one of the words each, and one with none."""
    texts, labels, words = _planted(n1, n0)
    ids = [i for i in range(10 * len(texts)) if zlib.crc32(str(i).encode()) % 5][:len(texts)]
    new = [(100_000 + i, f"people walk along {w} the old river") for i, w in enumerate(["past", *words])]
    docs = spark.createDataFrame([*zip(ids, texts, strict=True), *new], "doc_id long, text string")
    return docs, spark.createDataFrame(list(zip(ids, labels, strict=True)), "doc_id long, toxic int"), len(words)


def test_few_labels_find_planted_words(spark):
    for n1, n0 in ((10, 58), (50, 50)):
        docs, known, n = _stage(spark, n1, n0)
        new = {r.doc_id: r.predicted for r in toxicity_scores(docs, known).collect() if r.doc_id >= 100_000}
        assert new == {100_000 + i: int(i > 0) for i in range(n + 1)}
        assert {r.doc_id for r in without_toxic(docs, known).collect() if r.doc_id >= 100_000} == {100_000}


def test_no_model_keeps_every_document(spark):
    """No labels, or labels of one class: nothing was learned, nothing goes."""
    docs, known, _ = _stage(spark, 10, 10)
    n = docs.count()
    for labels in (known.limit(0), known.where("toxic = 1"), known.where("toxic = 0"), known.selectExpr("doc_id", "null as toxic")):
        assert without_toxic(docs, labels).count() == n
        assert {r.predicted for r in toxicity_scores(docs, labels).collect()} == {0}


def test_balanced_labels_without_a_shared_ngram(spark):
    docs = spark.createDataFrame([(1, "aaaa"), (2, "bbbb"), (3, "cccc"), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert without_toxic(docs, labels).count() == 4 and {r.predicted for r in toxicity_scores(docs, labels).collect()} == {0}


def test_a_text_that_does_not_fit_is_skipped_alone(monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_BYTES", 2500)
    texts, labels, _ = _planted(10, 10)
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 3000, *texts]), pa.array([0, *labels])], names=["text", "y"])
    m = next(toxicity._fit_task(iter([b]))).to_pylist()[0]
    f, w, bias = fit([t.encode() for t in texts], np.array(labels))
    assert len(f) and m["feature"] == f.tobytes() and m["weight"] == w.tobytes() and m["bias"] == bias


def test_memory_of_a_task():
    """Scoring holds the n-grams of little text at once; learning holds ratios of the kept features only."""
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(2000)]

    def peak(run):
        tracemalloc.start()
        out = run()
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, size

    few = [t.encode() for t in texts[:40]]
    model, size = peak(lambda: toxicity.fit(few, np.arange(40) % 2))
    assert size < 100 << 20
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    (got,), size = peak(lambda: list(toxicity._score_task(*model)(iter([b]))))
    assert size < 60 << 20
    # As if each text were scored by itself.
    alone = [next(toxicity._score_task(*model)(iter([b.slice(i, 1)]))).column(1)[0].as_py() for i in (0, 1, 700, 1999)]
    assert [got.column(1)[i].as_py() for i in (0, 1, 700, 1999)] == pytest.approx(alone, abs=1e-12)
