import re
from collections import defaultdict

import numpy as np
import pytest

from tallyspark.llm.suffix_dedup import cut_repeats, repeated_passages


def brute(rows, n):
    """doc -> (words in a repeated run, words to cut): every run of n words counted."""
    where = defaultdict(list)
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            where[tuple(w[i:i + n])].append((d, i))
    rep, later, first = defaultdict(set), defaultdict(set), defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for k, (d, i) in enumerate(sorted(places)):
                rep[d] |= set(range(i, i + n))
                (later if k else first)[d] |= set(range(i, i + n))
    return {d: (sorted(s), sorted(later[d] - first[d])) for d, s in rep.items()}


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdé"), 3))
    passages = [[word() for _ in range(int(rng.integers(15, 60)))] for _ in range(8)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(int(rng.integers(0, 5))):
            w += [word() for _ in range(int(rng.integers(0, 30)))]
            if rng.random() < 0.6:
                p = passages[int(rng.integers(8))]
                i = int(rng.integers(0, 10))
                w += p[i:len(p) - int(rng.integers(0, 5))]
        rows.append((d, " ".join(w)))
    rows += [(100, rows[7][1]), (101, rows[7][1]), (102, "go " * 90), (103, "ab\n" * 70 + "cd"), (104, None), (105, ""), (106, "x")]
    return rows


@pytest.mark.parametrize("n,gram", [(20, 6)])
def test_spans_and_cuts(spark, n, gram):
    rows = corpus(4)
    docs = spark.createDataFrame([(d, t, "en", 5) for d, t in rows], "doc_id long, text string, first string, ATS int")
    found = repeated_passages(docs, min_words=n, gram=gram).cache()
    flat = lambda spans: [i for s in spans for i in range(s.start, s.end)]
    got = {r.doc_id: (flat(r.spans), flat(r.cuts)) for r in found.collect()}
    want = brute(rows, n)
    assert got == want
    out = {r.doc_id: r for r in cut_repeats(docs, found).collect()}
    for d, t in rows:
        w, cut = (t or "").split(), set(want.get(d, ((), ()))[1])
        if not cut:
            assert out[d].text == t
        elif len(cut) == len(w):
            assert d not in out
        else:
            assert out[d].text.split() == [x for i, x in enumerate(w) if i not in cut] and out[d].first == "en"


def test_small_cases(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, text), (3, text[:50])]
    r = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(x.doc_id, x.repeated_words, x.cut_words) for x in r] == [(1, 60, 0)]
