import re

import numpy as np
import pytest

from tallyspark.llm import ngram_join as N
from tallyspark.llm.common import hash_grams, hash_words, row_words


def brute(rows, top=75):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = [d for d, _ in rows]
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= top * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    moved = True
    return sorted((d, len(s), c) for (d, _), s, c in zip(rows, sets, comp, strict=True))


def corpus(seed, groups=12, copies=8, spread=0.06, n=80):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefg"), 4))
    rows, passage = [], [word() for _ in range(25)]
    for _ in range(groups):
        base = [word() for _ in range(int(rng.integers(5, n)))]
        if rng.random() < 0.5:
            base[3:3] = passage
        for _ in range(int(rng.integers(1, copies))):
            rows.append(" ".join(word() if rng.random() < spread * rng.random() else w for w in base))
    rows += ["", None, "  \n", "One two", "one  TWO", "one two three", "x y É a b c", "x y é a b c", rows[0], rows[0].upper()]
    return [(i + 10, t) for i, t in enumerate(rows)]


def got(spark, rows, **kw):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, n string, KEY int")
    return sorted(tuple(r) for r in N.ngram_jaccard_components(df, **kw).collect())


@pytest.mark.parametrize("seed", [1])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_long_lists(spark, monkeypatch):
    """Many near copies of one text, some of which link only through others."""
    rows = corpus(5, groups=2, copies=2) + [(1000 + i, t) for i, (_, t) in enumerate(corpus(7, groups=1, copies=60, spread=0.15, n=60))]
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows += [(2000 + i, " ".join(f"z{i}{j}" if rng.random() < 0.03 else w for j, w in enumerate(base))) for i in range(60)]
    # A long text that holds the base and much else is nobody's copy, but shares most with all of them.
    rows += [(3000, " ".join(base + [f"q{i}" for i in range(40)])), (3001, " ".join(base + [f"q{i}" for i in range(40)] + ["end"]))]
    monkeypatch.setattr(N, "SHORT", 3)
    monkeypatch.setattr(N, "SPLIT", 16)
    monkeypatch.setattr(N, "POOL", 400)
    monkeypatch.setattr(N, "FRAGMENT", 500)
    assert got(spark, rows) == brute(rows)


def test_more_classes_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(N, "SENT", 3)
    rows = corpus(2)
    assert got(spark, rows) == brute(rows)


def test_hashes_do_not_depend_on_slices():
    text = "Ab  ab\tcdé ef\n" + "x" * 300_000 + " tail end"
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, first = row_words(data, np.array([0, len(data)]))
    h = hash_words(data, s, e, lower=True)
    assert len(h) == 7 and h[0] == h[1] and list(first) == [0, 7]
    one = [hash_words(data[a:b], np.array([0]), np.array([b - a]), lower=True)[0] for a, b in zip(s, e, strict=True)]
    assert list(h) == one
    assert (hash_grams(h, 3)[1:] == hash_grams(h[1:], 3)).all() and len(hash_grams(h, 8)) == 0
    a, b = hash_grams(np.tile(h, 5), 12), hash_grams(np.tile(h, 5)[7:], 12)
    assert (a[7:] == b).all() and (a[:7] == a[7:14]).all()


def test_empty_table_and_null_ids(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(((r[0], r[1], r[2]) for r in N.ngram_jaccard_components(df).collect()), key=repr) == [(2, 2, 2), (3, 2, 2), (None, 2, None)]
