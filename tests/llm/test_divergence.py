"""The divergence audit against a brute-force version, with colliding digests, many tiles and blocks, and odd rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import tallyspark.llm.divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COLS = ["lang", "source", "part", "item", "value", "rank"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(rows, least):
    """rows: (lang, source, text)."""
    groups, docs = {}, {}
    for la, so, t in rows:
        la, words = la or "", TERM.findall(lower(t or ""))
        groups.setdefault((la, so or ""), Counter()).update(words)
        docs.setdefault(la, Counter()).update(set(words))
    out = []
    for (la, so), c in groups.items():
        kept = [w for w, n in docs[la].items() if n >= least]
        peers = {s: x for (k, s), x in groups.items() if k == la}
        whole = Counter()
        for x in peers.values():
            whole.update(x)

        def p(x):
            n = sum(x[w] for w in kept)
            return {w: 1 + 10**9 * (x[w] + 5) // (n + 5 * len(kept)) for w in kept}  # noqa: B023

        mine, all_ = p(c), p(whole)
        pairs = [(s, sum(abs(mine[w] - q) for w, q in p(x).items())) for s, x in peers.items() if s != so]
        terms = [(w, mine[w] - all_[w]) for w in kept if c[w] and mine[w] > all_[w]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(la, so, part, i, v, r) for r, (i, v) in enumerate(found, 1) if part == "pair" or r <= 50]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "Of", "ß", "Straße", "café", "É", "日本語", "naïve"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    rows = [(rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 4 + [f"s{i}" for i in range(9)] + [None]),
             rng.choice([" ", "1", "-", "\x00", "\n"]).join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))) for _ in range(n)]
    return rows + [("en", "no terms", "1 2 3"), ("xx", "alone", "a"), ("yy", "a", None), ("yy", "b", ""), ("en", "hot", "long" * 50_000 + " the")]


@pytest.mark.parametrize("bits, tile, cells", [(64, 256, 1 << 16), (6, 3, 40)])
def test_against_brute_force(spark, monkeypatch, bits, tile, cells):
    monkeypatch.setattr(D, "TILE", tile)
    monkeypatch.setattr(D, "CELLS", cells)
    rows = corpus(64, 500)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    df = df.select("*", F.lit("x").alias("LANG"), F.lit("x").alias("Text"))
    want = brute(rows, 30)
    assert len([r for r in want if r[2] == "term"]) > 100 and told(D.divergence(df, bits=bits)) == want


def test_ties_and_empty(spark):
    rows = [("en", s, " ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(k, k + 80))) for s in "ab" for k in (0, 60) for _ in range(2 + (s == "a") * (k == 0))]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert told(D.divergence(df, least_docs=2)) == brute(rows, 2)
    assert told(D.divergence(df)) == brute(rows, 30)  # nothing is kept: all distances are 0
    assert D.divergence(df.where("false")).count() == 0
