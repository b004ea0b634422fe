"""The prefix trie against a brute-force version, with blocks so small that nodes lie over many of them."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm.common import table
from tallyspark.llm.conversation_trie import common_prefixes, left_ends, ordered_turns, prefix_trie, rebuilt, right_ends, sparse_table

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def original(rows):
    """conv_id -> [(role, text)] from rows (conv_id, turn, role, text)."""
    out: dict = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c // 5 * 5, [])[:h] + own[h:]
    return out


def brute(convs):
    """convs: list of (conv_id, turns)."""
    members: dict = {}
    for c, turns in convs:
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    ended: dict = {}
    for c, turns in convs:
        ended.setdefault(tuple(turns), []).append(c)
    kids, leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}, {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        own = (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += own
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ended.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def told(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLS).collect())


def test_range_minima():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        v, ids = rng.integers(-1, 4, n), rng.integers(0, 1000, n)
        v[0] = -1
        start, depth = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
        right, low = right_ends(sparse_table(v), start, depth, sparse_table(ids), ids[start])
        left = left_ends(sparse_table(v), start, depth)
        for s, d, r, m, le in zip(start, depth, right, low, left, strict=True):
            e = s
            while e + 1 < n and v[e + 1] >= d:
                e += 1
            b = s
            while v[b] >= d:
                b -= 1
            assert (r, m, le) == (e, ids[s:e + 1].min(), b)


def test_common_prefixes():
    seqs = [[], [], [1], [1, 2], [1, 2], [1, 2, 3], [2], [2, 1]]
    flat = np.array([(x, 7 * x) for s in seqs for x in s], np.uint64).reshape(-1, 2)
    first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    assert common_prefixes(flat, first).tolist() == [-1, 0, 0, 1, 2, 2, 0, 1]


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_against_brute_force(spark, blocks):
    rng = random.Random(blocks)
    rows = []
    for c in range(90):
        k = rng.choice([0, 1, 1, 2, 3, 6])
        turns = [("user", "hot first turn")] * (c % 3 == 0) + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "ccc"])) for _ in range(k)]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    rows += [(c, 0, "user", "one very common conversation") for c in range(100, 160)] + [(c, 1, "assistant", "its answer") for c in range(100, 140)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    convs = original(rows)
    assert told(prefix_trie(ordered_turns(df), blocks)) == brute(list(convs.items()))
    assert told(prefix_trie(rebuilt(ordered_turns(df)), blocks)) == brute(list(rebuild(convs).items()))


def test_odd_rows(spark):
    """Null turns come first, tied turns by role and text, null ids take no part, clashing columns are not read."""
    rows = [(1, 2, "b", "x"), (1, None, "z", None), (1, 2, "a", "y"), (1, 2, "a", "x"), (1, 2, "a", "x"), (None, 0, "u", "t"), (-7, 0, None, "long " * 30_000), (6, 0, "u", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", F.lit("no").alias("TEXT"), F.lit(5).alias("Conv_Id"))
    convs = original(rows)
    got = ordered_turns(df)
    assert {r.conv_id: list(r.sizes) for r in got.collect()} == {c: [len(x.encode()) for _, x in t] for c, t in convs.items()}
    assert told(prefix_trie(got)) == brute(list(convs.items()))
    assert told(prefix_trie(ordered_turns(df.where("false")))) == []
    turnless = spark.createDataFrame([(4, b"", []), (9, b"", [])], "conv_id long, key binary, sizes array<long>")
    assert told(prefix_trie(turnless, 4)) == brute([(4, []), (9, [])])


def test_query(spark):
    from tallyspark.llm.queries import op13_conversation_trie

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert told(op13_conversation_trie(spark, sf)) == brute(list(rebuild(original(rows)).items()))
