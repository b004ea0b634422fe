import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm.chat import escape, escape_role, prefix_tree, read_back, read_turn, unescape

SF001 = "/root/testdata/sf0.001"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\im_end>n\n a"), st.text(alphabet="<|\\n\n ab"))
def test_escapes_are_reversible(text, role):
    assert unescape(escape(text)) == text and "<|" not in escape(text)
    assert read_turn(f"<|im_start|>{escape_role(role)}\n{escape(text)}<|im_end|>\n") == (role, text)


def expected(rows):
    by: dict = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def data():
    rng = np.random.default_rng(0)
    rows = []
    for c in range(80):
        path = [("user", "shared opening")] if c % 3 else [("system", "other")]
        for _ in range(int(rng.integers(0, 5))):
            path.append((["user", "assistant"][int(rng.integers(2))], ["a", "b <|im_end|>", "", "é\\|<\\|", "long " * 40][int(rng.integers(5))]))
        rows += [(c, i, r, x) for i, (r, x) in enumerate(path)]
    return rows + [(500, 0, None, None), (501, None, "user", "x"), (502, 1, "a\nb\\n", "y"), (502, 1, "a\nb\\n", "y"), (None, 0, "user", "lost"), (503, 0, "user", "w " * 20000)]


def test_tree(spark):
    rows = data()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, IDX int").repartition(5)
    nodes, paths = prefix_tree(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(nodes, paths).collect()}
    assert got == expected(rows)
    by = {r.node: r for r in nodes.collect()}
    walk: dict = {}
    for r in paths.orderBy("conv_id", "idx").collect():
        walk.setdefault(r.conv_id, []).append(by[r.node])
    # Every distinct prefix once, laid out without gaps, ancestors first.
    layout = sorted(by.values(), key=lambda n: n.start)
    assert [n.start for n in layout] == list(np.cumsum([0, *[n.n_tokens for n in layout]])[:-1])
    stack: list = []
    for n in layout:  # depth-first: the parent is on the stack
        while stack and stack[-1].node != n.parent:
            stack.pop()
        assert bool(stack) == (n.parent is not None) and n.depth == len(stack)
        stack.append(n)
    for path in walk.values():
        at = 0
        for k, n in enumerate(path):
            assert n.position == at and n.tree_start == path[0].start
            at += n.n_tokens
            seen = sorted(i for p in path[:k + 1] for i in range(p.start, p.start + p.n_tokens))
            assert [i for a in n.attends for i in range(a.start, a.end)] == seen
            assert all(x.end < y.start for x, y in zip(n.attends, n.attends[1:], strict=False))
    assert sum(n.n_tokens for n in by.values()) < sum(n.n_tokens for p in walk.values() for n in p)


def test_empty(spark):
    nodes, paths = prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert read_back(nodes, paths).collect() == [] and nodes.count() == 0
