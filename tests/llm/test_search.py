import math

import numpy as np
import pytest

from tallyspark.llm.ann import Quantised, nearest, tile
from tallyspark.llm.topk import exact_topk


def rows(seed, n=700, dim=12, near=0.3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, dim))
    x = (base[rng.integers(20, size=n)] + near * rng.normal(size=(n, dim))).astype(np.float32)
    out = [(i, x[i].tolist()) for i in range(n)]
    out += [(n + i, x[3].tolist()) for i in range(60)]  # many equal scores
    out += [(2000, None), (2020, [float("nan")] * dim), (2040, [None] * dim), (2060, [math.inf] * dim), (None, x[0].tolist()), (2080, [0.0] * dim), (2100, x[5].tolist()[:4]), (40, x[9].tolist())]
    return out


def brute(data, score, zero):
    ok = [(i, v) for i, v in data if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v))]
    out = []
    for a, (i, v) in enumerate(ok):
        if i % 20 == 0:
            all_ = sorted((-score(v, w), j) for b, (j, w) in enumerate(ok) if a != b)[:20]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(all_, 1)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<float>, rid int, V string")


def test_topk_is_exact(spark):
    data = rows(1)
    inner = lambda v, w: sum(math.floor(64 * float(np.float32(x))) * math.floor(64 * float(np.float32(y))) for x, y in zip(v, w, strict=False))
    got = [tuple(r) for r in exact_topk(frame(spark, data)).collect()]
    assert sorted(got) == sorted(brute(data, inner, True))


def test_nearest_is_exact(spark):
    data = rows(2)
    inner = lambda v, w: float((np.float32(v).astype(float)[:min(len(v), len(w))] * np.float32(w).astype(float)[:min(len(v), len(w))]).sum())
    got, want = sorted(tuple(r) for r in nearest(frame(spark, data)).collect()), sorted(brute(data, inner, False))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-12)
    assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) >= 0.999 * len(got)


def test_error_bound():
    rng = np.random.default_rng(0)
    for scale in (1e-3, 1, 1e4):
        a, b = rng.normal(size=(50, 64)) * scale, rng.normal(size=(80, 64)) * np.exp(rng.normal(size=(80, 1)))
        p, bound = tile(Quantised(a), Quantised(b))
        assert (np.abs(p - a @ b.T) <= bound).all()


def test_large_and_small_components(spark):
    """Norms beyond double precision, products that overflow or underflow: every finite vector takes part."""
    def of(data):
        df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
        return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df).collect())

    assert of([(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [1.0, 0.0])]) == [(0, 1, 1, math.inf), (0, 2, 2, 1e200)]
    rng = np.random.default_rng(4)
    scale = 10.0 ** rng.integers(-170, 150, 400)
    data = [(i, (rng.normal(size=5) * s).tolist()) for i, s in enumerate(scale)]
    got = of(data)
    x = np.array([v for _, v in data])
    for q in range(0, 400, 20):
        s = np.zeros(400)
        for d in range(5):
            s = s + x[q, d] * x[:, d]
        want = sorted((-v, j) for j, v in enumerate(s) if j != q)[:20]
        assert [(r[2], r[3]) for r in got if r[0] == q] == [(j, -v) for v, j in want]


@pytest.mark.parametrize("search", [exact_topk, nearest])
def test_few_rows(spark, search):
    assert search(frame(spark, [])).collect() == []
    got = search(frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [-1.0, 0.0])])).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert search(frame(spark, [(0, [1.0])])).collect() == []
