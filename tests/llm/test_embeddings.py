"""Operators 11, 12 and 13 against brute force, with edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives, metric_join, whitening
from corpusloom.llm.eigen import symmetric_qr

SHAPE = "vec_id long, embedding array<float>, label int, node long, vector string, rank int, text string"
BIG = 2**60 + 1
ODD = [(None, [0.5, 0.5], 1), (900, None, 1), (901, [1.0, None], 1), (902, [math.nan, 1.0], 1), (903, [math.inf, 0.0], 1), (904, [0.0, 0.0], 1), (905, [], 2), (906, [1.0], 1), (907, [1.0, 2.0], None)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, "x", 2, "y") for i, v, l in rows], SHAPE)


def vectors(n=240, d=6, seed=3):
    """Random ones, exact copies, near copies of several kinds, and a large tight group."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    base[40:60] = base[10]
    base[60:120] = base[11] + rng.normal(size=(60, d)) * 0.05
    base[120:150] = base[12] + rng.normal(size=(30, d)) * 0.3
    base[150:160] = base[13] * 7
    return [(int(i), [float(np.float32(x)) for x in v], int(i) % 3) for i, v in enumerate(base)]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def filled(v, d=6):
    return np.array([*v, *[0.0] * (d - len(v))])


def brute_links(rows, bound=0.9):
    n = len(rows)
    x = [filled(v) if usable(v) and any(v) else None for _, v, _ in rows]
    links, up = [0] * n, list(range(n))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(n):
        for j in range(n):
            if i != j and x[i] is not None and x[j] is not None and x[i] @ x[j] / math.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= bound:
                links[i] += 1
                up[top(i)] = top(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], least.get(top(i)), rows[i][0] == least.get(top(i))) for i in range(n)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("block", [4096, 32])
def test_metric_join(spark, monkeypatch, block):
    monkeypatch.setattr(metric_join, "CELL", block)
    monkeypatch.setattr(metric_join, "BLOCK", block)
    rows = vectors() + ODD + [(5, vectors()[5][1], 0), (BIG, [1e30, 1e-30], 0), (BIG + 1, [1e-40], 0), (BIG + 2, [-1.0], 0)]
    assert ordered(metric_join.near_duplicates(table(spark, rows)).collect()) == ordered(brute_links(rows))


def test_metric_join_at_the_bound(spark):
    side = math.sqrt(1 - 0.81)
    for by, links in ((1e-7, 1), (-1e-7, 0)):
        df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9 + by, math.sqrt(1 - (0.9 + by) ** 2)])], "vec_id long, embedding array<double>")
        assert [r.n_links for r in metric_join.near_duplicates(df).collect()] == [links] * 2
    exact = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, side])], "vec_id long, embedding array<double>")
    want = int(0.9 / math.sqrt(0.9 * 0.9 + side * side) >= 0.9)
    assert {r.n_links for r in metric_join.near_duplicates(exact).collect()} == {want}


def test_metric_join_of_nothing(spark):
    assert metric_join.near_duplicates(table(spark, [])).count() == 0
    got = metric_join.near_duplicates(table(spark, [(2, None, 1), (3, [0.0], 1), (None, None, 1)])).collect()
    assert ordered(got) == [(2, 0, 2, True), (3, 0, 3, True), (None, 0, None, True)]


def test_cells_prune_what_is_far(spark, monkeypatch):
    """Tight groups far apart: blocks of different groups never meet, nor do those of one group."""
    monkeypatch.setattr(metric_join, "CELL", 20)
    monkeypatch.setattr(metric_join, "BLOCK", 10)
    rng = np.random.default_rng(1)
    rows = [(int(k * 40 + i), [float(x) for x in np.eye(6)[k] + rng.normal(size=6) * 0.01], 0) for k in range(6) for i in range(40)]
    join = metric_join.MetricJoin(table(spark, rows))
    found = join.links()
    assert found.count() == 240 and {r.links for r in found.collect()} == {39}
    cells = np.array([metric_join._distances(metric_join.unit(np.array([v for _, v, _ in rows])), join.plan.pivots)])
    assert len(join.plan.pivots) == 6 and (cells.min(axis=-1) < 0.1).all()
    assert join.plan.core.all()


def brute_mining(rows):
    part = [(i, np.floor(256 * filled(v)).astype(object).astype(object), l) for i, v, l in rows if i is not None and l is not None and usable(v)]
    part = [(i, [int(c) for c in x], l) for i, x, l in part]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for k, (a, x, label) in enumerate(part):
        if a % 100:
            continue
        scored = [(-dot(x, y), i, l) for j, (i, y, l) in enumerate(part) if j != k]
        positives = sorted((s, i) for s, i, l in scored if l == label)[:5]
        negatives = sorted((s, i) for s, i, l in scored if l != label)
        for s, p in positives:
            fit = [(n, i) for n, i in negatives if 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit)]
    return out


@pytest.mark.parametrize("rows_, anchors, chunk, tile", [(4096, 256, 32, 64), (40, 2, 2, 1)])
def test_hard_negatives(spark, monkeypatch, rows_, anchors, chunk, tile):
    for name, value in (("ROWS", rows_), ("ANCHORS", anchors), ("CHUNK", chunk), ("TILE", tile)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = [(i * 10, v, l) for i, v, l in vectors()] + ODD + [(BIG, [0.1, 0.2], 1), (BIG + 1, [0.1, 0.2], 1), (4000, [0.5] * 6, 7), (20, [0.25, 0.0, 0.0, 1.0], 0)]
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 100 == 0).collect()
    want = brute_mining(rows)
    assert len(want) > 200 and ordered(got) == ordered(want)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(table(spark, [(1, [1.0], 1), (2, [1.0], 2)]), F.col("vec_id") % 100 == 0).count() == 0
    one = table(spark, [(100, [1.0], 1), (2, [0.5], 2), (None, [1.0], 1)])
    assert hard_negatives.mine(one, F.col("vec_id") % 100 == 0).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for size in (1 << 8, 1 << 24, 1 << 28):
        a, b = rng.integers(-size, size, (7, 9)), rng.integers(-size, size, (5, 9))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        assert hard_negatives.product(a, b).tolist() == want
    s = np.array([5, 9, 9, 1, 9, np.iinfo(np.int64).min])
    assert hard_negatives.best(s, s > 0, 2).tolist() == [1, 2] and hard_negatives.best(s, s == s, 9).tolist() == [1, 2, 4, 0, 3, 5]


def test_symmetric_qr():
    rng = np.random.default_rng(2)
    cases = [np.zeros((3, 3)), np.eye(4), np.diag([1.0, -5.0, 3.0]), np.array([[2.0]]), np.ones((5, 5)), np.array([[0.0, 1.0], [1.0, 0.0]])]
    for n in (2, 3, 10, 64):
        x = rng.normal(size=(n, n))
        cases += [x + x.T, (x * 10.0 ** rng.integers(-4, 4, n)) @ (x * 10.0 ** rng.integers(-4, 4, n)).T + 0 * x, np.outer(x[0], x[0])]
    for v in cases:
        v = (v + v.T) / 2
        e, q = symmetric_qr(v)
        size = max(1e-300, np.abs(v).max())
        assert np.allclose(q.T @ q, np.eye(len(v)), atol=1e-13) and (np.diff(e) <= 0).all()
        assert np.abs(v @ q - q * e).max() <= 1e-13 * size * len(v)
        assert np.allclose(e, np.linalg.eigvalsh(v)[::-1], atol=1e-13 * size * len(v))


def whole(v, d=6):
    return [math.floor(64 * x) + 1_000_000 for x in filled(v, d)]


@pytest.mark.parametrize("batch", [2, 2500])
def test_whitening(spark, monkeypatch, batch):
    monkeypatch.setattr("corpusloom.llm.common.BATCH_ROWS", batch)
    rows = vectors() + ODD + [(5, vectors()[5][1], 0)]
    df = table(spark, rows).repartition(40)
    got = whitening.whiten(df).collect()
    part = [(i, whole(v)) for i, v, _ in rows if usable(v)]
    n, x = len(part), np.array([w for _, w in part])
    s = x.sum(axis=0)
    v = np.cov((x - 1_000_000).T, bias=True)
    e = np.linalg.eigvalsh(v)[::-1]
    assert len(got) == n * 6 and {r.n for r in got} == {n} and {r.identity_error < 1e-10 for r in got} == {True}
    want = sorted((i is None, i or 0, int(((n * w - s) ** 2).sum())) for i, w in zip([i for i, _ in part], x))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in got if r.component == 1) == want
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, set()).add(r.whitened)
        assert math.isclose(r.explained, e[r.component - 1] / np.trace(v), rel_tol=1e-9)
    for i, w in zip([i for i, _ in part], x):
        y = by[i, int(((n * w - s) ** 2).sum())]
        size = sum(max(t) ** 2 * e[c - 1] for c, t in y.items())
        assert math.isclose(size, ((w - s / n) ** 2).sum(), rel_tol=1e-9, abs_tol=1e-9)


def test_whitening_of_little(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    one = whitening.whiten(table(spark, [(1, [0.5, 0.25], 0)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 1, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    flat = whitening.whiten(table(spark, [(1, [0.5, 3.0], 0), (2, [0.25, 3.0], 0), (3, [0.0, 3.0], 0)])).collect()
    assert {r.whitened for r in flat if r.component == 2} == {0.0} and max(r.identity_error for r in flat) < 1e-12
    huge = whitening.whiten(table(spark, [(1, [3e38], 0), (2, [-3e38], 0)])).collect()
    assert {r.deviation for r in huge} == {None} and [abs(round(r.whitened, 9)) for r in huge] == [1.0, 1.0]


def test_moments_merge():
    rng = np.random.default_rng(8)
    x = rng.integers(-9, 9, (50, 4)) + 10**6
    own = whitening.Moments(4)
    for part in np.split(x, [3, 3, 20]):
        other = whitening.Moments(4)
        other.add(part.astype(float))
        other.count(part)
        own.merge(other)
    assert own.n == 50 and own.sums == x.sum(axis=0).tolist()
    assert np.allclose(own.covariance(), np.cov(x.T, bias=True), rtol=1e-9)
