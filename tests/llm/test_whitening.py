import math
from collections import Counter

import numpy as np
import pytest

from parcelfusion.llm.whitening import apart, component_rows, deviations, whitened

SCALE, SHIFT = 1024, 100_000


def brute(rows, components, weighted=True):
    """key, n, deviation, whitened up to sign, explained of every usable row of one length."""
    use = [(k, tuple(math.floor(SCALE * float(c)) + SHIFT for c in v)) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [x for _, x in use] if weighted else list({x for _, x in use})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[v - t / n for v, t in zip(x, s, strict=True)] for x in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for k, x in use:
        w = np.array([v - t / n for v, t in zip(x, s, strict=True)]) @ vectors / np.sqrt(values)
        out.append((k, n, sum((n * v - t) ** 2 for v, t in zip(x, s, strict=True)), w, values / np.trace(cov)))
    return out


def rows_of(n, d, seed, copies=30):
    rng = np.random.default_rng(seed)
    base = (rng.normal(size=(n, d)) * np.linspace(2, 0.1, d)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(n + i, rows[3][1]) for i in range(copies)] + [(n + copies + i, rows[i % 7][1]) for i in range(copies)]
    return rows + [(-1, None), (-2, [None] + rows[0][1][1:]), (-3, [float("nan")] + rows[0][1][1:]), (-4, [float("-inf")] + rows[0][1][1:]), (-5, [1e300] + rows[0][1][1:])]


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, 2, "w", 3) for r in rows], "vec_id long, embedding array<double>, label int, dim int, whitened string, weight long").repartition(5)


@pytest.mark.parametrize("weighted", [True, False])
def test_against_brute_force(frame, weighted):
    rows = rows_of(90, 12, 1)
    found = {r.vec_id: r for r in whitened(frame(rows), weighted=weighted).collect()}
    want = brute([r for r in rows if r[0] >= -4], 8, weighted)
    assert set(found) == {w[0] for w in want}
    signs = np.sign(np.array(found[0].whitened) * want[0][3])
    for k, n, deviation, w, explained in want:
        r = found[k]
        assert (r.n, r.deviation) == (n, deviation)
        assert np.allclose(np.array(r.whitened) * signs, w, rtol=1e-7, atol=1e-7)
        assert np.allclose(r.explained, explained, rtol=1e-9)
        assert 0 <= r.identity_error < 1e-8
    assert len({r.identity_error for r in found.values()}) == 1


def test_identity_error_is_measured(frame):
    """It is that of the whitened rows themselves, each as often as it counts."""
    found = whitened(frame(rows_of(60, 6, 2)), components=4).collect()
    w = np.array([r.whitened for r in found])
    centred = w - w.mean(axis=0)
    assert abs(np.abs(centred.T @ centred / len(w) - np.eye(4)).max() - found[0].identity_error) < 1e-12


def test_each_distinct_vector_is_fitted_once(spark, frame):
    """The tables that are fitted hold one row a vector, with its number."""
    rows = rows_of(40, 5, 3, copies=500)
    counts = Counter(tuple(v) for k, v in rows if k >= 0)
    plan = whitened(frame(rows))._jdf.queryExecution().analyzed().toString()
    assert "whitening-whitened" in plan or "parquet" in plan
    assert len(whitened(frame(rows)).collect()) == sum(counts.values())


def test_component_rows(frame):
    rows = rows_of(50, 10, 4)
    found = component_rows(whitened(frame(rows), components=8))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = found.collect()
    assert len(got) == 8 * (50 + 60) and {r.component for r in got} == set(range(1, 9))
    first = {r.component: r.explained for r in got}
    assert sorted(first.values(), reverse=True) == [first[c] for c in range(1, 9)]


def test_edges(frame):
    assert whitened(frame([(1, [1.0, 2.0])]).where("false")).collect() == []
    one = whitened(frame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()  # nothing varies
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(3, 0, [], [], 0.0)] * 3
    line = whitened(frame([(i, [float(i), 2.0 * i, 5.0]) for i in range(4)])).collect()  # one direction alone
    assert all(len(r.whitened) == 1 and r.identity_error < 1e-9 for r in line) and abs(line[0].explained[0] - 1) < 1e-12
    mixed = whitened(frame([(1, []), (2, [0.5]), (3, [1.5]), (4, [1.0, 2.0]), (5, [2.0, 1.0]), (6, [2.0, 5.0])]), components=2).collect()
    assert {r.vec_id: (r.n, len(r.whitened)) for r in mixed} == {2: (2, 1), 3: (2, 1), 4: (3, 2), 5: (3, 2), 6: (3, 2)}


def test_exact_beyond_64_bits():
    x, n = np.array([[1 << 40, -(1 << 40)], [5, 7]]), 1 << 30
    s = [(1 << 70) + 5, 9]
    e = apart(x, n, s)
    assert [[int(v) for v in r] for r in e] == [[n * int(v) - t for v, t in zip(r, s, strict=True)] for r in x]
    assert deviations(e) == [None, None]
    assert deviations(np.array([[3_000_000_000, 4], [1 << 32, 0]])) == [9_000_000_000_000_000_016, None]
