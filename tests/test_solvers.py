"""Batch solvers against direct least squares and step-by-step recursion."""

import numpy as np
import pytest

from loomcast.operators import solvers as sv

L, E = 9, 99


def packed(ys):
    s = np.array([[y[L:E + 1].sum() for y in ys]])
    c = np.array([[[[(u[L:E + 1] * v[L - k:E + 1 - k]).sum() for k in range(L + 1)] for v in ys] for u in ys]])
    head = np.array([[[y[L - i] for i in range(L + 1)] for y in ys]])
    tail = np.array([[[y[E - i] for i in range(L + 1)] for y in ys]])
    return np.array([E - L + 1.0]), s, c, head, tail


def walk(seed, v, n=120):
    rng = np.random.default_rng(seed)
    return [np.cumsum(rng.normal(size=n)) + rng.normal() for _ in range(v)]


@pytest.mark.parametrize("v", [1, 2, 3])
def test_normal_matrix(v):
    ys = walk(1, v)
    z = np.array([[1] + [y[t - i] for y in ys for i in range(L + 1)] for t in range(L, E + 1)])
    assert np.allclose(sv.normal_matrix(*packed(ys))[0], z.T @ z, rtol=1e-10, atol=1e-8)


def brute(ys, p, d, q, long, steps):
    """Two-stage regression on explicit rows, then the recursion written out."""
    v = len(ys)
    w = [np.diff(y[:E + 1], d) for y in ys]
    at = lambda u, t: w[u][t - d]
    span = range(L, E + 1)
    first = lambda t: [1] + [at(u, t - a) for u in range(v) for a in range(1, long + 1)]
    now = np.array([[at(u, t) for u in range(v)] for t in span])
    b1 = np.linalg.lstsq(np.array([first(t) for t in span]), now, rcond=None)[0]
    shock = lambda t: np.array([at(u, t) for u in range(v)]) - np.array(first(t)) @ b1
    row = lambda t, s: [1] + [at(u, t - a) for u in range(v) for a in range(1, p + 1)] + [x for a in range(1, q + 1) for x in s(t - a)]
    x = np.array([row(t, shock) for t in span])
    b2 = np.linalg.lstsq(x, now, rcond=None)[0]
    known = {t: shock(t) for t in range(E - q, E + 1)}
    w, out = [list(a) for a in w], [list(y[:E + 1]) for y in ys]
    at = lambda u, t: w[u][t - d]
    for h in range(1, steps + 1):
        f = np.array([1] + [at(u, E + h - a) for u in range(v) for a in range(1, p + 1)]
                     + [e for a in range(1, q + 1) for e in known.get(E + h - a, np.zeros(v))]) @ b2
        for u in range(v):
            w[u].append(f[u])
            out[u].append(f[u] + (0 if d == 0 else out[u][-1] if d == 1 else 2 * out[u][-1] - out[u][-2]))
    return ((now - x @ b2) ** 2).sum(0), np.array([o[E + 1:] for o in out])


@pytest.mark.parametrize("v", [1, 2])
@pytest.mark.parametrize("p,d,q", [(3, 0, 0), (1, 0, 1), (2, 1, 2), (0, 2, 2), (0, 1, 0)])
def test_two_stage_fit_and_forecast(v, p, d, q):
    ys = walk(2, v)
    parts = packed(ys)
    cand = dict(p=p, d=d, q=q, sp=0, sd=0, sq=0, m=1)
    assert sv.needed_lags(cand, 4) <= L
    const, coef, extra, sse, _ = sv.Models(sv.normal_matrix(*parts), parts[-1], 4).fit(cand)
    want_sse, want = brute(ys, p, d, q, 4, 12)
    assert np.allclose(sse[0], want_sse, rtol=1e-7)
    state = parts[-1][:, :, :coef.shape[3]]
    got = sv.recurse(const, coef, extra, state, 12)
    assert np.allclose(got[0], want, rtol=1e-6, atol=1e-6)
    assert np.allclose(sv.recurse(const, coef, extra, state, 5, skip=7), got[:, :, 7:], atol=1e-8)


def test_seasonal_lags_and_differences():
    assert list(sv.difference_polynomial(1, 1, 3)) == [1, -1, 0, -1, 1]
    assert sv.lag_set(1, 2, 12) == [1, 12, 13, 24, 25]
    y = walk(3, 1)
    parts = packed(y)
    cand = dict(p=1, d=1, q=0, sp=1, sd=1, sq=0, m=3)
    const, coef, extra, sse, _ = sv.Models(sv.normal_matrix(*parts), parts[-1], 2).fit(cand)
    w = np.diff(y[0][:E + 1])
    w = w[3:] - w[:-3]
    at = lambda t: w[t - 4]
    x = np.array([[1, at(t - 1), at(t - 3), at(t - 4)] for t in range(L, E + 1)])
    target = np.array([at(t) for t in range(L, E + 1)])
    beta = np.linalg.lstsq(x, target, rcond=None)[0]
    assert np.allclose(sse[0, 0], ((target - x @ beta) ** 2).sum())
    step = beta @ [1, at(E), at(E - 2), at(E - 3)] + y[0][E] + y[0][E - 2] - y[0][E - 3]
    got = sv.recurse(const, coef, extra, parts[-1][:, :, :coef.shape[3]], 1)
    assert np.allclose(got[0, 0, 0], step)


@pytest.mark.parametrize("v", [1, 2])
def test_window_map(v):
    ys = walk(4, v)
    parts = packed(ys)
    const, weights, _ = sv.window_fit(sv.normal_matrix(*parts), v, L + 1, 4, 3, 0.0)
    span = range(L, E + 1)
    x = np.array([[1] + [y[t - 3 - i] for y in ys for i in range(4)] for t in span])
    out = np.array([[y[t - 2 + s] for s in range(3) for y in ys] for t in span])
    beta = np.linalg.lstsq(x, out, rcond=None)[0]
    assert np.allclose(weights[0].T, beta[1:], atol=1e-7) and np.allclose(const[0], beta[0], atol=1e-7)
    state = parts[-1][:, :, :4]
    path = sv.window_forecast(const, weights, state, 3, 14)
    assert np.allclose(sv.window_forecast(const, weights, state, 3, 6, skip=8), path[:, :, 8:])
    assert np.allclose(path[0, :, :3].T.ravel(), np.concatenate([[1], state[0].ravel()]) @ beta)


def test_regressors_are_removed():
    ys = walk(5, 3)
    parts = packed(ys)
    s, tail, beta = sv.remove_regressors(sv.normal_matrix(*parts), parts[-1], 2)
    x = np.array([[1, ys[1][t], ys[2][t]] for t in range(L, E + 1)])
    want = np.linalg.lstsq(x, ys[0][L:E + 1], rcond=None)[0]
    assert np.allclose(beta[0], want, rtol=1e-6)
    u = ys[0] - want[0] - want[1] * ys[1] - want[2] * ys[2]
    z = np.array([[1] + [u[t - i] for i in range(L + 1)] for t in range(L, E + 1)])
    assert np.allclose(s[0], z.T @ z, atol=1e-4) and np.allclose(tail[0, 0], u[E - np.arange(L + 1)], atol=1e-6)


def test_penalised_solution_is_optimal():
    rng = np.random.default_rng(6)
    x = np.column_stack([np.ones(80), np.arange(80) / 40 - 1, rng.normal(size=(80, 5)), np.zeros(80)])
    y = x @ np.array([3, 2, 1, 0, 0, -2, 0.1, 0]) + rng.normal(size=80)
    l1, l2 = np.array([0.05] * 3 + [0.0] * 3), np.array([0.0] * 3 + [0.1] * 3)
    beta = sv.penalised((x.T @ x)[None], (x.T @ y)[None], np.array([y @ y]), np.array([l1, 0 * l1]), np.array([l2, 0 * l2]), 2)[0]
    beta, plain = beta
    free = x[:, :2]
    rest = lambda a: a - free @ np.linalg.lstsq(free, a, rcond=None)[0]
    z, t = rest(x[:, 2:]), rest(y)
    size, length = np.sqrt((z ** 2).sum(0)), np.sqrt(t @ t)
    size[size < 1e-9] = 1.0
    b = beta[2:] * size / length
    grad = (z / size).T @ (t / length - (z / size) @ b) - l2 * b
    on = np.abs(b) > 1e-12
    assert np.allclose(grad[on], (l1 * np.sign(b))[on], atol=1e-8)
    assert np.all(np.abs(grad[~on]) <= l1[~on] + 1e-8)
    assert np.allclose(plain[:7], np.linalg.lstsq(x[:, :7], y, rcond=None)[0], atol=1e-6) and plain[7] == 0
