"""Small linear algebra on batches of lag-product rows (NumPy, inside Arrow tasks).

Every function works on a batch of B rows at once; one row is one (series, fold). Nothing here
depends on the length of a series.
"""

from __future__ import annotations

import numpy as np

OK, SHORT, GAPS, UNSTABLE = 0, 1, 2, 3
STATUS = ["ok", "short", "gaps", "unstable"]


def normal_matrix(rows, s, c, head, tail):
    """S over z = [1, lags 0..L of column 1, lags 0..L of column 2, ...]: (B, Z, Z).

    s: (B, V), c: (B, V, V, L+1), head and tail: (B, V, L+1).
    """
    b, v, width = head.shape
    block = np.empty((b, v, width, v, width))
    block[:, :, 0] = c
    block[:, :, :, :, 0] = np.swapaxes(c, 1, 2).swapaxes(2, 3)
    for i in range(width - 1):
        block[:, :, i + 1, :, 1:] = (
            block[:, :, i, :, :-1]
            + head[:, :, i + 1, None, None] * head[:, None, :, 1:]
            - tail[:, :, i, None, None] * tail[:, None, :, :-1])
    lead = np.cumsum(head, axis=2) - head[:, :, :1]
    trail = np.cumsum(tail, axis=2) - tail
    first = (s[:, :, None] + lead - trail).reshape(b, v * width)
    z = v * width + 1
    out = np.empty((b, z, z))
    out[:, 0, 0] = rows
    out[:, 0, 1:] = out[:, 1:, 0] = first
    out[:, 1:, 1:] = block.reshape(b, v * width, v * width)
    return out


def least_squares(gram, rhs, ridge=0.0, free=1):
    """Solve (gram + penalty) beta = rhs on the correlation scale; ``free`` leading terms unpenalised."""
    scale = np.sqrt(np.maximum(np.einsum("bii->bi", gram), 0.0))
    scale[scale == 0.0] = 1.0
    a = gram / scale[:, :, None] / scale[:, None, :]
    size = a.shape[1]
    penalty = np.full(size, ridge)
    penalty[:free] = 0.0
    a = a + np.diag(penalty + 1e-11)
    y = rhs / scale[:, :, None]
    beta = _solve(a, y)
    beta += _solve(a, y - a @ beta)
    return beta / scale[:, :, None]


def _solve(a, y):
    """Stacked solve; a singular or non-finite matrix gives NaN in its own row and leaves the others alone."""
    ok = np.isfinite(a).all(axis=(1, 2))
    if ok.all():
        try:
            return np.linalg.solve(a, y)
        except np.linalg.LinAlgError:
            pass
    out = np.full(y.shape, np.nan)
    for i in np.flatnonzero(ok):
        try:
            out[i] = np.linalg.solve(a[i], y[i])
        except np.linalg.LinAlgError:
            pass
    return out


def recentre(s_matrix, tail):
    """S and tail with the training mean of each column taken from its values, and these means (B, V)."""
    b, v, width = tail.shape
    rows = np.maximum(s_matrix[:, 0, 0], 1.0)
    shift = s_matrix[:, 0, 1::width] / rows[:, None]
    move = np.tile(np.eye(s_matrix.shape[1]), (b, 1, 1))
    move[:, 1:, 0] = -np.repeat(shift, width, axis=1)
    return move @ s_matrix @ np.swapaxes(move, 1, 2), tail - shift[:, :, None], shift


def difference_polynomial(d, D, m):
    """Coefficients of (1 - B)^d (1 - B^m)^D, constant term first."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    seasonal = np.zeros(max(m, 1) + 1)
    seasonal[0], seasonal[-1] = 1.0, -1.0
    for _ in range(D):
        poly = np.convolve(poly, seasonal)
    return poly


def lag_set(order, seasonal, m):
    """{i + m j : i <= order, j <= seasonal} without 0."""
    return sorted({i + m * j for i in range(order + 1) for j in range(seasonal + 1)} - {0})


def long_lags(cand, long):
    """Lags of the first-stage autoregression whose residuals stand in for the shocks."""
    m, top = cand["m"], max(cand["sp"], cand["sq"])
    near = set(range(1, long + 1))
    return sorted(near | {i + m * j for j in range(1, top + 1) for i in range(max(cand["p"], cand["q"]) + 1)})


def needed_lags(cand, long):
    """Largest lag of the data that a candidate touches."""
    shift = cand["d"] + cand["sd"] * cand["m"]
    ar = max(lag_set(cand["p"], cand["sp"], cand["m"]), default=0)
    ma = max(lag_set(cand["q"], cand["sq"], cand["m"]), default=0)
    first = ma + max(long_lags(cand, long)) if ma else 0
    return shift + max(ar, first)


class Models:
    """Fit one candidate to a batch: y_t = const + sum coef_i y_(t-i) + extra terms of the first steps."""

    def __init__(self, s_matrix, tail, long):
        self.s, self.tail, self.long = s_matrix, tail, long
        self.b, self.v, self.width = tail.shape
        self._stage1, self._past = {}, {}

    def _pick(self, poly, var, at):
        """Row over z that gives the differenced value of a column, ``at`` steps back."""
        row = np.zeros(self.s.shape[1])
        start = 1 + var * self.width + at
        row[start:start + len(poly)] = poly
        return row

    def _shocks(self, poly, lags):
        """First stage: (B, V, 1 + V * lags) coefficients of a long autoregression."""
        key = (tuple(poly), tuple(lags))
        if key not in self._stage1:
            one = np.zeros(self.s.shape[1])
            one[0] = 1.0
            x = np.array([one] + [self._pick(poly, u, a) for u in range(self.v) for a in lags])
            y = np.array([self._pick(poly, u, 0) for u in range(self.v)])
            beta = least_squares(x @ self.s @ x.T, x @ self.s @ y.T)
            self._stage1[key] = beta
        return self._stage1[key]

    def _shock_rows(self, poly, lags, at):
        """(B, V, Z): shock of each column ``at`` steps back as a combination of z."""
        beta = self._shocks(poly, lags)
        one = np.zeros(self.s.shape[1])
        one[0] = 1.0
        x = np.array([one] + [self._pick(poly, u, a + at) for u in range(self.v) for a in lags])
        y = np.array([self._pick(poly, u, at) for u in range(self.v)])
        return y[None] - np.swapaxes(beta, 1, 2) @ x

    def _shock(self, poly, lags, at):
        """(B, V): value of the shocks ``at`` steps before the end."""
        key = (tuple(poly), tuple(lags), at)
        if key not in self._past:
            flat = np.concatenate([np.ones((self.b, 1)), self.tail.reshape(self.b, -1)], axis=1)
            self._past[key] = np.einsum("bvz,bz->bv", self._shock_rows(poly, lags, at), flat)
        return self._past[key]

    def _design(self, cand):
        """Polynomial, lags, and the regressors (B, P, Z) and targets (V, Z) as combinations of z."""
        poly = difference_polynomial(cand["d"], cand["sd"], cand["m"])
        ar = lag_set(cand["p"], cand["sp"], cand["m"])
        ma = lag_set(cand["q"], cand["sq"], cand["m"])
        lags = long_lags(cand, self.long)
        z = self.s.shape[1]
        one = np.zeros(z)
        one[0] = 1.0
        fixed = np.array([one] + [self._pick(poly, u, a) for u in range(self.v) for a in ar])
        parts = [np.broadcast_to(fixed, (self.b, *fixed.shape))]
        parts += [self._shock_rows(poly, lags, a) for a in ma]
        x = np.concatenate(parts, axis=1)
        y = np.array([self._pick(poly, u, 0) for u in range(self.v)])
        return poly, ar, ma, lags, x, y

    def residuals(self, cand):
        """(B, V, Z): what the fitted candidate leaves of each column, as a combination of z; number of parameters."""
        _, _, ma, lags, x, y = self._design(cand)
        sx = x @ self.s
        beta = least_squares(sx @ np.swapaxes(x, 1, 2), sx @ y.T)
        return y[None] - np.swapaxes(beta, 1, 2) @ x, max(x.shape[1], 1 + self.v * len(lags)) if ma else x.shape[1]

    def earlier(self, rows, by):
        """The same combinations ``by`` steps before."""
        out = np.zeros_like(rows)
        out[..., 0] = rows[..., 0]
        for u in range(self.v):
            lo, hi = 1 + u * self.width, 1 + (u + 1) * self.width
            out[..., lo + by:hi] = rows[..., lo:hi - by]
        return out

    def fit(self, cand):
        """-> const (B, V), coef (B, V, V, K), extra (B, V, steps), sse (B, V), number of parameters."""
        poly, ar, ma, lags, x, y = self._design(cand)
        sx = x @ self.s
        gram, rhs = sx @ np.swapaxes(x, 1, 2), sx @ y.T
        beta = least_squares(gram, rhs)
        yy = np.einsum("vz,bzw,vw->bv", y, self.s, y)
        sse = yy - 2 * np.einsum("bpv,bpv->bv", beta, rhs) + np.einsum("bpv,bpq,bqv->bv", beta, gram, beta)

        reach = len(poly) - 1 + max(ar, default=0)
        coef = np.zeros((self.b, self.v, self.v, max(reach, 1)))
        for u in range(self.v):
            for i in range(1, len(poly)):
                coef[:, u, u, i - 1] -= poly[i]
            for src in range(self.v):
                for pos, a in enumerate(ar):
                    w = beta[:, 1 + src * len(ar) + pos, u]
                    for i, p in enumerate(poly):
                        coef[:, u, src, a + i - 1] += w * p
        steps = max(ma, default=0)
        extra = np.zeros((self.b, self.v, steps))
        if ma:
            start = 1 + self.v * len(ar)
            for pos, a in enumerate(ma):
                theta = beta[:, start + pos * self.v:start + (pos + 1) * self.v, :]
                for h in range(1, a + 1):
                    extra[:, :, h - 1] += np.einsum("bsv,bs->bv", theta, self._shock(poly, lags, a - h))
        # both regressions must have more rows than parameters
        params = max(x.shape[1], 1 + self.v * len(lags)) if ma else x.shape[1]
        return beta[:, 0, :], coef, extra, sse, params


def _jump(move, state, times):
    """Apply an affine step (B, N+1, N+1) ``times`` times to states (B, V, K) by matrix power."""
    b = len(state)
    full = np.concatenate([state.reshape(b, -1), np.ones((b, 1))], axis=1)
    power = np.linalg.matrix_power(move, int(times))
    return np.einsum("bij,bj->bi", power, full)[:, :-1].reshape(state.shape)


def recurse(const, coef, extra, state, steps, skip=0):
    """Iterate the recursion; ``state`` (B, V, K) newest first -> forecasts (B, V, steps) after ``skip``.

    ``skip`` may differ by row. Far starts jump by a matrix power instead of walking there; then
    all rows walk together.
    """
    b, v, k = state.shape
    skip = np.broadcast_to(skip, (b,))
    first = extra.shape[2]
    if np.any(skip > 0):
        state, extra = state.copy(), extra.copy()
    for s in np.unique(skip[skip > 0]):
        rows = np.flatnonzero(skip == s)
        near = min(int(s), first)
        moved = _walk(const[rows], coef[rows], extra[rows], state[rows], near)[1]
        if s > near:
            move = np.zeros((len(rows), v * k + 1, v * k + 1))
            move[:, -1, -1] = 1.0
            for u in range(v):
                move[:, u * k, :-1] = coef[rows, u].reshape(len(rows), v * k)
                move[:, u * k, -1] = const[rows, u]
                for i in range(1, k):
                    move[:, u * k + i, u * k + i - 1] = 1.0
            moved = _jump(move, moved, s - near)
        state[rows] = moved
        extra[rows, :, :first - near] = extra[rows, :, near:]
        extra[rows, :, first - near:] = 0.0
    return _walk(const, coef, extra, state, steps)[0]


def _walk(const, coef, extra, state, steps):
    b, v, k = state.shape
    path = np.empty((b, v, k + steps))
    path[:, :, :k] = state[:, :, ::-1]
    back = coef[:, :, :, ::-1]
    for h in range(steps):
        value = const + np.einsum("busk,bsk->bu", back, path[:, :, h:h + k])
        if h < extra.shape[2]:
            value = value + extra[:, :, h]
        path[:, :, k + h] = value
    return path[:, :, k:], path[:, :, steps:][:, :, ::-1]


def remove_regressors(s_matrix, tail, regressors):
    """Regress column 1 on the last columns: S and tail of the errors, and the coefficients (B, 1 + E)."""
    b, v, width = tail.shape
    own = v - regressors
    z = s_matrix.shape[1]
    pick = np.zeros((regressors + 1, z))
    pick[0, 0] = 1.0
    for e in range(regressors):
        pick[e + 1, 1 + (own + e) * width] = 1.0
    y = np.zeros((1, z))
    y[0, 1] = 1.0
    beta = least_squares(pick @ s_matrix @ pick.T, pick @ s_matrix @ y.T)[:, :, 0]
    keep = np.zeros((b, 1 + width, z))
    keep[:, 0, 0] = 1.0
    for i in range(width):
        keep[:, 1 + i, 1 + i] = 1.0
        keep[:, 1 + i, 0] = -beta[:, 0]
        for e in range(regressors):
            keep[:, 1 + i, 1 + (own + e) * width + i] = -beta[:, 1 + e]
    s_errors = keep @ s_matrix @ np.swapaxes(keep, 1, 2)
    errors = tail[:, :1] - beta[:, 0, None, None] - np.einsum("be,bew->bw", beta[:, 1:], tail[:, own:])[:, None]
    return s_errors, errors, beta


def window_fit(s_matrix, v, width, n_in, n_out, ridge):
    """Direct map of the last n_in values of all columns to the next n_out of all columns.

    -> const (B, n_out * V), weights (B, n_out * V, V * n_in), inputs newest first per column.
    """
    z = s_matrix.shape[1]
    x = np.zeros((1 + v * n_in, z))
    x[0, 0] = 1.0
    for u in range(v):
        for i in range(n_in):
            x[1 + u * n_in + i, 1 + u * width + n_out + i] = 1.0
    y = np.zeros((n_out * v, z))
    for step in range(n_out):
        for u in range(v):
            y[step * v + u, 1 + u * width + n_out - 1 - step] = 1.0
    beta = least_squares(x @ s_matrix @ x.T, x @ s_matrix @ y.T, ridge=ridge)
    return beta[:, 0, :], np.swapaxes(beta[:, 1:, :], 1, 2), x.shape[0]


def window_forecast(const, weights, state, n_out, steps, skip=0):
    """Apply the direct map block after block; ``state`` (B, V, n_in) newest first."""
    b, v, n_in = state.shape
    skip = np.broadcast_to(skip, (b,))
    blocks, inside = np.divmod(skip, n_out)
    if np.any(blocks > 0):
        state = state.copy()
    for times in np.unique(blocks[blocks > 0]):
        rows = np.flatnonzero(blocks == times)
        size = v * n_in + 1
        move = np.zeros((len(rows), size, size))
        move[:, -1, -1] = 1.0
        for u in range(v):
            for i in range(n_in):
                if i < n_out:
                    row = (n_out - 1 - i) * v + u
                    move[:, u * n_in + i, :-1] = weights[rows, row]
                    move[:, u * n_in + i, -1] = const[rows, row]
                else:
                    move[:, u * n_in + i, u * n_in + i - n_out] = 1.0
        state[rows] = _jump(move, state[rows], times)
    parts, have = [], 0
    while have < inside.max(initial=0) + steps:
        out = (const + np.einsum("bij,bj->bi", weights, state.reshape(b, v * n_in))).reshape(b, n_out, v)
        state = np.concatenate([out[:, ::-1].swapaxes(1, 2), state], axis=2)[:, :, :n_in]
        parts.append(out.swapaxes(1, 2))
        have += n_out
    path = np.concatenate(parts, axis=2)
    return np.take_along_axis(path, (inside[:, None] + np.arange(steps))[:, None, :], axis=2)


def penalised(gram, rhs, yy, l1, l2, free, rounds=20000):
    """min 1/2 |y - Xb|^2 + sum l1 |b| + 1/2 sum l2 b^2 from the normal matrix, by coordinate descent.

    gram (B, Z, Z), rhs (B, Z), yy (B,); l1 and l2 (C, Z - free), one row per candidate
    -> (B, C, Z). The first ``free`` columns carry no penalty and are projected out, the others put
    on the correlation scale, y on unit length; so the penalties mean the same for every series.
    All rows and candidates move together, but each stops by its own steps, so a result does not depend on
    what else is in the batch; one that does not settle within ``rounds`` is NaN.
    """
    outer = gram[:, :free, :free]
    size = np.sqrt(np.maximum(np.einsum("bii->bi", outer), 0.0))
    size[size == 0.0] = 1.0
    eye = 1e-12 * np.eye(free)
    inverse = np.linalg.inv(outer / size[:, :, None] / size[:, None, :] + eye) / size[:, :, None] / size[:, None, :]
    cross = gram[:, free:, :free] @ inverse
    g = gram[:, free:, free:] - cross @ gram[:, :free, free:]
    r = rhs[:, free:] - np.einsum("bpf,bf->bp", cross, rhs[:, :free])
    length = yy - np.einsum("bf,bfg,bg->b", rhs[:, :free], inverse, rhs[:, :free])
    length = np.sqrt(np.maximum(length, 0.0))
    length[length == 0.0] = 1.0
    raw = np.einsum("bii->bi", gram)[:, free:]
    left = np.einsum("bii->bi", g)
    flat = left <= 1e-10 * np.maximum(raw, 1e-300)
    scale = np.sqrt(np.where(flat, 1.0, left))
    a = g / scale[:, :, None] / scale[:, None, :]
    a[flat] = 0.0
    y = np.where(flat, 0.0, r / scale) / length[:, None]
    own = np.einsum("bii->bi", a)
    beta = np.zeros((*y.shape[:1], *l1.shape))
    rest = np.repeat(y[:, None, :], l1.shape[0], axis=1)  # y - a beta
    active = np.ones(beta.shape[:2], bool)
    for _ in range(rounds):
        moved = np.zeros(beta.shape[:2])
        for j in range(y.shape[1]):
            part = rest[:, :, j] + own[:, j, None] * beta[:, :, j]
            new = np.sign(part) * np.maximum(np.abs(part) - l1[:, j], 0.0) / (own[:, j, None] + l2[:, j] + 1e-12)
            new[flat[:, j]] = 0.0
            step = np.where(active, new - beta[:, :, j], 0.0)
            beta[:, :, j] += step
            rest -= step[:, :, None] * a[:, None, :, j]
            moved = np.maximum(moved, np.abs(step))
        active &= ~(moved < 1e-9)
        if not active.any():
            break
    beta[active] = np.nan
    b = beta * (length[:, None] / scale)[:, None, :]
    base = rhs[:, None, :free] - np.einsum("bfp,bcp->bcf", gram[:, :free, free:], b)
    return np.concatenate([np.einsum("bfg,bcg->bcf", inverse, base), b], axis=2)
