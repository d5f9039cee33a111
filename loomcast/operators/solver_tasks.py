"""Arrow tasks that fit and score all candidates on rows of lag products.

One input row is one (series, fold, part of the test block) with a fixed number of doubles;
Spark has summed the data down to it. Batches are solved with stacked linear algebra.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from loomcast.operators import scoring as so, solvers as sv
from loomcast.operators.lag_products import HORIZON, lag_products, masked_products, recent_rows, solver_rows
from loomcast.operators.split import CHUNK
from loomcast.shipping import shipped
from loomcast.sources.series import stored

DOUBLES_PER_SLICE = 2_000_000


def _raw(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.nan_to_num(_raw(column, width), posinf=np.nan, neginf=np.nan)


def _ragged(column: pa.Array) -> np.ndarray:
    """Lists of different lengths -> (B, longest), padded with NaN."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.full((len(column), int(lengths.max(initial=0))), np.nan)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _slices(batch: pa.RecordBatch, z: int, longest: int):
    """Parts of a batch whose normal matrices and forecast paths fit in a bounded buffer."""
    step = max(1, DOUBLES_PER_SLICE // max(z * z, longest))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def lags_of(cand: dict, spec: dict) -> int:
    """Largest lag of the data that a candidate touches: its sample begins at that position."""
    return sv.needed_lags(cand, spec["long"]) if spec["kind"] == "arma" else cand["n_in"] + spec["n_out"] - 1


def by_sample(candidates: list[dict], spec: dict) -> list[int]:
    """Numbers of the candidates, those with the shortest sample first: samples then only grow."""
    return sorted(range(len(candidates)), key=lambda no: -lags_of(candidates[no], spec))


class _Samples:
    """Normal matrices over the rows that a candidate with given lags can use, whatever others need."""

    def __init__(self, common, rows, early, head):
        self.common, self.rows, self.early, self.head = common, rows, early, head
        self.at, self.s = head.shape[2] - 1, common

    def of(self, lags: int):
        if lags > self.at:
            self.at, self.s = self.head.shape[2] - 1, self.common
        b, v, width = self.head.shape
        for t in range(self.at - 1, lags - 1, -1):
            z = np.zeros((b, 1 + v * width))
            z[:, 0] = 1.0
            # lag i at position t is the value at position t - i
            z[:, 1:].reshape(b, v, width)[:, :, :t + 1] = self.head[:, :, width - 1 - t:]
            z[self.early <= t] = 0.0
            self.s = self.s + z[:, :, None] * z[:, None, :]
        self.at = lags
        return self.s, self.rows + np.maximum(self.early - lags, 0)

    def own_scale(self, v, width):
        """Mean and standard deviation (B, V) of all training values, and their number; 1 for a constant series."""
        n = self.rows + np.maximum(self.early, 0)
        at = 1 + width * np.arange(v)
        # the values before position ``lags`` are in ``head``, newest first
        before = np.where(np.arange(width - 1, -1, -1) < self.early[:, None], 1.0, 0.0)[:, None, :] * self.head
        before[:, :, 0] = 0.0
        mean = (self.common[:, 0, at] + before.sum(axis=2)) / np.maximum(n, 1)[:, None]
        square = (self.common[:, at, at] + (before * before).sum(axis=2)) / np.maximum(n, 1)[:, None]
        sd = np.sqrt(np.maximum(square - mean * mean, 0.0))
        return mean, np.where(sd > 1e-9 * (np.sqrt(square) + 1e-300), sd, 1.0), n


def _samples(col: dict, v: int, width: int, b: int):
    """Samples of a batch of lag products, its gaps, and the lags at the ends of the training sets."""
    rows = col["rows"].to_numpy(zero_copy_only=False).astype(float)
    early = col["early"].to_numpy(zero_copy_only=False)
    gaps = col["gaps"].to_numpy(zero_copy_only=False)
    head = _matrix(col["head"], v * width).reshape(b, v, width)
    tail = _matrix(col["tail"], v * width).reshape(b, v, width)
    common = sv.normal_matrix(rows, _matrix(col["s"], v), _matrix(col["c"], v * v * width).reshape(b, v, v, width), head, tail)
    common[rows == 0] = 0.0  # no row has all lags: the edges say nothing
    return _Samples(common, rows, early, head), gaps, tail


def _forecaster(part: pa.RecordBatch, cols: Sequence[str], lags: int, exog: int, spec: dict):
    """-> function(candidate, rows, steps) giving (forecasts (b, steps) of column 1, status (b,), sse (b,), rows (b,))."""
    v, width, b = len(cols), lags + 1, part.num_rows
    col = {name: part.column(i) for i, name in enumerate(part.schema.names)}
    samples, gaps, tail = _samples(col, v, width, b)
    start = unknown = None
    if "state" in col:
        start = _matrix(col["state"], v * width).reshape(b, v, width)
        unknown = np.isnan(_raw(col["state"], v * width)).reshape(b, v, width)
    mu = _matrix(col["mu"], v)
    broken = _Broken(col, cols, lags, spec) if "masked" in col else None
    future = None
    if exog:
        future = [_ragged(col[f"actual_{c}"]) - mu[:, i, None] for i, c in enumerate(cols) if i >= v - exog]
    starts = col["h"].to_numpy(zero_copy_only=False)
    if spec["kind"] == "pooled":
        return _pooled_forecaster(samples, gaps, tail if start is None else start, mu, unknown, starts,
                                  col["fold"].to_numpy(zero_copy_only=False), spec)
    ready: dict = {}

    def prepare(cand):
        """Sample of the candidate's own length; kept for the next candidate with the same."""
        need = lags_of(cand, spec)
        if ready.get("lags") != need:
            s, used = samples.of(need)
            own, beta, shift = tail, None, np.zeros((b, v))
            if exog:
                s, own, beta = sv.remove_regressors(s, own, exog)
            if spec["kind"] != "arma":  # the penalty must not see where zero is: centre on the training mean
                s, own, shift = sv.recentre(s, own if start is None else start)
            model = sv.Models(s, own if start is None else start, spec.get("long", 6)) if spec["kind"] == "arma" else None
            ready.update(lags=need, s=s, used=used, tail=own, beta=beta, model=model, shift=shift)
        return ready

    def run(cand, pick, steps):
        now = prepare(cand)
        from_tail = now["tail"] if start is None or spec["kind"] != "arma" else start
        if spec["kind"] == "arma":
            const, coef, extra, sse, params = now["model"].fit(cand)
            reach = coef.shape[3]
            out = sv.recurse(const[pick], coef[pick], extra[pick], from_tail[pick][:, :, :reach], steps, starts[pick])
            sse = sse[pick, 0]
        else:
            n_in, n_out = cand["n_in"], spec["n_out"]
            reach = n_in
            const, weights, params = sv.window_fit(now["s"], now["s"].shape[1] // width, width, n_in, n_out, cand["ridge"])
            out = sv.window_forecast(const[pick], weights[pick], from_tail[pick][:, :, :n_in], n_out, steps, starts[pick])
            sse = np.full(len(pick), np.nan)
        yhat = out[:, 0] + mu[pick, :1] + now["shift"][pick, :1]
        if exog:
            beta = now["beta"]
            yhat = yhat + beta[pick, :1] + sum(beta[pick, 1 + e, None] * f[pick][:, :steps] for e, f in enumerate(future))
        missing = gaps[pick] > 0
        if unknown is not None:
            missing = missing | unknown[pick][:, :, :reach].any(axis=(1, 2))
        used = now["used"][pick]
        status = np.where(missing, sv.GAPS, np.where(used <= params, sv.SHORT, sv.OK))
        if broken is not None and missing.any():
            at = np.flatnonzero(missing)
            paths, rows, errors = broken.run(cand, pick[at], steps, starts)
            yhat[at], used = paths + mu[pick[at], :1], used.copy()
            used[at], sse[at] = rows, errors
            status[at] = np.where(rows == 0, sv.GAPS, np.where(rows <= params, sv.SHORT, sv.OK))
        return yhat, status, sse, used

    return run


class _Broken:
    """Training sets with missing values: normal matrices over complete rows, and a filled end to forecast from."""

    def __init__(self, col: dict, cols: Sequence[str], lags: int, spec: dict):
        self.v, self.width, self.spec = len(cols), lags + 1, spec
        self.b, self.z = len(col["masked"]), len(cols) * (lags + 1) + 1
        self.masked = [{m["lags"]: m["packed"] for m in x.as_py() or ()} for x in col["masked"]]
        last = [col[f"recent_{c}"].fill_null([]) for c in cols]
        length = max(recent_rows(lags), *(int(pc.max(x.value_lengths()).as_py() or 0) for x in last))
        self.recent = np.full((self.b, self.v, length), np.nan)
        for u, lists in enumerate(last):
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(size):
                self.recent[i, u, length - size[i]:] = lists[int(i)].values.to_numpy(zero_copy_only=False)

    def filled(self, const, coef, rows):
        """The last values, each missing one as the model's own step from those before; the level stands before them all."""
        out, back = self.recent[rows].copy(), coef[:, :, :, ::-1]
        reach = coef.shape[3]
        out = np.concatenate([np.zeros((len(rows), self.v, reach)), out], axis=2)
        begun = np.zeros((len(rows), self.v), bool)
        for t in range(reach, out.shape[2]):
            gone = np.isnan(out[:, :, t])
            step = const + np.einsum("busk,bsk->bu", back, out[:, :, t - reach:t])
            begun |= ~gone
            out[:, :, t] = np.where(gone, np.where(begun, step, 0.0), out[:, :, t])
        return out[:, :, ::-1][:, :, :self.width]

    def run(self, cand, rows, steps, starts):
        need = lags_of(cand, self.spec)
        s = np.array([self.masked[i].get(need, np.zeros(self.z * self.z)) for i in rows]).reshape(len(rows), self.z, self.z)
        const, coef, _, _, _ = sv.Models(s, np.zeros((len(rows), self.v, self.width)), self.spec.get("long", 6)).fit(cand)
        end = self.filled(const, coef, rows)
        const, coef, extra, sse, _ = sv.Models(s, end, self.spec.get("long", 6)).fit(cand)
        out = sv.recurse(const, coef, extra, end[:, :, :coef.shape[3]], steps, starts[rows])
        return out[:, 0], s[:, 0, 0], sse[:, 0]


def _pooled_forecaster(samples, gaps, state, mu, unknown, starts, fold, spec):
    """Like ``_forecaster`` for a model that all series share: ``spec['pooled']`` has its sums by lags and fold."""
    b, v, width = state.shape
    mean, sd, known = samples.own_scale(v, width)
    scaled = (state - mean[:, :, None]) / sd[:, :, None]
    n_out = spec["n_out"]

    def run(cand, pick, steps):
        n_in, fitted = cand["n_in"], {}
        yhat, params, used = np.full((len(pick), steps), np.nan), 1 + v * cand["n_in"], np.zeros(len(pick))
        for f in np.unique(fold[pick]):
            of = np.flatnonzero(fold[pick] == f)
            pooled, rows = spec["pooled"].get((lags_of(cand, spec), int(f)), (None, 0.0))
            used[of] = rows
            if rows > params:
                if f not in fitted:
                    fitted[f] = sv.window_fit(pooled[None], v, width, n_in, n_out, cand["ridge"])[:2]
                const, weights = (np.broadcast_to(x, (len(of), *x.shape[1:])) for x in fitted[f])
                at = pick[of]
                out = sv.window_forecast(const, weights, scaled[at][:, :, :n_in], n_out, steps, starts[at])
                yhat[of] = out[:, 0] * sd[at, :1] + mean[at, :1] + mu[at, :1]
        missing = gaps[pick] > 0
        if unknown is not None:
            missing = missing | unknown[pick][:, :, :n_in].any(axis=(1, 2))
        status = np.where(missing, sv.GAPS, np.where((used <= params) | (known[pick] < n_in), sv.SHORT, sv.OK))
        return yhat, status, np.full(len(pick), np.nan), used

    return run


def pool_task(cols, lags, spec, candidates):
    """Sums of the standardised normal matrices of a task's training sets: (lags, fold, pos, value), pos 0 the rows."""
    v, width = len(cols), lags + 1
    needs = sorted({lags_of(c, spec) for c in candidates}, reverse=True)

    def run(batches):
        total: dict = {}
        for batch in batches:
            for part in _slices(batch, _width(cols, lags), 0):
                col = {name: part.column(i) for i, name in enumerate(part.schema.names)}
                samples, gaps, _ = _samples(col, v, width, part.num_rows)
                fold = col["fold"].to_numpy(zero_copy_only=False)
                mean, sd, _ = samples.own_scale(v, width)
                for need in needs:
                    s, used = samples.of(need)
                    for f in np.unique(fold):
                        take = np.flatnonzero((fold == f) & (gaps == 0) & (used > 0))
                        if len(take):
                            own = _standardised(s[take], mean[take], sd[take], width)
                            flat = np.concatenate([[used[take].sum()], own.ravel()])
                            total[need, int(f)] = total.get((need, int(f)), 0.0) + flat
        for (need, f), flat in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), need), pa.int32()), pa.array(np.full(len(flat), f), pa.int32()),
                 pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["lags", "fold", "pos", "value"])

    return run


def _standardised(s, mean, sd, width):
    """Sum over a batch of normal matrices as those of (value - mean) / sd: weights per matrix, no matrix per matrix."""
    v, z = mean.shape[1], s.shape[1]
    a, m = 1.0 / sd, mean / sd
    out = np.zeros((z, z))
    out[0, 0] = s[:, 0, 0].sum()
    first = [s[:, 0, 1 + u * width:1 + (u + 1) * width] for u in range(v)]
    for u in range(v):
        at = slice(1 + u * width, 1 + (u + 1) * width)
        out[0, at] = out[at, 0] = a[:, u] @ first[u] - m[:, u] @ s[:, 0, 0]
        for w in range(v):
            to = slice(1 + w * width, 1 + (w + 1) * width)
            out[at, to] = np.tensordot(a[:, u] * a[:, w], s[:, at, to], axes=(0, 0)) \
                - ((a[:, u] * m[:, w]) @ first[u])[:, None] - (m[:, u] * a[:, w]) @ first[w] + (m[:, u] * m[:, w]) @ s[:, 0, 0]
    return out


def _width(cols, lags):
    return len(cols) * (lags + 1) + 1


def score_task(keys, cols, lags, exog, spec, candidates):
    """Sum of absolute errors of every candidate, its status and its row's share of the seconds, in candidate order.

    Work that candidates share (their common sample) counts for the first of them.
    """
    order = by_sample(candidates, spec)

    def run(batches):
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index(f"actual_{cols[0]}")).value_lengths()
            for part in _slices(batch, _width(cols, lags), pc.max(lengths).as_py() or 0):
                predict = _forecaster(part, cols, lags, exog, spec)
                target = _ragged(part.column(part.schema.get_field_index(f"actual_{cols[0]}")))
                known = ~np.isnan(target)
                err = np.full((part.num_rows, len(candidates)), np.nan)
                state = np.zeros((part.num_rows, len(candidates)), dtype=np.int32)
                spent = np.zeros(len(candidates))
                everything = np.arange(part.num_rows)
                for no in order:
                    begin = time.perf_counter()
                    with np.errstate(all="ignore"):
                        yhat, status, _, _ = predict(candidates[no], everything, target.shape[1])
                        gap = np.where(known, np.abs(target - yhat), 0.0).sum(axis=1)
                    status = np.where((status == sv.OK) & ~np.isfinite(gap), sv.UNSTABLE, status)
                    err[:, no] = np.where(status == sv.OK, gap, np.nan)
                    state[:, no] = status
                    spent[no] = (time.perf_counter() - begin) / part.num_rows
                keep = [part.column(part.schema.get_field_index(c)) for c in [*keys, "fold"]]
                offsets = pa.array(np.arange(part.num_rows + 1) * len(candidates), pa.int32())
                flat = err.ravel()
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array(known.sum(axis=1), pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64(), mask=np.isnan(flat))),
                     pa.ListArray.from_arrays(offsets, pa.array(state.ravel(), pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(np.tile(spent, part.num_rows), pa.float64()))],
                    names=[*keys, "fold", "steps", "abs_err", "status", "seconds"])

    return run


def residual_task(keys, cols, lags, spec, candidates, reach):
    """Rows, parameters, squared errors and portmanteau statistic over ``reach`` lags of every candidate's residuals.

    A residual is a combination of a row's lags, so its products with earlier residuals are quadratic forms of the lag
    products, over the rows that have both.
    """
    v, width = len(cols), lags + 1

    def run(batches):
        for batch in batches:
            for part in _slices(batch, _width(cols, lags), 0):
                col = {name: part.column(i) for i, name in enumerate(part.schema.names)}
                samples, gaps, tail = _samples(col, v, width, part.num_rows)
                out = np.full((4, part.num_rows, len(candidates)), np.nan)
                state = np.zeros((part.num_rows, len(candidates)), np.int32)
                for no in by_sample(candidates, spec):
                    need = lags_of(candidates[no], spec)
                    with np.errstate(all="ignore"):
                        s, used = samples.of(need)
                        model = sv.Models(s, tail, spec["long"])
                        e, params = model.residuals(candidates[no])
                        e = e[:, 0]
                        sse, q = np.einsum("bz,bzw,bw->b", e, s, e), np.zeros(part.num_rows)
                        for h in range(reach, 0, -1):
                            later, _ = samples.of(need + h)
                            both = np.einsum("bz,bzw,bw->b", e, later, model.earlier(e, h))
                            q += (both / sse) ** 2 / (used - h)
                    status = np.where(gaps > 0, sv.GAPS, np.where(used <= params, sv.SHORT, sv.OK))
                    out[:, :, no] = used, np.full(part.num_rows, params), sse, used * (used + 2) * q
                    out[:, status != sv.OK, no] = np.nan
                    state[:, no] = status
                offsets = pa.array(np.arange(part.num_rows + 1) * len(candidates), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.float64(), mask=np.isnan(x.ravel()))) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [*[col[c] for c in keys], *lists, pa.ListArray.from_arrays(offsets, pa.array(state.ravel(), pa.int32()))],
                    names=[*keys, "rows", "params", "sse", "q", "status"])

    return run


def forecast_task(keys, cols, lags, exog, spec, candidates):
    """``steps`` forecasts of the candidate chosen in column ``candidate``, from step ``h`` on.

    A column ``state`` (lags 0.. of another series) replaces the end of the training set.
    """

    def run(batches):
        for batch in batches:
            longest = pc.max(batch.column(batch.schema.get_field_index("steps"))).as_py() or 0
            for part in _slices(batch, _width(cols, lags), longest):
                predict = _forecaster(part, cols, lags, exog, spec)
                lengths = part.column(part.schema.get_field_index("steps")).to_numpy(zero_copy_only=False)
                chosen = part.column(part.schema.get_field_index("candidate")).to_numpy(zero_copy_only=False)
                out = np.full((part.num_rows, int(lengths.max(initial=0))), np.nan)
                for no in np.unique(chosen):
                    pick = np.flatnonzero(chosen == no)
                    with np.errstate(all="ignore"):
                        yhat, status, _, _ = predict(candidates[no], pick, out.shape[1])
                    out[pick] = np.where((status == sv.OK)[:, None] & np.isfinite(yhat), yhat, np.nan)
                inside = np.arange(out.shape[1]) < lengths[:, None]
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                flat = out[inside]
                keep = [part.column(part.schema.get_field_index(c)) for c in [*keys, "fold", "h", "candidate"]]
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64(), mask=np.isnan(flat)))],
                    names=[*keys, "fold", "h", "candidate", "yhat"])

    return run


def _key_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Solver rows are few bytes and much work: a stated number of partitions, not one by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def with_candidate_parameters(df: DataFrame, candidates: list[dict]) -> DataFrame:
    """Put the parameters of each candidate next to its number, from one literal."""
    fields = ", ".join(f"{k}: {'int' if isinstance(v, int) else 'double'}" for k, v in candidates[0].items())
    table = F.from_json(F.lit(json.dumps(candidates)), f"array<struct<{fields}>>")
    return df.withColumn("_p", F.get(table, F.col("candidate"))).select(
        *df.columns, *[F.col(f"_p.{k}").alias(k) for k in candidates[0]])


class GridSearch:
    """A set of candidates on a panel: scores of all of them, the best, and its forecasts.

    spec: ``{'kind': 'arma', 'long': 6}`` with candidates p,d,q,sp,sd,sq,m or
    ``{'kind': 'window', 'n_out': 4}`` with candidates n_in, ridge. ``exog`` counts the last
    columns of ``cols`` that are regressors with known future values. With ``missing``, training sets that miss
    values are fitted on the rows of which a candidate's lags are known, and the missing values before the forecast
    are the model's own steps; status ``gaps`` is left to those without such a row. Without it (the cheaper way, for
    panels without gaps) one missing value gives status ``gaps``.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], cols: Sequence[str], candidates: list[dict], spec: dict,
                 k: int, min_train: int = 0, *, exog: int = 0, missing: bool = False, size: int = CHUNK, horizon: int = HORIZON):
        if missing and (exog or spec["kind"] != "arma"):
            raise ValueError("missing values are fitted by models of the kind 'arma' without regressors")
        self.keys, self.cols, self.candidates, self.spec, self.exog = list(keys), list(cols), candidates, spec, exog
        self.missing = missing
        self.lags = max(1, max(lags_of(c, spec) for c in candidates))
        if spec["kind"] != "arma":
            horizon = max(horizon - horizon % spec["n_out"], spec["n_out"])
        self.df, self.k, self.min_train, self.size, self.horizon = df, k, min_train, size, horizon
        self.rows = solver_rows(df, keys, cols, self.lags, k, min_train, size=size, horizon=horizon)
        if missing:
            self.rows = self._with_masked(self.rows)
        self._ddl = _key_ddl(df, keys)

    def _with_masked(self, rows: DataFrame, whole: bool = False) -> DataFrame:
        needs = {lags_of(c, self.spec) for c in self.candidates}
        sums = masked_products(self.df, self.keys, self.cols, sorted(needs), self.lags, self.k, 0 if whole else self.min_train,
                               size=self.size, whole=whole)
        return rows.join(sums, [*self.keys, "fold"], "left")

    def _args(self):
        return self.keys, self.cols, self.lags, self.exog, self.spec, self.candidates

    def fold_scores(self, timed: bool = False) -> DataFrame:
        """(keys, candidate, fold, mae, status) - a failed candidate has NULL and a reason; ``timed`` adds its seconds."""
        args = self._args()  # a pooled search writes its rows here
        raw = _spread(self.rows, *self.keys, "fold", "h").transform(shipped).mapInArrow(
            score_task(*args),
            f"{self._ddl}, fold int, steps bigint, abs_err array<double>, status array<int>, seconds array<double>")
        flat = raw.select(*self.keys, "fold", "steps", F.posexplode(F.arrays_zip("abs_err", "status", "seconds")).alias("candidate", "z"))
        names = F.array(*[F.lit(x) for x in sv.STATUS])
        out = flat.groupBy(*self.keys, "candidate", "fold").agg(
            F.sum("z.abs_err").alias("_e"), F.count("z.abs_err").alias("_c"), F.count(F.lit(1)).alias("_m"),
            F.sum("steps").alias("_n"), F.max("z.status").alias("_s"), F.sum("z.seconds").alias("seconds"))
        scored = out.select(
            *self.keys, "candidate", "fold",
            F.when((F.col("_c") == F.col("_m")) & (F.col("_n") > 0), F.col("_e") / F.col("_n")).alias("mae"),
            F.get(names, F.col("_s")).alias("status"), *(["seconds"] if timed else []))
        # a series without a fold that has more than ``min_train`` rows has one row per candidate
        few = so.without_folds(self.df, self.keys, self.k, self.min_train).select(
            *self.keys, F.explode(F.sequence(F.lit(0), F.lit(len(self.candidates) - 1))).alias("candidate"))
        return scored.unionByName(few.select(
            *self.keys, "candidate", F.lit(None).cast("int").alias("fold"), F.lit(None).cast("double").alias("mae"),
            F.lit("short").alias("status"), *([F.lit(0.0).alias("seconds")] if timed else [])))

    def scores(self, timed: bool = False) -> DataFrame:
        """(keys, candidate, mean_mae, last_mae, folds, failed) over the folds."""
        return self.fold_scores(timed).groupBy(*self.keys, "candidate").agg(
            *([F.sum("seconds").alias("seconds")] if timed else []),
            F.when(F.count("mae") == F.count(F.lit(1)), F.avg("mae")).alias("mean_mae"),
            F.max_by("mae", "fold").alias("last_mae"),
            F.count("fold").alias("folds"),
            F.count_if(F.col("mae").isNull()).alias("failed"))

    def information(self, reach: int = 24) -> DataFrame:
        """(keys, candidate, rows, params, sse, aicc, q, status) of every candidate fitted on the whole series.

        ``q`` is the portmanteau statistic of the residuals over ``reach`` lags. Nothing is scanned again per candidate.
        For orders without regressors and missing values.
        """
        if self.spec["kind"] != "arma" or self.exog:
            raise ValueError("information is for the kind 'arma' without regressors")
        lags = self.lags + reach
        whole = lag_products(self.df, self.keys, self.cols, lags, self.k, size=self.size, whole=True)
        raw = _spread(whole, *self.keys).transform(shipped).mapInArrow(
            residual_task(self.keys, self.cols, lags, self.spec, self.candidates, reach),
            f"{self._ddl}, rows array<double>, params array<double>, sse array<double>, q array<double>, status array<int>")
        fields = ("rows", "params", "sse", "q", "status")
        flat = raw.select(*self.keys, F.posexplode(F.arrays_zip(*fields)).alias("candidate", "z")).select(
            *self.keys, "candidate", *[F.col(f"z.{c}").alias(c) for c in fields])
        n, p = F.col("rows"), F.col("params") + 1  # with the variance
        aicc = n * F.log(F.col("sse") / n) + 2 * p + 2 * p * (p + 1) / F.nullif(n - p - 1, F.lit(0.0))
        return flat.select(*self.keys, "candidate", n.cast("bigint").alias("rows"), F.col("params").cast("int").alias("params"), "sse",
                           aicc.alias("aicc"), "q", F.get(F.array(*[F.lit(x) for x in sv.STATUS]), F.col("status")).alias("status"))

    def with_parameters(self, df: DataFrame) -> DataFrame:
        """Put the parameters of each candidate next to its number."""
        return with_candidate_parameters(df, self.candidates)

    def _paths(self, rows: DataFrame) -> DataFrame:
        raw = _spread(rows, *self.keys, "fold", "h").transform(shipped).mapInArrow(
            forecast_task(*self._args()), f"{self._ddl}, fold int, h bigint, candidate int, yhat array<double>")
        return raw.select(*self.keys, "fold", F.col("h").alias("_h0"), "candidate", F.posexplode("yhat").alias("_p", "yhat")).select(
            *self.keys, "fold", (F.col("_h0") + F.col("_p")).alias("h"), "candidate", "yhat")

    def forecasts(self, chosen: DataFrame) -> DataFrame:
        """(keys, fold, h, candidate, yhat) over the test blocks for the candidate chosen per series."""
        pick = chosen.filter("candidate is not null").select(*self.keys, F.col("candidate").cast("int").alias("candidate"))
        self._args()
        rows = self.rows.withColumn("steps", F.size(f"actual_{self.cols[0]}")).join(pick, self.keys)
        return self._paths(rows)

    def _whole(self) -> DataFrame:
        out = lag_products(self.df, self.keys, self.cols, self.lags, self.k, size=self.size, whole=True).drop(
            "train_size", "test_size")
        return self._with_masked(out, whole=True) if self.missing else out

    def _parts(self, rows: DataFrame, steps: Column) -> DataFrame:
        """One row per part of the horizon: ``h`` the first step, ``steps`` how many."""
        parts = rows.withColumn("_n", steps).filter("_n > 0").withColumn("h", F.explode(F.expr(
            f"sequence(0L, cast(_n as bigint) - 1, {self.horizon}L)")))
        return parts.withColumn("steps", F.least(F.col("_n") - F.col("h"), F.lit(self.horizon)).cast("int")).drop("_n")

    def future(self, chosen: DataFrame, steps: int, known: DataFrame | None = None) -> DataFrame:
        """Fit the chosen candidate on the whole series and forecast beyond its end.

        With regressors, ``known`` holds their values there: (keys, h = 0, 1, ..., regressor columns). A step
        without them, and a series without any, has a NULL forecast.
        """
        pick = chosen.filter("candidate is not null").select(*self.keys, F.col("candidate").cast("int").alias("candidate"))
        rows = self._parts(self._whole().join(pick, self.keys), F.lit(steps))
        if not self.exog:
            return self._paths(rows)
        if known is None:
            raise ValueError("the regressors' values beyond the end are needed")
        names = self.cols[len(self.cols) - self.exog:]
        # one array per part of the horizon, with a place for every step
        first = (F.floor(F.col("h") / self.horizon) * self.horizon).cast("bigint")
        cells = known.filter((F.col("h") >= 0) & (F.col("h") < steps)).groupBy(*self.keys, first.alias("h")).agg(*[
            F.map_from_entries(F.collect_list(F.struct((F.col("h") - first).cast("int"), F.col(c).cast("double")))).alias(f"_m_{c}")
            for c in names])
        rows = rows.join(cells, [*self.keys, "h"], "left")

        def values(c: str) -> Column:
            known_at = lambda i: F.coalesce(F.try_element_at(F.col(f"_m_{c}"), i), F.lit(float("nan")))
            return F.transform(F.sequence(F.lit(0), F.col("steps") - 1), known_at).alias(f"actual_{c}")

        return self._paths(rows.select("*", *map(values, names)).drop(*[f"_m_{c}" for c in names]))

    def transfer(self, source: Column, targets: DataFrame, candidate: int, steps: Column) -> DataFrame:
        """The model of one series, applied to others from the end of their own values.

        ``source`` selects the training series, ``targets`` holds (keys, idx, n, cols) of the known
        part of the others, ``steps`` (a column of keys and n) says how far to go.
        """
        fit = self._whole().filter(source).select(F.struct("gaps", "rows", "early", "mu", "s", "c", "head", "tail").alias("f"))
        end = targets.filter(F.col("idx") >= F.col("n") - 1 - self.lags)
        newest = F.sort_array(F.collect_list(F.struct((-F.col("idx")).alias("o"), *self.cols)))
        state = end.groupBy(*self.keys, "n").agg(newest.alias("_e"))
        rows = state.select("*", fit.scalar().alias("f")).select(
            *self.keys, "n", F.lit(self.k).alias("fold"), F.lit(candidate).alias("candidate"), "f.*", "_e")
        # values that a target lacks stay NULL: only a candidate that needs them has no forecast
        shifted = F.concat(*[
            F.zip_with(F.col(f"_e.{c}"), F.array_repeat(F.get("mu", F.lit(i)), self.lags + 1), lambda y, m: y - m)
            for i, c in enumerate(self.cols)])
        return self._paths(self._parts(rows.withColumn("state", shifted).drop("_e"), steps).drop("n"))


class PooledSearch(GridSearch):
    """Window models that all series of a panel share: one normal matrix per fold.

    Every series is standardised by the mean and deviation of its own training rows, so large series do not drown
    small ones and no test value is used. The matrices are added up in the tasks and then by Spark; the driver gets
    one per fold and window length, whatever the number of series. A series too short to be fitted alone is forecast
    as soon as it has the inputs of one window. Folds are counted per series: give the panel common bounds if
    no series may train on periods that another is tested on. A series with missing values has status ``gaps``
    and no part in the sums.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], cols: Sequence[str], candidates: list[dict], n_out: int,
                 k: int, min_train: int = 0, *, size: int = CHUNK, horizon: int = HORIZON):
        spec = {"kind": "pooled", "n_out": n_out}
        super().__init__(df, keys, cols, candidates, spec, k, min_train, size=size, horizon=horizon)
        self.kept = False  # whether ``rows`` are written: the sums and the scores read the same

    def pooled(self, whole: bool = False) -> dict:
        """{(lags, fold): (normal matrix, rows)}: all training sets of a fold, or of all values as fold k."""
        if whole:
            sums = lag_products(self.df, self.keys, self.cols, self.lags, self.k, size=self.size, whole=True)
        else:  # a training set is there once per part of its test block
            if not self.kept:
                self.rows, self.kept = stored(self.rows), True
            sums = self.rows.filter("h = 0")
        parts = _spread(sums, *self.keys, "fold").transform(shipped).mapInArrow(
            pool_task(self.cols, self.lags, self.spec, self.candidates), "lags int, fold int, pos int, value double")
        z = _width(self.cols, self.lags)
        flat: dict = {}
        # folds x window lengths x z^2 numbers
        for row in parts.groupBy("lags", "fold", "pos").agg(F.sum("value").alias("value")).collect():
            flat.setdefault((row["lags"], row["fold"]), np.zeros(1 + z * z))[row["pos"]] = row["value"]
        return {at: (x[1:].reshape(z, z), float(x[0])) for at, x in flat.items()}

    def _args(self):
        if "pooled" not in self.spec:
            self.spec = {**self.spec, "pooled": self.pooled()}
        return super()._args()

    def future(self, chosen: DataFrame, steps: int, known: DataFrame | None = None) -> DataFrame:
        """Forecasts beyond the end of every series by the model fitted on all values of all series."""
        own = self.spec
        try:
            self.spec = {**own, "pooled": self.pooled(whole=True)}
            return super().future(chosen, steps, known)
        finally:
            self.spec = own


def arma_grid(p, d, q, sp=(0,), sd=(0,), sq=(0,), m: int = 1) -> list[dict]:
    """Candidates in the order of nested loops; sp, sd, sq are the seasonal orders."""
    return [dict(p=a, d=b, q=c, sp=e, sd=f, sq=g, m=m)
            for a in p for b in d for c in q for e in sp for f in sd for g in sq]
