"""Sums of lag products per fold: all that a linear time-series model needs to know of its data.

For rows t = L..e the normal matrix over the lags 0..L has Toeplitz structure up to its edges:
``S[i+1, j+1] = S[i, j] + y[L-1-i] y[L-1-j] - y[e-i] y[e-j]``. So L+1 sums ``sum y_t y_(t-k)``
and the first and last L+1 values of a training set replace the L^2/2 sums of a full normal
matrix. The sums are native aggregates with map-side combine; the folds come from prefix sums
over blocks; the solvers see one small row per (series, fold), whatever the series length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomcast.operators.folds import attach_fold_values, test_rows, train_prefix_packed, with_blocks
from loomcast.operators.split import CHUNK, windowed, with_series_totals
from loomcast.shipping import shipped

HORIZON = 4096  # test values per solver row; longer test blocks are split


def centred(df: DataFrame, keys: Sequence[str], cols: Sequence[str], *, size: int = CHUNK) -> DataFrame:
    """Add ``mu_<col>``, the mean over block 0: products of values near 0 keep their digits.

    Block 0 is in every training set, so no test value has a part in it.
    """
    first = F.col("block") == 0
    totals = {f"_s_{c}": (F.sum(F.when(first, F.col(c))), "sum") for c in cols}
    totals |= {f"_m_{c}": (F.count(F.when(first, F.col(c))), "sum") for c in cols}
    out = with_series_totals(df, keys, totals, size=size)
    means = [F.coalesce(F.col(f"_s_{c}") / F.nullif(F.col(f"_m_{c}"), F.lit(0)), F.lit(0.0)).alias(f"mu_{c}") for c in cols]
    return out.select(*df.columns, *means)


def lag_products(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], lags: int, k: int, min_train: int = 0,
    *, size: int = CHUNK, whole: bool = False,
) -> DataFrame:
    """(keys, fold, train_size, test_size, gaps, rows, early, mu, s, c, head, tail) per training set.

    ``c`` holds, for each ordered pair of columns (u, v), sum u_t v_(t-k) for k = 0..lags over the
    ``rows`` rows that have all lags; ``head``/``tail`` the lags 0..lags of each column at the first
    and last of them. ``head`` is also the first values of the series backwards, and ``early`` the
    number of rows before position ``lags``: a candidate of fewer lags adds those that it can use.
    ``whole``: one training set per series, all of it, as fold k.
    """
    centre = with_blocks(df.select(*keys, "idx", "n", *cols), k).filter(F.col("block") <= k)
    centre = centred(centre, keys, cols, size=size)
    for c in cols:
        centre = centre.withColumn(c, F.col(c) - F.col(f"mu_{c}"))

    def make(w):
        return {f"_{c}_{i}": F.lag(c, i).over(w) for c in cols for i in range(1, lags + 1)}

    rows = windowed(centre, keys, make, before=lags, size=size)

    # SQL texts: hundreds of small expressions, each a single call instead of a tree of calls
    def lag(c: str, i: int) -> str:
        return f"`{c}`" if i == 0 else f"`_{c}_{i}`"

    span = range(lags + 1)
    cross = [(u, v, i) for u in cols for v in cols for i in span]
    each = [(c, i) for c in cols for i in span]
    usable = f"idx >= {lags}"
    at_end = "idx = first + block * test_size - 1"
    # a row before position ``lags`` has no full set of lags
    sums = (
        [" + ".join(f"CAST(`{c}` IS NULL AS DOUBLE)" for c in cols), f"CAST({usable} AS DOUBLE)"]
        + [f"CASE WHEN {usable} THEN `{c}` END" for c in cols]
        + [f"CASE WHEN {usable} THEN `{u}` * {lag(v, i)} END" for u, v, i in cross]
        + [f"CASE WHEN idx = {lags - i} THEN `{c}` END" for c, i in each]
        + [f"CAST(idx < {lags} AS DOUBLE)"]
    )
    mus = [f"mu_{c}" for c in cols]
    out = train_prefix_packed(
        rows, keys, k, sums, per_block=[f"CASE WHEN {at_end} THEN {lag(c, i)} END" for c, i in each],
        extra_keys=mus, min_train=min_train, whole=whole)
    at_s, at_c = 3, 3 + len(cols)
    return out.select(
        *keys, "fold", "train_size", "test_size",
        F.get("packed", F.lit(0)).cast("bigint").alias("gaps"), F.get("packed", F.lit(1)).cast("bigint").alias("rows"),
        F.get("packed", F.lit(len(sums) - 1)).cast("bigint").alias("early"),
        F.array(*mus).alias("mu"),
        F.slice("packed", at_s, len(cols)).alias("s"),
        F.slice("packed", at_c, len(cross)).alias("c"),
        F.slice("packed", at_c + len(cross), len(each)).alias("head"),
        F.col("ends").alias("tail"))


def with_gaps(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows of the series that miss a value of any of the columns."""
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in cols], F.lit(0))
    return df.join(df.groupBy(*keys).agg(F.max(missing).alias("_m")).filter("_m > 0").select(*keys), list(keys), "left_semi")


def masked_products(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], needs: Sequence[int], lags: int, k: int, min_train: int = 0,
    *, size: int = CHUNK, whole: bool = False,
) -> DataFrame:
    """(keys, fold, masked, recent) of the training sets of series with missing values.

    A missing value breaks the Toeplitz structure, so the normal matrices of these series are summed as they are:
    ``masked`` has, for each number of lags in ``needs``, the matrix over the rows of which the value and that many lags
    are known in every column. A task sums a chunk of a series, with the rows before it; chunks and blocks are added up
    by Spark. ``recent`` are the last values of a training set, oldest first, missing ones as NULL.
    """
    centre = with_blocks(with_gaps(df.select(*keys, "idx", "n", *cols), keys, cols), k).filter(F.col("block") <= k)
    centre = centred(centre, keys, cols, size=size)
    for c in cols:
        centre = centre.withColumn(c, F.col(c) - F.col(f"mu_{c}"))
    top = k if whole else k - 1
    at = [F.floor(F.col("idx") / size), F.floor((F.col("idx") + lags) / size)]
    chunk = centre.filter(F.col("block") <= top).withColumn("_chunk", F.explode(F.sequence(*at)))
    row = F.struct("idx", "block", *[F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) for c in cols])
    chunks = chunk.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(row)).alias("_r")).select(
        *keys, (F.col("_chunk") * size).alias("start"), F.col("_r.idx").alias("idx"), F.col("_r.block").alias("block"),
        *[F.col(f"_r.{c}").alias(f"v_{i}") for i, c in enumerate(cols)])
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    sums = chunks.transform(shipped).mapInArrow(
        masked_task(list(keys), len(cols), sorted(needs), lags), f"{ddl}, lags int, block int, packed array<double>")
    z = len(cols) * (lags + 1) + 1
    add = lambda parts: f"aggregate({parts}, array_repeat(0D, {z * z}), (a, b) -> zip_with(a, b, (x, y) -> x + y))"
    blocks = sums.groupBy(*keys, "lags", "block").agg(F.expr(add("collect_list(packed)")).alias("packed"))
    # every fold up to the last, also where a block has no complete row
    each = blocks.select(*keys, "lags", "packed", F.explode(F.sequence(F.col("block"), F.lit(top))).alias("fold"))
    per_fold = each.groupBy(*keys, "fold", "lags").agg(F.expr(add("collect_list(packed)")).alias("packed")) \
        .groupBy(*keys, "fold").agg(F.collect_list(F.struct("lags", "packed")).alias("masked"))
    # the last values before the end of each training set
    keep = recent_rows(lags)
    lo = F.greatest(F.ceil((F.col("idx") + 1 - F.col("first")) / F.col("test_size")), F.lit(0))
    hi = F.least(F.floor((F.col("idx") + keep - F.col("first")) / F.col("test_size")), F.lit(top))
    last = centre.filter(lo <= hi).withColumn("fold", F.explode(F.sequence(lo.cast("int"), hi.cast("int")))) \
        .groupBy(*keys, "fold").agg(F.sort_array(F.collect_list(F.struct("idx", *cols))).alias("_r"), F.max("first").alias("first"),
                                    F.max("test_size").alias("test_size")) \
        .filter(F.col("first") + F.col("fold") * F.col("test_size") > min_train) \
        .select(*keys, "fold", *[F.col(f"_r.{c}").alias(f"recent_{c}") for c in cols])
    return last.join(per_fold, [*keys, "fold"], "left").filter(F.col("fold") == k if whole else F.col("fold") < k)


def recent_rows(lags: int) -> int:
    """How far back a forecast from a training set with gaps looks for known values."""
    return 4 * (lags + 1) + 32


def masked_task(keys: list[str], v: int, needs: list[int], lags: int):
    """Normal matrices of chunks of a series: (keys, lags, block, packed)."""
    width = lags + 1
    z = v * width + 1

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                col = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                idx, block = (col[n].values.to_numpy(zero_copy_only=False) for n in ("idx", "block"))
                values = np.array([col[f"v_{u}"].values.to_numpy(zero_copy_only=False) for u in range(v)])
                padded = np.concatenate([np.full((v, lags), np.nan), values], axis=1)
                windows = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)[:, :, ::-1]  # (v, rows, lag)
                own = idx >= col["start"].as_py()
                out = []
                for need in needs:
                    known = own & (idx >= need) & ~np.isnan(windows[:, :, :need + 1]).any(axis=(0, 2))
                    for b in np.unique(block[known]):
                        at = np.flatnonzero(known & (block == b))
                        s = np.zeros((z, z))
                        for lo in range(0, len(at), 8192):
                            rows = np.zeros((len(at[lo:lo + 8192]), v, width))
                            rows[:, :, :need + 1] = windows[:, at[lo:lo + 8192], :need + 1].swapaxes(0, 1)
                            x = np.concatenate([np.ones((len(rows), 1)), rows.reshape(len(rows), -1)], axis=1)
                            s += x.T @ x
                        out.append((need, int(b), s.ravel()))
                if out:
                    flat = np.concatenate([x[2] for x in out])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([col[c].as_py()] * len(out), batch.schema.field(c).type) for c in keys]
                        + [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()),
                           pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * z * z, pa.int32()), pa.array(flat))],
                        names=[*keys, "lags", "block", "packed"])

    return run


def test_chunks(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], k: int, min_train: int = 0, *, horizon: int = HORIZON
) -> DataFrame:
    """Actual values of the test blocks as arrays of at most ``horizon`` steps: (keys, fold, h, <col>s).

    The array of a column is named ``actual_<col>``; a missing value is NaN.
    """
    rows = test_rows(df.select(*keys, "idx", "n", *cols), k, min_train)
    part = F.floor(F.col("h") / horizon) * horizon
    packed = F.sort_array(F.collect_list(F.struct("h", *[
        F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) for c in cols])))
    out = rows.groupBy(*keys, "fold", part.cast("bigint").alias("h0")).agg(packed.alias("_p"))
    return out.select(*keys, "fold", F.col("h0").alias("h"),
                      *[F.col(f"_p.{c}").alias(f"actual_{c}") for c in cols])


def solver_rows(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], lags: int, k: int, min_train: int = 0,
    *, size: int = CHUNK, horizon: int = HORIZON,
) -> DataFrame:
    """Lag products next to the test values they are scored on.

    A series of at most ``size`` periods is summed where its rows meet once; a longer one is summed by chunks.
    """
    long = df.filter(F.col("n") > size)
    sums = lag_products(long, keys, cols, lags, k, min_train, size=size)
    chunks = test_chunks(long, keys, cols, k, min_train, horizon=horizon)
    return whole_rows(df.filter(F.col("n") <= size), keys, cols, lags, k, min_train, horizon=horizon).unionByName(
        attach_fold_values(chunks, sums, keys, size=size))


def whole_rows(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], lags: int, k: int, min_train: int = 0, *, horizon: int = HORIZON
) -> DataFrame:
    """``solver_rows`` of series that fit into a chunk: one exchange, and no row is copied per lag or fold."""
    rows = with_blocks(df.select(*keys, "idx", "n", *[F.col(c).cast("double").alias(c) for c in cols]), k)
    rows = rows.filter(F.col("block") <= k).select(*keys, "idx", "first", "test_size", "block", *cols)
    # rows are few bytes and much work: a stated number of partitions
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *keys).sortWithinPartitions(*keys, "idx")
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    actual = ", ".join(f"`actual_{c}` array<double>" for c in cols)
    return rows.transform(shipped).mapInArrow(
        whole_task(list(keys), list(cols), lags, k, min_train, horizon),
        f"{ddl}, fold int, h bigint, {actual}, gaps bigint, rows bigint, early bigint, mu array<double>, s array<double>, "
        "c array<double>, head array<double>, tail array<double>")


TASK_ROWS = 1 << 17  # rows summed at a time, and those of the last series


def whole_task(keys: list[str], cols: list[str], lags: int, k: int, min_train: int, horizon: int):
    """Sums of whole series, from rows sorted by (keys, idx); a series may lie across batches."""
    def run(batches):
        waiting, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            held += batch.num_rows
            if held >= TASK_ROWS:
                table = pa.Table.from_batches(waiting).combine_chunks()
                cut = int(_starts(table, keys)[-1])  # the last series may go on
                yield from _whole(table.slice(0, cut), keys, cols, lags, k, min_train, horizon)
                waiting = table.slice(cut).combine_chunks().to_batches()
                held = table.num_rows - cut
        if waiting:
            yield from _whole(pa.Table.from_batches(waiting).combine_chunks(), keys, cols, lags, k, min_train, horizon)

    return run


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a series begins: a null key equals a null key, as in a group."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in keys:
        codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    values = np.ascontiguousarray(values)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _whole(table: pa.Table, keys: list[str], cols: list[str], lags: int, k: int, min_train: int, horizon: int):
    if not table.num_rows:
        return
    v, width = len(cols), lags + 1
    at = {c: table.column(c).to_numpy() for c in ("idx", "first", "test_size", "block")}
    idx, block = at["idx"], at["block"]
    begin = _starts(table, keys)
    series = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(idx)))
    place = np.arange(len(idx)) - begin[series]  # of the row in its series
    null = np.array([table.column(c).combine_chunks().is_null().to_numpy(zero_copy_only=False) for c in cols])
    y = np.array([table.column(c).combine_chunks().fill_null(0.0).to_numpy() for c in cols])
    actual = np.where(null, np.nan, y)

    cell = series * (k + 1) + block  # rows of a cell follow each other
    edge = np.flatnonzero(np.diff(cell, prepend=-1))
    cells, shape = cell[edge], (len(begin), k + 1)

    def per_cell(x):
        """Sums row after row, as an aggregate adds: no tie between candidates is decided by another order."""
        return np.bincount(cell, weights=x, minlength=shape[0] * shape[1]).reshape(shape)

    with np.errstate(all="ignore"):
        first = np.where(null, 0.0, np.where(block == 0, y, 0.0))
        known = ~null & (block == 0)
        mu = np.array([per_cell(first[u])[:, 0] / np.maximum(per_cell(known[u].astype(float))[:, 0], 1.0) for u in range(v)])
        y = np.where(null, 0.0, y - mu[:, series])  # a missing value adds nothing to a sum
        usable = idx >= lags

        def back(u, i):
            """The value i rows before, 0 where there is none."""
            out = np.zeros(len(idx))
            out[i:] = y[u, :max(len(idx) - i, 0)]
            out[place < i] = 0.0
            return out

        shifted = [[back(u, i) for i in range(width)] for u in range(v)]
        gaps, rows, early = (np.cumsum(per_cell(x.astype(float)), axis=1) for x in (null.sum(axis=0), usable, ~usable))
        own = [np.where(usable, y[u], 0.0) for u in range(v)]
        total = lambda x: np.cumsum(per_cell(x), axis=1)
        s = np.stack([total(own[u]) for u in range(v)], axis=-1)
        c = np.stack([total(np.where(usable & ~null[u], y[u] * shifted[w][i], 0.0)) for u in range(v) for w in range(v) for i in range(width)], axis=-1)

    # a few rows per series: the first lags + 1, and the last of each block
    head, ends = np.zeros((*shape, v, width)), np.zeros((*shape, v, width))
    few = np.flatnonzero(idx <= lags)
    last = np.flatnonzero(idx == at["first"] + block * at["test_size"] - 1)
    for u in range(v):
        np.add.at(head, (series[few], block[few], u, lags - idx[few]), y[u, few])
        for i in range(width):
            ends[series[last], block[last], u, i] = shifted[u][i][last]
    head = np.cumsum(head, axis=1)

    present = np.zeros(shape[0] * shape[1], np.int64)
    present[cells] = np.diff(edge, append=len(idx))
    start = np.zeros(shape[0] * shape[1], np.int64)
    start[cells] = edge
    present, start = present.reshape(shape), start.reshape(shape)
    train = at["first"][begin][:, None] + np.arange(k + 1) * at["test_size"][begin][:, None]
    ok = (present[:, :-1] > 0) & (present[:, 1:] > 0) & (train[:, :-1] > min_train)
    who, fold = np.nonzero(ok)
    lo = start[who, fold + 1]
    hi = lo + present[who, fold + 1]
    # a long test block is several parts, by the step ahead
    step = idx - (at["first"] + (block - 1) * at["test_size"])
    part = step // horizon
    if len(lo) and (part[hi - 1] > 0).any():
        cuts = [lo[j] + np.flatnonzero(np.diff(part[lo[j]:hi[j]], prepend=-1)) for j in range(len(lo))]
        times = np.fromiter(map(len, cuts), np.int64, len(cuts))
        ends_of = [np.append(x[1:], h) for x, h in zip(cuts, hi)]
        who, fold, lo, hi = np.repeat(who, times), np.repeat(fold, times), np.concatenate(cuts), np.concatenate(ends_of)
    size = hi - lo
    offsets = np.concatenate([[0], np.cumsum(size)])
    pick = np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], size)
    names = [table.column(x).combine_chunks().take(pa.array(begin[who])) for x in keys]
    columns = [*names, pa.array(fold, pa.int32()), pa.array(part[lo] * horizon, pa.int64())]
    columns += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(actual[u, pick])) for u in range(v)]
    columns += [pa.array(x[who, fold].astype(np.int64)) for x in (gaps, rows, early)]
    columns += [_lists(mu.T[who]), _lists(s[who, fold]), _lists(c[who, fold])]
    columns += [_lists(x[who, fold].reshape(len(who), v * width)) for x in (head, ends)]
    out = pa.RecordBatch.from_arrays(columns, names=[
        *keys, "fold", "h", *[f"actual_{x}" for x in cols], "gaps", "rows", "early", "mu", "s", "c", "head", "tail"])
    for lo in range(0, out.num_rows, 8192):
        yield out.slice(lo, 8192)
