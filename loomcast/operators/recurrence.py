"""Linear recurrences y_t = A y_(t-1) + b_t over series of any length.

A series is cut into chunks. Within a chunk, a task streams the rows in order and gives each the response to the
chunk's own inputs from a zero start; over a whole chunk of m rows the recurrence is the affine map
y -> A^m y + e, with e the last response. The maps of a series' chunks, one small row each, are applied one after
another, which gives every chunk its start; a row's value is its response plus A^(i+1) times that start. No list of
rows is built, and no row is left out because it lies far back.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomcast.operators.split import CHUNK, chunk_of
from loomcast.shipping import shipped

BLOCK = 64  # rows answered by one product


def responses(a: np.ndarray, inputs: np.ndarray, start: np.ndarray) -> np.ndarray:
    """States (n, k) of y_t = A y_(t-1) + b_t from ``start``; inputs (n, k)."""
    n, k = inputs.shape
    powers = [np.eye(k)]
    for _ in range(BLOCK):
        powers.append(a @ powers[-1])
    toeplitz = np.zeros((BLOCK * k, BLOCK * k))
    for i in range(BLOCK):
        for j in range(i + 1):
            toeplitz[i * k:(i + 1) * k, j * k:(j + 1) * k] = powers[i - j]
    free = np.concatenate(powers[1:])  # (BLOCK * k, k)
    padded = np.zeros((-(-n // BLOCK) * BLOCK, k))
    padded[:n] = inputs
    out = padded.reshape(-1, BLOCK * k) @ toeplitz.T
    state = start
    for row in range(len(out)):
        out[row] += free @ state
        state = out[row, -k:]
    return out.reshape(-1, k)[:n]


def _local_task(key_columns: list[str], k: int, a: np.ndarray, names_out: list[str]):
    """Rows in the order of (series, chunk, idx), with the response to their chunk's inputs and its number of rows so far."""

    def run(batches):
        last, state, count = None, np.zeros(k), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(batch.schema.get_field_index(c)) for c in key_columns]
            change = np.zeros(batch.num_rows, bool)
            change[0] = last is None or last != tuple(c[0].as_py() for c in names)
            for c in names:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            inputs = np.stack([batch.column(batch.schema.get_field_index(f"_b_{i}")).to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
            out, place = np.empty_like(inputs), np.empty(batch.num_rows, np.int64)
            edges = [*np.flatnonzero(change).tolist(), batch.num_rows]
            if edges[0] != 0:
                edges = [0, *edges]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if change[lo]:
                    state, count = np.zeros(k), 0
                out[lo:hi] = responses(a, inputs[lo:hi], state)
                place[lo:hi] = count + np.arange(1, hi - lo + 1)
                state, count = out[hi - 1], count + hi - lo
            last = tuple(c[batch.num_rows - 1].as_py() for c in names)
            keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if not n.startswith("_b_")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(place), *[pa.array(out[:, i]) for i in range(k)]], names=names_out)

    return run


def _start_task(keys: list[str], k: int, a: np.ndarray):
    """Start state of every chunk of one series from the affine maps of the chunks before it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        ends = np.stack([table.column(f"_e_{i}").to_numpy() for i in range(k)], axis=1)
        size, state, out = table.column("_m").to_numpy(), np.zeros(k), np.zeros((table.num_rows, k))
        powers: dict = {}
        for row in range(table.num_rows):
            out[row] = state
            m = int(size[row])
            if m not in powers:
                powers[m] = np.linalg.matrix_power(a, m)
            state = powers[m] @ state + ends[row]
        columns = {c: table.column(c) for c in (*keys, "_chunk")}
        return pa.table({**columns, **{f"_s_{i}": pa.array(out[:, i]) for i in range(k)}})

    return run


def recurrence(
    df: DataFrame, keys: Sequence[str], matrix: Sequence[Sequence[float]], inputs: dict[str, Column], *, idx: str = "idx",
    size: int = CHUNK,
) -> DataFrame:
    """``df`` with the states y_t = A y_(t-1) + b_t, one column per entry of ``inputs`` (name -> b_t), from y_(-1) = 0.

    A missing input is an error of the caller: give it a value. Work and memory of a task do not depend on the length of a series.
    """
    a, k, names = np.array(matrix, float), len(inputs), list(inputs)
    rows = df.select("*", chunk_of(idx, size).alias("_chunk"), *[c.cast("double").alias(f"_b_{i}") for i, c in enumerate(inputs.values())])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *keys, "_chunk").sortWithinPartitions(*keys, "_chunk", idx)
    own = [c for c in rows.columns if not c.startswith("_b_")]
    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own) + ", _i bigint, " + ", ".join(f"_y_{i} double" for i in range(k))
    made = [*own, "_i", *[f"_y_{i}" for i in range(k)]]
    local = dealt.transform(shipped).mapInArrow(_local_task([*keys, "_chunk"], k, a, made), ddl)
    ends = local.groupBy(*keys, "_chunk").agg(F.max("_i").alias("_m"), *[F.max_by(f"_y_{i}", "_i").alias(f"_e_{i}") for i in range(k)])
    key_ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    starts = ends.groupBy(*keys).applyInArrow(
        _start_task(list(keys), k, a), f"{key_ddl}, _chunk bigint, " + ", ".join(f"_s_{i} double" for i in range(k)))
    joined = local.join(starts, [*keys, "_chunk"])
    # A^(i+1) of every place in a chunk: a power of numbers where A is diagonal
    if np.array_equal(a, np.diag(np.diag(a))):
        value = [F.col(f"_y_{i}") + F.pow(F.lit(float(a[i, i])), F.col("_i").cast("double")) * F.col(f"_s_{i}") for i in range(k)]
        return joined.select(*df.columns, *[v.alias(n) for v, n in zip(value, names)])
    out_ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns) + ", " + ", ".join(f"`{n}` double" for n in names)
    kept = df.columns

    def finish(batches):
        table = [np.eye(k)]
        for batch in batches:
            col = {n: batch.column(j) for j, n in enumerate(batch.schema.names)}
            place = col["_i"].to_numpy(zero_copy_only=False)
            while len(table) <= place.max(initial=0):  # at most one per row of a chunk
                table.append(a @ table[-1])
            start = np.stack([col[f"_s_{i}"].to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
            moved = np.empty_like(start)
            for lo in range(0, len(place), 4096):
                moved[lo:lo + 4096] = np.einsum("nij,nj->ni", np.array([table[p] for p in place[lo:lo + 4096]]), start[lo:lo + 4096])
            yield pa.RecordBatch.from_arrays(
                [*[col[c] for c in kept], *[pa.array(col[f"_y_{i}"].to_numpy(zero_copy_only=False) + moved[:, i]) for i in range(k)]], names=[*kept, *names])

    return joined.transform(shipped).mapInArrow(finish, out_ddl)
