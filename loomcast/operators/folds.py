"""Rolling-origin folds by arithmetic on idx and n.

``test_size = n div (k+1)``, ``first = n - k * test_size``; block 0 holds the first rows, blocks
1..k the test blocks. Fold j trains on blocks 0..j and is tested on block j+1. Training sums of
all folds are prefix sums over the k+1 block sums of a series: rows are never copied per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomcast.operators.split import CHUNK


def with_blocks(df: DataFrame, k: int) -> DataFrame:
    """Add test_size, first and block; series too short for k folds are left out."""
    return (
        df.withColumn("test_size", F.floor(F.col("n") / (k + 1)))
        .filter("test_size > 0")
        .withColumn("first", F.col("n") - k * F.col("test_size"))
        .withColumn("block", F.when(F.col("idx") < F.col("first"), F.lit(0)).otherwise(
            1 + F.floor((F.col("idx") - F.col("first")) / F.col("test_size"))).cast("int"))
    )


def test_rows(df: DataFrame, k: int, min_train: int = 0) -> DataFrame:
    """Rows of the test blocks with fold, train_size and step ahead h = 0, 1, ..."""
    out = with_blocks(df, k).filter("block > 0").withColumn("fold", F.col("block") - 1)
    out = out.withColumn("train_size", F.col("first") + F.col("fold") * F.col("test_size"))
    return (
        out.filter(F.col("train_size") > min_train)
        .withColumn("h", F.col("idx") - F.col("train_size")).drop("block", "first")
    )


def fold_rows(df: DataFrame, k: int, min_train: int = 0) -> DataFrame:
    """Every fold with its own copy of its rows (role train/test), for callers that need them."""
    out = with_blocks(df, k)
    folds = F.sequence(F.greatest(F.col("block") - 1, F.lit(0)), F.lit(k - 1))
    out = out.withColumn("fold", F.explode(folds))
    out = out.withColumn("train_size", F.col("first") + F.col("fold") * F.col("test_size"))
    return (
        out.filter((F.col("train_size") > min_train))
        .withColumn("role", F.when(F.col("block") <= F.col("fold"), "train").otherwise("test"))
        .drop("block", "first")
    )


def fold_sizes(df: DataFrame, keys: Sequence[str], k: int, min_train: int = 0) -> DataFrame:
    """Report of train and test sizes per series and fold."""
    per = df.groupBy(*keys).agg(F.max("n").alias("n"))
    per = per.withColumn("test_size", F.floor(F.col("n") / (k + 1))).filter("test_size > 0")
    per = per.select(*keys, "n", "test_size", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    return per.withColumn(
        "train_size", F.col("n") - (k - F.col("fold")) * F.col("test_size")
    ).filter(F.col("train_size") > min_train).select(*keys, "fold", "train_size", "test_size")


def train_prefix(
    df: DataFrame,
    keys: Sequence[str],
    k: int,
    sums: dict[str, Column | str],
    *,
    firsts: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    min_train: int = 0,
) -> DataFrame:
    """Aggregates over the training rows of every fold: (keys, fold, train_size, test_size, ...).

    ``sums`` (columns or SQL texts) are summed; ``firsts``/``lasts`` give the value of a column in the first/last
    training row. One aggregation with map-side combine, then a window over k+1 rows per series.
    """
    firsts, lasts = firsts or {}, lasts or {}
    rows = (df if "block" in df.columns else with_blocks(df, k)).filter(F.col("block") < k)
    blocks = rows.groupBy(*keys, "block", "first", "test_size").agg(
        *[F.expr(f"sum({c}) AS {a}") if isinstance(c, str) else F.sum(c).alias(a) for a, c in sums.items()],
        *[F.min_by(c, "idx").alias(a) for a, c in firsts.items()],
        *[F.max_by(c, "idx").alias(a) for a, c in lasts.items()],
    )
    upto = upto_block(keys)
    out = blocks.selectExpr(
        *[f"`{c}`" for c in keys], "block AS fold", "first + block * test_size AS train_size", "test_size",
        *[f"sum({a}) {upto} AS {a}" for a in sums],
        *[f"first({a}) {upto} AS {a}" for a in firsts],
        *lasts,
    )
    return out.filter(F.col("train_size") > min_train)


def upto_block(keys: Sequence[str]) -> str:
    """SQL text of the window over a series' blocks up to the current one."""
    by = ", ".join(f"`{c}`" for c in keys)
    return f"OVER (PARTITION BY {by} ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def train_prefix_packed(
    df: DataFrame, keys: Sequence[str], k: int, sums: Sequence[str], *,
    per_block: Sequence[str] = (), extra_keys: Sequence[str] = (), min_train: int = 0, whole: bool = False,
) -> DataFrame:
    """Like ``train_prefix`` for hundreds of sums (SQL texts): they travel as one array ``packed``.

    ``per_block`` gives an array ``ends`` of sums over the last block of the training set alone.
    ``whole`` gives fold k alone: it trains on every row. ``df`` may already carry the block
    columns. One window function adds up the arrays of a
    series' k+1 blocks, so the plan does not grow with the number of sums.
    """
    rows = df if "block" in df.columns else with_blocks(df, k)
    if not whole:
        rows = rows.filter(F.col("block") < k)

    def pack(texts, name):
        return F.expr("array(" + ", ".join(f"coalesce(sum({t}), 0D)" for t in texts) + f") AS {name}")

    aggs = [pack(sums, "packed")] + ([pack(per_block, "ends")] if per_block else [])
    blocks = rows.groupBy(*keys, "block", "first", "test_size", *extra_keys).agg(*aggs)
    out = blocks.selectExpr(
        *[f"`{c}`" for c in keys], "block AS fold", "first + block * test_size AS train_size", "test_size",
        *[f"`{c}`" for c in extra_keys],
        f"aggregate(collect_list(packed) {upto_block(keys)}, array_repeat(0D, {len(sums)}), "
        "(a, b) -> zip_with(a, b, (x, y) -> x + y)) AS packed",
        *(["ends"] if per_block else []),
    )
    if whole:
        out = out.filter(F.col("fold") == k)
    return out.filter(F.col("train_size") > min_train)


def attach_fold_values(rows: DataFrame, per_fold: DataFrame, keys: Sequence[str], *, size: int = CHUNK) -> DataFrame:
    """Join per-(series, fold) values to test rows; long test blocks are spread by chunk of h."""
    names = [c for c in per_fold.columns if c not in (*keys, "fold", "train_size", "test_size")]
    spread = per_fold.select(
        *keys, "fold", *names,
        F.explode(F.sequence(F.lit(0), F.floor((F.col("test_size") - 1) / size))).alias("_hc"))
    return rows.withColumn("_hc", F.floor(F.col("h") / size)).join(
        spread, [*keys, "fold", "_hc"]).drop("_hc")
