"""Average ranks (W3) and Spearman correlation (A13), grouped; no window over all rows of a group."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .prefix import joined, value_ranks


def _corr(x, y):
    """Pearson correlation; null where a side is constant (Spark's own corr divides by zero there)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def average_rank(df: DataFrame, by, col: str, out: str) -> DataFrame:
    """1-based rank of ``col`` within ``by`` (which may be empty); ties share the mean of their ranks.

    Ranks are found on the counts of the distinct values (``value_ranks``) and joined back by value."""
    return with_ranks(df, by, [col], out)


def spearman(df: DataFrame, by, x: str, y: str, out: str = "spearman") -> DataFrame:
    """Pearson correlation of the average ranks of ``x`` and ``y`` per group."""
    by = list(by)
    r = with_ranks(df, by, dict.fromkeys([x, y]))
    return r.groupBy(*by).agg(_corr(f"_r_{x}", f"_r_{y}").alias(out))


def spearman_columns(ranked_x: str, ys_ranked) -> list:
    """Aggregate expressions: Pearson of average ranks, one per (rank column, output name)."""
    return [_corr(ranked_x, r).alias(out) for r, out in ys_ranked]


def with_ranks(df: DataFrame, by, cols, out: str = "_r_{}") -> DataFrame:
    """Average ranks of several columns within ``by``. The rows are written first: a computed value may differ in
    its last bits when it is computed anew, and would then miss its own rank."""
    by, df = list(by), written(df)
    for c in cols:
        df = joined(df, value_ranks(df, by, c, out.format(c)), [*by, c])
    return df
