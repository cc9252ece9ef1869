"""Summaries over finished score tables."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .prefix import order_statistics


def summarise_definitions(scored: DataFrame, by=("model", "dataset"), metrics=None) -> DataFrame:
    """A2: mean of every metric per group. ``metrics`` defaults to all numeric columns after the
    first four record columns, as the score printers do (built from the schema, not a fixed list)."""
    if metrics is None:
        skip = set(by) | {"row_id", "target", "gloss", "example", "answer"}
        metrics = [f.name for f in scored.schema.fields
                   if f.name not in skip and f.dataType.typeName() in ("double", "float", "integer", "long")]
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(m).alias(m) for m in metrics])


def melt(df: DataFrame, ids, values, var: str = "Metric", value: str = "Value") -> DataFrame:
    """Wide metric columns -> (ids..., Metric, Value)."""
    return df.unpivot(list(ids), list(values), var, value)


def box_summary(df: DataFrame, by, y: str) -> DataFrame:  # by: at least one column
    """The numbers behind a box plot: linear quartiles, whiskers at the furthest points inside
    1.5 IQR of the box, and the count of points outside them.

    The quartiles are exact order statistics found by distributed selection (``order_statistics``), so a group
    of any number of distinct values needs bounded buffers only. Null values are left out of the quartiles and
    count as outside the whiskers."""
    by = list(by)
    df = written(df.select(*by, y))  # a computed value may differ in its last bits when it is computed anew
    q = order_statistics(df, by, y, (0.25, 0.5, 0.75)).select(
        *by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    j = df.select(*by, y).join(q, by)
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col(y) >= F.col("q1") - 1.5 * iqr) & (F.col(y) <= F.col("q3") + 1.5 * iqr)
    return j.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(y))).alias("whisker_lo"),
        F.max(F.when(inside, F.col(y))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(1)).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))


def line_summary(df: DataFrame, by, y: str, out: str | None = None, replicates: int = 0,
                 row_key: str | None = None, seed: int = 0) -> DataFrame:
    """Mean of ``y`` per (x, hue) group; with ``replicates`` also its bootstrap band (A16) as
    ``ci_lo`` and ``ci_hi``, for rows told apart by ``row_key``."""
    line = df.groupBy(*by).agg(F.avg(y).alias(out or y), F.count(F.lit(1)).alias("n"))
    if not replicates:
        return line
    band = bootstrap_band(df, by, y, row_key, replicates, seed).drop("mean")
    return line.join(band, list(by))


def _poisson1_cdf(kmax: int = 40) -> list[float]:
    """P(K <= k) for K ~ Poisson(1), k = 0..kmax."""
    out, term, acc = [], math.exp(-1.0), 0.0
    for k in range(kmax + 1):
        acc += term
        out.append(acc)
        term /= (k + 1)
    return out


POISSON1_CDF = _poisson1_cdf()


def poisson_weight(u) -> "F.Column":
    """Inverse CDF of Poisson(1) at a uniform ``u``."""
    w = F.lit(len(POISSON1_CDF))
    for k in reversed(range(len(POISSON1_CDF))):
        w = F.when(u < POISSON1_CDF[k], F.lit(k)).otherwise(w)
    return w


def bootstrap_band(df: DataFrame, by, y: str, row_key: str, replicates: int = 200, seed: int = 0,
                   level: float = 0.95) -> DataFrame:
    """Mean of ``y`` per group with a seeded Poisson-bootstrap interval.

    Every (row, replicate) gets a Poisson(1) weight from an md5 of (seed, row key, replicate), so
    the job is one pass, repeatable and independent of partitioning; the weighted sums are
    combined map-side per (group, replicate) before the shuffle."""
    by = list(by)
    rep = df.select(*by, y, row_key, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_b"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_key).cast("string"), F.col("_b").cast("string")))
    u = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    rep = rep.withColumn("_w", poisson_weight(u))
    per = rep.groupBy(*by, "_b").agg(F.try_divide(F.sum(F.col("_w") * F.col(y)), F.sum("_w")).alias("_m"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    band = per.groupBy(*by).agg(F.percentile("_m", F.array(F.lit(lo), F.lit(hi))).alias("_ci"))
    means = df.groupBy(*by).agg(F.avg(y).alias("mean"))
    out = means.join(band, by)
    return out.select(*by, "mean", F.col("_ci")[0].alias("ci_lo"), F.col("_ci")[1].alias("ci_hi"))
