"""Running totals, ranks and exact order statistics of groups of any size, without a window over a whole group.

``running_totals`` cuts the table into ranges of its (group, order) space with Spark's range partitioner, so that
ranges hold about the same number of rows whatever the groups' sizes and however the keys are spread; totals
of the ranges (one row for each group and range) give the prefix offsets, and a window runs within a range
only. ``order_statistics`` selects by rank: brackets around the ranks from a quantile sketch, exact counts below
the brackets, and a running total over the few values inside them only.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

SKETCH = 10_000  # accuracy of a quantile sketch: ranks within 1 / SKETCH of a group


def joined(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Inner join on keys that may be null."""
    b = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return a.join(b, on).drop(*[f"_k{i}" for i in range(len(keys))])


def running_totals(df: DataFrame, by, order: str, sums: dict[str, str], totals: dict[str, str] | None = None,
                   descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``df`` with, for each (out, column) of ``sums``, the sum of the column over the rows of the same group that
    come before in ``order`` (the row itself left out), and for each of ``totals`` the sum over the group.

    (group, order) must be unique: aggregate equal keys first. ``by`` may be empty. The ranges are written as a
    table, as their limits are sampled and must not change between the totals and the rows."""
    by, totals = list(by), totals or {}
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    direction = F.desc(order) if descending else F.asc(order)
    ranged = written(df.repartitionByRange(n, *by, direction).withColumn("_range", F.spark_partition_id()))
    columns = sorted({*sums.values(), *totals.values()})
    each = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)  # both run over range totals: one row for each group and range
    base = each.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{out}") for out, c in sums.items()],
                       *[F.sum(f"_t_{c}").over(group).alias(out) for out, c in totals.items()])
    local = Window.partitionBy(*by, "_range").orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    out = joined(ranged, base, [*by, "_range"])
    return out.select(*df.columns, *[(F.col(f"_b_{out_}") + F.coalesce(F.sum(c).over(local), F.lit(0))).alias(out_) for out_, c in sums.items()],
                      *totals)


def value_ranks(df: DataFrame, by, col: str, out: str) -> DataFrame:
    """(by, col, out): the average 1-based rank of every distinct value within its group; nulls come first."""
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    r = running_totals(counts, by, col, {"_before": "_n"})
    return r.select(*by, col, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))


def order_statistics(df: DataFrame, by, y: str, shares, sketch: int = SKETCH) -> DataFrame:
    """(by, n, q): per group the count of non-null ``y`` and its exact linear quantiles at ``shares`` (an array).
    ``df`` is read three times and must give the same values each time: write computed doubles first.

    A quantile sketch gives a bracket around the one or two ranks that a share needs, with room for twice the
    sketch's error; the counts below and up to the bracket are exact, and an end that missed its rank moves out to
    the group's least or largest value. Only the values inside the brackets (about ``4 / sketch`` of a large
    group) are counted one by one and totalled in order, over as many ranges as there are partitions."""
    by, shares, e = list(by), list(shares), 2 / sketch
    rows = df.where(F.col(y).isNotNull()).select(*by, F.col(y).cast("double").alias("_y"))
    cuts = [F.lit(min(1.0, max(0.0, s + d))) for s in shares for d in (-e, e)]
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_y").alias("_lo"), F.max("_y").alias("_hi"),
                                 F.percentile_approx("_y", F.array(*cuts), sketch).alias("_g"))
    size = written(size)  # a sketch may differ when it is made anew
    ends = [(f"_lo{k}", F.col("_g")[2 * k], f"_hi{k}", F.col("_g")[2 * k + 1]) for k in range(len(shares))]
    seen = joined(rows, size.select(*by, *[c.alias(name) for lo, a, hi, b in ends for name, c in ((lo, a), (hi, b))]), by)
    seen = seen.groupBy(*by).agg(*[x for lo, _, hi, _ in ends for x in (
        F.count(F.when(F.col("_y") < F.col(lo), 1)).alias(f"{lo}_under"), F.count(F.when(F.col("_y") <= F.col(hi), 1)).alias(f"{hi}_upto"))])
    brackets = []
    for k, (s, (lo, a, hi, b)) in enumerate(zip(shares, ends)):
        at = F.lit(float(s)) * (F.col("n") - 1)
        low = F.col(f"{lo}_under") <= F.floor(at)
        high = F.col(f"{hi}_upto") > F.ceil(at)
        brackets.append(F.struct(
            F.lit(k).alias("q"), at.alias("at"), F.floor(at).alias("r"), F.ceil(at).alias("r2"),
            F.when(low, a).otherwise(F.col("_lo")).alias("lo"), F.when(high, b).otherwise(F.col("_hi")).alias("hi"),
            F.when(low, F.col(f"{lo}_under")).otherwise(F.lit(0)).alias("below")))
    state = written(joined(size, seen, by).select(*by, "n", F.array(*brackets).alias("w")))
    inside = joined(rows, state.select(*by, "w"), by).select(*by, "_y", F.explode("w").alias("x"))
    inside = inside.where((F.col("_y") >= F.col("x.lo")) & (F.col("_y") <= F.col("x.hi")))
    counts = inside.groupBy(*by, F.col("x.q").alias("q"), "_y").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_totals(counts, [*by, "q"], "_y", {"_u": "_c"})
    t = joined(ranked, state.select(*by, "n", F.explode("w").alias("x")).select(*by, "n", "x.*"), [*by, "q"])
    first = F.col("below") + F.col("_u")
    holds = lambda r: F.max(F.when((first <= F.col(r)) & (F.col(r) < first + F.col("_c")), F.col("_y")))
    found = t.groupBy(*by, "q", "n", "at", "r").agg(holds("r").alias("a"), holds("r2").alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("r"))
    return found.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", value.alias("v")))), lambda x: x["v"]).alias("q"))
