"""Running totals, ranks and exact order statistics against plain Python."""
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexsense.operators import pairs as PR
from lexsense.operators import prefix as P
from lexsense.operators import records as R
from lexsense.operators import summary as SU
from lexsense.operators.ranks import average_rank


@pytest.mark.parametrize("by, descending", [(["g"], False), (["g"], True), ([], False)])
def test_running_totals(spark, by, descending):
    rnd = random.Random(2)
    keys = rnd.sample(range(10**12), 400)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), k, rnd.randint(0, 9)) for k in keys] + [("z", 5, 7)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(r.g, r.k): (r.before, r.total) for r in P.running_totals(df, by, "k", {"before": "v"}, {"total": "v"}, descending).collect()}
    sums, want = defaultdict(int), {}
    for g, k, v in sorted(rows, key=lambda r: r[1], reverse=descending):
        want[g, k] = sums[g if by else 0]
        sums[g if by else 0] += v
    assert got == {(g, k): (b, sums[g if by else 0]) for (g, k), b in want.items()}


def test_running_totals_split_a_hot_group_and_one_outlier(spark):
    rows = [("hot", k, 1) for k in range(2000)] + [("hot", 10**15, 1)]  # equal-width ranges would hold all but one row
    df = spark.createDataFrame(rows, "g string, k long, v long")
    sizes = [len(x) for x in df.repartitionByRange(8, "g", "k").rdd.glom().collect()]
    assert max(sizes) < 600
    assert P.running_totals(df, ["g"], "k", {"b": "v"}).agg(F.max("b")).first()[0] == 2000


def test_pack_with_one_outlier_id(spark):
    rows = [(i, "a b c d e f g") for i in range(300)] + [(2**50, "z")]
    out = R.pack(spark.createDataFrame(rows, "doc_id long, text string"), n=16).orderBy("block").collect()
    tokens = [t for _, x in rows for t in [*x.split(), "</s>"]]
    assert [r.text for r in out] == [" ".join(tokens[i:i + 16]) for i in range(0, len(tokens), 16)]
    assert out[-1].last_doc == 2**50 and sum(r.n_tokens for r in out) == len(tokens)


@pytest.mark.parametrize("sketch", [10_000, 40])
def test_order_statistics_are_exact(spark, sketch):
    rng = np.random.default_rng(6)
    groups = {"many": rng.normal(size=6000), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.array([3.5]),
              "two": np.array([1.0, 2.0]), "neg": -rng.random(999) ** 9, None: rng.random(50)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("many", None), ("none", None)]
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    out = {r.g: r for r in P.order_statistics(spark.createDataFrame(rows, "g string, y double"), ["g"], "y", shares, sketch).collect()}
    assert set(out) == set(groups)
    for g, x in groups.items():
        assert out[g].n == len(x)
        assert out[g].q == pytest.approx(np.quantile(x, shares).tolist(), abs=1e-12)


def test_selection_counts_few_values_of_a_large_group(spark):
    df = spark.range(400_000).select(F.lit("g").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 40)).alias("y"))
    x = np.sort(np.array([r.y for r in df.select("y").collect()]))
    made = []
    was = P.running_totals
    try:
        P.running_totals = lambda c, *a, **k: made.append(c.count()) or was(c, *a, **k)
        q = P.order_statistics(df, ["g"], "y", (0.25, 0.5, 0.75)).first().q
    finally:
        P.running_totals = was
    assert q == pytest.approx(np.quantile(x, (0.25, 0.5, 0.75)).tolist(), abs=1e-15)
    assert made[0] < 400_000 / 100


def test_box_plan_has_no_percentile_buffer(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)], "g string, y double")
    plan = SU.box_summary(df, ["g"], "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
    r = SU.box_summary(df, ["g"], "y").first()
    assert (r.q1, r.median, r.q3, r.whisker_lo, r.whisker_hi, r.n_outliers, r.n) == (24.75, 49.5, 74.25, 0, 99, 0, 100)


def test_ranks_without_a_window_over_all_rows(spark):
    rnd = random.Random(4)
    values = [rnd.choice([None, 0.5, *range(20)]) for _ in range(300)]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i long, v double")
    got = {r.i: r.rank for r in average_rank(df, [], "v", "rank").collect()}
    order = sorted(range(300), key=lambda i: (values[i] is not None, values[i] or 0))
    want = defaultdict(list)
    for place, i in enumerate(order, 1):
        want[values[i]].append(place)
    assert got == {i: pytest.approx(np.mean(want[v])) for i, v in enumerate(values)}


def test_shuffled_positions_with_equal_records(spark):
    mix = spark.createDataFrame([(9, "a"), (3, "b"), (9, "c"), (1, "d")], "shuffle_key long, text string")
    got = {r.text: r.position for r in R.shuffled_positions(mix).collect()}
    assert got["d"] == 0 and got["b"] == 1 and {got["a"], got["c"]} == {2, 3}


def test_threshold_ties_go_to_the_highest(spark):
    rows = [("a", 0.3, 0), ("a", 0.9, 0), ("b", 0.5, 1), ("c", 0.2, 1), ("c", 0.8, 0)]
    got = {r.model: (r.threshold, r.dev_accuracy) for r in PR.best_threshold(
        spark.createDataFrame(rows, "model string, sim double, label int")).collect()}
    assert got == {"a": (float("inf"), 1.0), "b": (0.5, 1.0), "c": (float("inf"), 0.5)}
