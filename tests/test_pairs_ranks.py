"""Threshold sweep, average ranks and Spearman against brute force."""
import random

import numpy as np
import pytest

from lexsense.operators import pairs as PR
from lexsense.operators.ranks import average_rank, spearman


def brute_threshold(scores, labels):
    cands = sorted(set(scores), reverse=True)
    cands = [float("inf")] + cands
    best, best_t = -1, None
    for t in cands:  # decreasing thresholds, first max wins -> highest threshold among ties
        acc = np.mean([(s >= t) == bool(y) for s, y in zip(scores, labels)])
        if acc > best:
            best, best_t = acc, t
    return best_t, best


@pytest.mark.parametrize("seed", range(6))
def test_best_threshold_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for m in ("a", "b"):
        for _ in range(rnd.randint(1, 40)):
            rows.append((m, round(rnd.uniform(-1, 1), 1 if seed % 2 else 6), rnd.randint(0, 1)))
    df = spark.createDataFrame(rows, "model string, sim double, label int")
    got = {r.model: (r.threshold, r.dev_accuracy) for r in PR.best_threshold(df).collect()}
    for m in ("a", "b"):
        s = [r[1] for r in rows if r[0] == m]
        y = [r[2] for r in rows if r[0] == m]
        t, a = brute_threshold(s, y)
        assert got[m][0] == t
        assert got[m][1] == pytest.approx(a)


def test_average_rank_and_spearman(spark):
    xs = [3, 1, 4, 1, 5, 9, 2, 6]
    ys = [2, 7, 1, 8, 2, 8, 1, 8]
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(xs, ys)], "g string, x double, y double")
    ranks = [r.rx for r in average_rank(df, ["g"], "x", "rx").orderBy("x").collect()]
    assert ranks == [1.5, 1.5, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]

    def avg_rank(v):
        order = sorted(v)
        return [np.mean([i + 1 for i, o in enumerate(order) if o == x]) for x in v]
    want = np.corrcoef(avg_rank(xs), avg_rank(ys))[0, 1]
    got = spearman(df, ["g"], "x", "y").first()["spearman"]
    assert got == pytest.approx(want)


def test_pair_adjacent_drops_tail(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "line_no long, v double")
    out = PR.pair_adjacent(df, "line_no", ("v",)).orderBy("pair_id").collect()
    assert [(r.pair_id, r.v1, r.v2) for r in out] == [(0, 0.0, 1.0), (1, 2.0, 3.0)]
