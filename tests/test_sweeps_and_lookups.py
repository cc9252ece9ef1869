"""Sweeps of E9 and E10/E11, lookups that must not miss, windows, centroid tiles and their plans."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexsense.functions import spans as S
from lexsense.operators import metrics as M
from lexsense.operators import pairs as PR
from lexsense.operators import records as R
from lexsense.operators import senses as SE
from lexsense.operators import vectors as V


def test_a_missing_gloss_fails_the_lookup(spark):
    d = spark.createDataFrame([(0, "w", "g", "e"), (1, "x", "g", "f")], "line_no long, word string, gloss string, example string")
    ok = spark.createDataFrame([("train", "g")], "split string, gloss string")
    assert [tuple(r) for r in R.build_definitions_lookup(d, ok).collect()] == [("train", "x", "G", "F")]
    for gloss in ("other", None):
        bad = ok.union(spark.createDataFrame([("test", gloss)], ok.schema))
        assert R.missing_members(d, bad).count() == 1
        with pytest.raises(Exception, match="gloss not in the dictionary"):
            R.build_definitions_lookup(d, bad).collect()


def test_windows_hold_every_id(spark):
    df = spark.createDataFrame([(n, list(range(n))) for n in (0, 1, 3, 4, 5, 8, 9)], "n long, ids array<long>")
    for r in df.select("n", S.windows("ids", 4).alias("w")).collect():
        assert len(r.w) == max(1, -(-r.n // 4)) and [x for w in r.w for x in w] == list(range(r.n))


def test_soft_match_counts_tokens_without_a_vector(spark):
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("z", [0.0, 0.0])], "token string, embedding array<double>")
    rows = [("a b", "a q"), ("a", "q"), ("q", "q"), ("a z", "a"), ("", "a"), ("a a b", "b a")]
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(rows)], "row_id long, gloss string, answer string")
    got = [r.bertscore for r in M.soft_match(M.prepare(df), vec).orderBy("row_id").collect()]
    # the q of an answer stays in the mean with cosine 0, and so does a gold token without a direction
    assert got == pytest.approx([0.5, 0, 0, 2 * 1 * 0.5 / 1.5, 0, 1])


def test_centroid_tiles_spread_a_hot_target(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", 1 + i % 2, i // 2, rng.normal(size=4).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "target string, grouping int, label int, embedding array<double>")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tiles = V.centroid_tiles(df, ["target"], tile=8).select(F.spark_partition_id().alias("p"), "i", "j", F.size("a").alias("m"), F.size("b").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r.m * r.n for r in tiles) == 60 * 60 and len({r.p for r in tiles}) >= 5
    one, two = ([np.array(v) for _, g, _, v in rows if g == k] for k in (1, 2))
    want = np.mean([(np.abs(a - b) / (np.abs(a) + np.abs(b))).sum() for a, b in itertools.product(one, two)])
    assert V.centroid_shift(df, ["target"]).first().APDP == pytest.approx(want)


def _answers(spark, seed=3):
    rnd = random.Random(seed)
    words = ["a", "of", "run", "walk", "sprint", "hurry"]
    rows = [(g, f"t{i % 5}", i, 1 + i % 2, rnd.randint(-1, 2), " ".join(rnd.choices(words, k=rnd.randint(0, 3))))
            for g in ("g1", "g2") for i in range(90)]
    return rows, spark.createDataFrame(rows, "gen string, target string, line_no long, grouping int, cluster int, answer string")


def test_sweep_equals_single_runs(spark):
    rows, df = _answers(spark)
    rng = np.random.default_rng(1)
    glosses = sorted({" ".join(w for w in r[5].split() if len(w) > k) for r in rows for k in (1, 2)})
    vec = spark.createDataFrame([(g, rng.normal(size=3).tolist()) for g in glosses], "gloss string, embedding array<double>")
    gold = spark.createDataFrame([(f"t{i}_nn", i * 7 % 5 / 5, i) for i in range(5)] + [("other", 1.0, 9)], "lemma string, change_graded double, line_no long")
    label = (F.length("gloss") % 3).alias("label")
    sweep = SE.evaluate_runs(df, vec, gold, ["gen"], filters=(1, 2), labels=lambda f: f.select("gen", "filter_", "target", "gloss", label))
    got = {(r.gen, r.filter_): r for r in sweep.collect()}
    assert set(got) == {(g, k) for g in ("g1", "g2") for k in (1, 2)}
    for (g, k), r in got.items():
        one = df.where(F.col("gen") == g).withColumn("gloss", SE.drop_short_tokens("answer", k))
        firsts = SE.keep_first(SE.clean_usages(one.drop("gen", "answer")), ["target"])
        _, _, scores = SE.sense_scores(one, vec, ["target"], firsts.select("target", "gloss", label))
        want = SE.run_record(scores, SE.limit_gold(gold, scores.select("target"))).first()
        for c in ("ARI", "RI", "PUR", "APD", "APDP"):
            assert r[c] == pytest.approx(want[c]), (g, k, c)
        assert r.n_cluster == want.n_cluster and r.n_true_cluster == want.n_true_cluster and len(r.n_cluster) == 5


def test_sweep_plan_is_short(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    plan = E.queries()["e10_e11_sweep"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 20 and "CartesianProduct" not in plan


def test_wic_from_answers(spark):
    vec = {"x y": [1.0, 0.0], "x": [1.0, 0.1], "z": [0.0, 1.0]}
    lines = ["x , y", "x .", "z ;", "x", "x y", "z", "z", "x y .", "x"]  # an odd tail line is dropped
    gold = ["T", " F", "F ", " T "]
    a = [(m, p, i, t) for m in ("m1", "m2") for p in ("dev", "test") for i, t in enumerate(lines)]
    out = PR.evaluate_wic_answers(
        spark.createDataFrame(a, "model string, part string, line_no long, answer string"),
        spark.createDataFrame(list(enumerate(gold)), "pair_id long, gold string"),
        spark.createDataFrame(list(vec.items()), "text string, embedding array<double>"), ["model"]).collect()
    # similar: pair 0 only (T); pairs 1 to 3 are far apart, and 3 is T
    assert {r.model: (r.dev_accuracy, r.accuracy) for r in out} == {m: (0.75, 0.75) for m in ("m1", "m2")}


def test_mix_in_order_and_packed(spark):
    rows = [("src1", "train", f"w{i}", f"gloss {i}", f"example {i}") for i in range(40)] + [("slang", "train", "x", "y", "z"), ("src1", "test", "x", "y", "z")]
    defs = spark.createDataFrame(rows, "dataset string, split string, target string, gloss string, example string")
    blocks = R.pack_training_mix(defs, n=32).orderBy("block").collect()
    mix = R.shuffled_positions(R.build_training_mix(defs)).orderBy("position").collect()
    tokens = [t for r in mix for t in [*r.text.split(), "</s>"]]
    assert len(mix) == 40 and [r.position for r in mix] == list(range(40))
    assert [b.text for b in blocks] == [" ".join(tokens[i:i + 32]) for i in range(0, len(tokens), 32)]


def test_packing_the_mix_writes_its_texts_once(spark, monkeypatch):
    """Nothing but the rendered text goes on, and it is written once."""
    from lexsense.operators import records as R
    seen = []

    def written(df):
        seen.append(df.columns)
        return df.localCheckpoint()

    monkeypatch.setattr(R, "written", written)
    rows = [("d", "train", f"w{i % 40}", f"gloss {i % 40}", f"an example {'long ' * (i % 40)}") for i in range(80)]
    defs = spark.createDataFrame(rows, "dataset string, split string, target string, gloss string, example string").dropDuplicates()
    out = R.pack_training_mix(defs, n=16)
    blocks = out.orderBy("block").collect()
    assert sum("text" in c for c in seen) == 1 and not any("gloss" in c or "example" in c for c in seen), seen
    mix = R.shuffled_positions(R.build_training_mix(defs)).orderBy("position").collect()
    tokens, places = [], []
    for r in mix:
        t = [*r.text.split(), "</s>"]
        tokens += t
        places += [r.position] * len(t)
    assert len(mix) == 40 and [r.block for r in blocks] == list(range(-(-len(tokens) // 16)))
    for r in blocks:
        cut = slice(16 * r.block, 16 * r.block + 16)
        assert (r.text.split(" "), r.n_tokens, r.first_doc, r.last_doc) == (tokens[cut], len(tokens[cut]), places[cut][0], places[cut][-1])
