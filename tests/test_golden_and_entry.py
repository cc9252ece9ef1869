"""Golden table of the published WiC accuracies, the driver contract and plan properties."""
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lexsense.operators import summary as SU
from lexsense.sources import files as IO

from conftest import SF_SMALL

# Published test accuracies of four generators, one for each of 14 encoders, and their min, median, max.
PUBLISHED = {
    "A": (0.730, 0.722, 0.731, 0.719, 0.715, 0.706, 0.721, 0.724, 0.711, 0.719, 0.711, 0.672, 0.686, 0.725),
    "B": (0.731, 0.724, 0.703, 0.713, 0.734, 0.728, 0.724, 0.702, 0.713, 0.719, 0.735, 0.707, 0.719, 0.716),
    "C": (0.705, 0.694, 0.714, 0.726, 0.720, 0.705, 0.714, 0.730, 0.714, 0.719, 0.710, 0.701, 0.698, 0.715),
    "D": (0.736, 0.719, 0.726, 0.742, 0.729, 0.734, 0.737, 0.726, 0.728, 0.728, 0.748, 0.704, 0.712, 0.731),
}
EXPECTED = {"A": (0.672, 0.719, 0.731), "B": (0.702, 0.719, 0.735), "C": (0.694, 0.714, 0.730), "D": (0.704, 0.7285, 0.748)}


def test_golden_wic_summary(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "results.jsonl")
    with open(path, "w") as fh:
        for model, values in PUBLISHED.items():
            fh.writelines(json.dumps({"sbert": f"enc-{k}", "model": model, "accuracy": x}) + "\n" for k, x in enumerate(values))
    df = IO.read_jsonl(spark, path, IO.WIC_RESULT)
    assert df.count() == 56
    box = {r.model: r for r in SU.box_summary(df, ["model"], "accuracy").collect()}
    mm = {r.model: r for r in df.groupBy("model").agg(F.min("accuracy").alias("lo"), F.max("accuracy").alias("hi")).collect()}
    for m, (lo, med, hi) in EXPECTED.items():
        assert mm[m].lo == pytest.approx(lo) and mm[m].hi == pytest.approx(hi)
        assert box[m].median == pytest.approx(med)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "nltk_bleu" in df.columns and "model" in df.columns


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


FAST = ["e1_build_definitions", "e4_build_usages", "e5_build_judgments", "e9_evaluate_wic", "a2_sweep_means",
        "p2_normalise", "m2_bleu", "a6_a8_partition_scores", "e12_summarise_sweep", "j12_e13_pending_runs"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_parity_small(spark, name):
    from tools.parity import compare, duck
    r = compare(spark, duck(SF_SMALL), name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert r["cols_ok"] and r["values_ok"], r


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e1_build_definitions", "e4_build_usages", "e5_build_judgments", "e9_evaluate_wic",
                                  "a6_a8_partition_scores", "w6_pack", "e12_summarise_sweep"])
def test_expression_only_jobs_have_no_python_and_no_cartesian(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_scan_prunes_columns(spark):
    p = _plan(E.queries()["e5_build_judgments"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in p
