"""The pipeline against its operators step by step, and the entry without the subpackage."""
from __future__ import annotations

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from lexsense.llm import flat, language, neardup, packing, quality, substrings
from lexsense.session import ensure_checkpoint_dir, ship_package

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_step_by_step(spark):
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = [x for x, _ in C.STAGES]
    assert named == ["language", "quality", "near_duplicates", "repeated_spans", "packing"]
    steps = [docs]
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, steps[-1], SF)
        assert out.columns == list(C.COLUMNS)
        steps.append(C.saved(out))
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    seen = {r["doc_id"] for r in language.identify(docs).collect() if r["lang_pred"] != "und" and r["score"] >= 0.02}
    assert ids(steps[1]) == seen
    model = quality.train(steps[1], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(steps[2]) == ids(quality.score(steps[1], model).where("score >= 0.5"))
    assert ids(steps[3]) == ids(neardup.near_duplicates(steps[2]).where("kept"))
    assert ids(steps[4]) == ids(steps[3])
    digest = {r["doc_id"]: r["kept_sha256"] for r in substrings.deduplicate(steps[3], text=False).collect()}
    joined = {r["doc_id"]: r["h"] for r in steps[4].select("doc_id", F.sha2(F.array_join(F.filter(
        F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), " "), 256).alias("h")).collect()}
    assert joined == digest
    want = sorted(map(tuple, packing.pack(steps[4]).select("doc_id", "start", "length", "ids_crc32").collect()))
    got = sorted(map(tuple, C.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()))
    assert got == want


def test_entry_without_the_subpackage(tmp_path):
    """A copy without llm and corpus_pipeline still imports, with the other queries."""
    import shutil
    shutil.copytree(os.path.join(ROOT, "lexsense"), tmp_path / "lexsense", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) >= 80


@pytest.mark.parametrize("n", range(1, 11))
def test_queries_are_registered(n):
    import __spark_entry__ as e
    assert sum(k.startswith(f"op{n}_") for k in e.queries()) == 1
    assert "pipeline" in e.queries()
    assert flat.CHUNK > 0
