"""The driver imports __spark_entry__ from another working directory with its own plain session:
the package's UDFs and mapInPandas functions must still resolve on the executors."""
import os
import subprocess
import sys
import textwrap

from conftest import ROOT, SF_SMALL


def test_entry_and_udf_queries_from_foreign_cwd(tmp_path):
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
        import __spark_entry__ as E
        assert len(E.entry(spark).collect()) > 0
        q = E.queries()
        for name in ("m1_rouge_l", "m7_soft_match", "v3_density_clusters"):
            assert len(q[name](spark, {SF_SMALL!r}).collect()) > 0, name
        print("DRIVER-OK")
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", script], cwd=str(tmp_path), env=env, capture_output=True,
                       text=True, timeout=600)
    assert "DRIVER-OK" in r.stdout, r.stderr[-3000:]
