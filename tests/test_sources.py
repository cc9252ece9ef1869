"""Readers and sinks: exact line numbers over split files, bad-line rules, JSON array, zip check."""
import csv
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexsense.sources import files as IO
from lexsense.sources import split_records as SR


def test_text_lines_exact_over_splits(spark, tmpdir_path):
    paths = []
    for f in range(3):
        p = os.path.join(tmpdir_path, f"part-{f}.txt")
        with open(p, "w") as fh:
            for i in range(3000 + f * 500):
                fh.write(f"{f}-{i} " + "x" * (i % 37) + "\n")
        paths.append(p)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = IO.text_lines(spark, tmpdir_path)
        rows = df.select(F.regexp_extract("file", r"part-(\d)", 1).alias("f"), "line_no", "value").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3000 + 3500 + 4000
    for r in rows:
        assert r.value.split(" ")[0] == f"{r.f}-{r.line_no}"


def test_lines_round_trip_in_order(spark, tmpdir_path):
    df = spark.range(0, 5000).select(F.col("id"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("value"))
    out = os.path.join(tmpdir_path, "lines")
    IO.write_lines(df, out, "id", partitions=7)
    back = IO.text_lines(spark, out, per_file=False).collect()
    assert sorted((r.line_no, r.value) for r in back) == [(i, f"row {i}") for i in range(5000)]


def test_tsv_lines_bad_and_short(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "s.txt")
    with open(p, "w") as fh:
        fh.write("a%1\tx\ty\tgloss one\tz\tw\n")
        fh.write("b%2\tx\ty\tgloss two\tz\tw\textra\n")   # too many fields: rejected
        fh.write("c%3\tx\ty\n")                           # too few: kept, null-filled
        fh.write("\n")                                    # blank: skipped
        fh.write("d%4\tx\ty\tgloss four\tz\tw\n")
    ok, bad = IO.read_tsv_lines(spark, p, IO.SENSE_LINE)
    got = sorted((r.line_no, r.sense, r.gloss) for r in ok.collect())
    assert got == [(0, "a%1", "gloss one"), (2, "c%3", None), (4, "d%4", "gloss four")]
    assert [(r.line_no, r.n_fields) for r in bad.collect()] == [(1, 7)]


def test_json_array_and_jsonl(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "members.json")
    with open(p, "w") as fh:
        json.dump([{"gloss": "g1", "other": 1}, {"gloss": "g2"}], fh, indent=1)
    df = IO.read_json_array(spark, p, T.StructType([T.StructField("gloss", T.StringType())]))
    assert sorted(r.gloss for r in df.collect()) == ["g1", "g2"]
    q = os.path.join(tmpdir_path, "d.jsonl")
    with open(q, "w") as fh:
        for i in range(4):
            fh.write(json.dumps({"target": f"t{i}", "gloss": "g", "example": "e"}) + "\n")
    rows = IO.read_jsonl(spark, q, IO.DEFINITION, with_line=True).collect()
    assert sorted((r.line_no, r.target) for r in rows) == [(i, f"t{i}") for i in range(4)]


def test_zip_lines_fails_on_length_mismatch(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "line_no long, gloss string")
    b = spark.createDataFrame([(0, "p")], "line_no long, answer string")
    with pytest.raises(Exception, match="different lengths"):
        IO.zip_lines(a, b).collect()
    ok = IO.zip_lines(a, spark.createDataFrame([(0, "p"), (1, "q")], "line_no long, answer string")).count()
    assert ok == 2


def test_sets_sink_and_pruned_scan(spark, tmpdir_path):
    df = spark.createDataFrame([("t", "g", "e", d, s) for d in ("oxford", "slang", "wiki") for s in ("train", "test")],
                               "target string, gloss string, example string, dataset string, split string")
    IO.write_sets(df, os.path.join(tmpdir_path, "sets"))
    got = IO.scan_sets(spark, os.path.join(tmpdir_path, "sets"), IO.DEFINITION)
    assert [(r.dataset, r.split) for r in got.collect()] == [("oxford", "train")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


# ---- records over splits

TRICKY = ["plain", 'say "hi"', "two\nlines", 'ends"', '"starts', "a,b", ",", '"', '""', '",\n"', "\n\n", "x\n", "\ny", "tab\t", "é\u2028ü",
          'stray " quote', "back\\slash", 'mix\n"a",\n"b"\n', "{brace}", "}{", "[", "]", 'q"}', '\\"', "}\n]"]


def small_splits(spark, size, run):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records_over_splits(spark, tmpdir_path, end):
    rnd = random.Random(3)
    files = {}
    for f in ("part-00000-a.csv", "part-99999-b.csv", "part-100000-c.csv"):
        files[f] = [(f"w{i}", rnd.choice(TRICKY) + rnd.choice(TRICKY), f"{rnd.choice(TRICKY)}{i}") for i in range(400)]
        with open(os.path.join(tmpdir_path, f), "w", newline="") as fh:
            w = csv.writer(fh, lineterminator=end)
            w.writerow(["word", "gloss", "example"])
            w.writerows(files[f])
    got = small_splits(spark, 700, lambda: SR.read_csv_records(spark, tmpdir_path, IO.DICTIONARY).orderBy("_order").collect())
    want = [r for f in ("part-00000-a.csv", "part-99999-b.csv", "part-100000-c.csv") for r in files[f]]
    assert [(r.word, r.gloss, r.example) for r in got] == want


def test_csv_records_with_stray_quotes_and_blank_lines(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "d.csv")
    with open(p, "w") as fh:
        fh.write('word,gloss,example\n\nab"c,5" nail,x\n"q\n""z",b"b,"m\nn"\n\nlast,1,2')
    got = small_splits(spark, 9, lambda: SR.read_csv_records(spark, p, IO.DICTIONARY).orderBy("_order").collect())
    assert [(r.word, r.gloss, r.example) for r in got] == [('ab"c', '5" nail', "x"), ('q\n"z', 'b"b', "m\nn"), ("last", "1", "2")]


@pytest.mark.parametrize("indent, size", [(None, 300), (1, 300), (None, 11), (2, 10**8)])
def test_json_arrays_over_splits(spark, tmpdir_path, indent, size):
    rnd = random.Random(5)
    items = [{"gloss": rnd.choice(TRICKY) + rnd.choice(TRICKY), "n": i, "deep": {"a": [{"b": rnd.choice(TRICKY)}] * rnd.randint(0, 2)}}
             for i in range(25 if size == 11 else 300)]
    p = os.path.join(tmpdir_path, "members.json")
    with open(p, "w") as fh:
        json.dump(items, fh, indent=indent, ensure_ascii=False)
    schema = T.StructType([T.StructField("gloss", T.StringType()), T.StructField("n", T.LongType()),
                           T.StructField("deep", T._parse_datatype_string("struct<a:array<struct<b:string>>>"))])
    got = small_splits(spark, size, lambda: SR.read_json_records(spark, p, schema).orderBy("_order").collect())
    assert [r.asDict(recursive=True) | {} for r in got] == [x | {"_order": g["_order"].asDict()} for x, g in zip(items, got)]
    assert len(got) == len(items)


def test_json_arrays_sink_and_empty_arrays(spark, tmpdir_path):
    df = spark.createDataFrame([(i, TRICKY[i % len(TRICKY)]) for i in range(200)], "i long, t string")
    out = os.path.join(tmpdir_path, "arrays")
    SR.write_json_arrays(df.withColumn("at", -F.col("i")), out, "at", partitions=5)
    parts = sorted(f for f in os.listdir(out) if f.startswith("part-"))
    assert len(parts) > 1 and all(isinstance(json.load(open(os.path.join(out, f))), list) for f in parts)
    with open(os.path.join(out, "part-77777.txt"), "w") as fh:
        fh.write(" [ ]\n")
    got = SR.read_json_records(spark, out, T.StructType([T.StructField("i", T.LongType()), T.StructField("t", T.StringType())]))
    assert [(r.i, r.t) for r in got.orderBy("_order").collect()] == [(i, TRICKY[i % len(TRICKY)]) for i in range(199, -1, -1)]
