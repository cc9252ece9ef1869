"""Round-trip queries of the sources and sinks: fixture rows are written in the reference's file
formats to a fresh folder under ``spark.checkpoint.dir`` and read back with our readers."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as fx
from ..operators import records as R
from ..operators.prefix import running_totals
from ..oracle import dg_sql, with_views
from ..session import table
from ..sources import files as IO
from ..sources import split_records as SR
from .prepare import _E1_BODY, _E1_SQL, _E2_CTES, _SQL_CUT, _cut_lines, _dictionary
from .registry import query, r6
from .scoring import scored as dg_scored
from .senses import _WIC, _wic

_NL = "replace(replace({c}, chr(10), ' '), chr(13), ' ')"


def _flat(c) -> F.Column:
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "[\\n\\r]", " ")


@query("s7_s11_answer_lines", with_views(
    f"select row_number() over (order by row_id) - 1 as line_no, {_NL.format(c='answer')} as answer from v_pairs",
    "v_pairs"))
def s7_s11_answer_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.pairs(spark, sf).select("row_id", _flat("answer").alias("value"))
    path = IO.scratch_dir(spark, "answers")
    IO.write_lines(p, path, "row_id")
    return IO.text_lines(spark, path, per_file=False).select("line_no", F.col("value").alias("answer"))


@query("j3_zip_answers", with_views(
    f"select row_number() over (order by row_id) - 1 as line_no, gloss, {_NL.format(c='answer')} as answer from v_pairs",
    "v_pairs"))
def j3_zip_answers(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.pairs(spark, sf)
    inputs = IO.scratch_dir(spark, "inputs")
    answers = IO.scratch_dir(spark, "answers")
    IO.write_lines(p.select("row_id", F.to_json(F.struct("gloss")).alias("value")), inputs, "row_id")
    IO.write_lines(p.select("row_id", _flat("answer").alias("value")), answers, "row_id")
    g = IO.read_jsonl(spark, inputs, T.StructType([T.StructField("gloss", T.StringType())]), with_line=True,
                      per_file=False).select("line_no", "gloss")
    a = IO.text_lines(spark, answers, per_file=False).select("line_no", F.col("value").alias("answer"))
    return IO.zip_lines(g, a).select("line_no", "gloss", "answer")


@query("s9_s5_definition_sets", _E1_SQL)
def s9_s5_definition_sets(spark: SparkSession, sf: str) -> DataFrame:
    senses, examples = _cut_lines(spark, sf)
    path = IO.scratch_dir(spark, "sets")
    IO.write_sets(R.build_definitions(senses, examples), path)
    back = spark.read.schema(T.StructType(list(IO.DEFINITION.fields) + [
        T.StructField("dataset", T.StringType()), T.StructField("split", T.StringType())])).json(path)
    return back.select("dataset", "split", "target", "gloss", "example")


@query("s6_s8_training_sets", with_views(
    "select dataset, target, gloss, example from e1 where split = 'train' and dataset not in ('src3', 'src7')",
    "v_lines", extra={**_SQL_CUT, "e1": _E1_BODY}))
def s6_s8_training_sets(spark: SparkSession, sf: str) -> DataFrame:
    senses, examples = _cut_lines(spark, sf)
    path = IO.scratch_dir(spark, "sets")
    IO.write_sets(R.build_definitions(senses, examples), path)
    files = IO.scan_sets(spark, path, IO.DEFINITION, exclude=("src3", "src7"))
    # the dataset is also recoverable from the path alone
    keyed = files.select("target", "gloss", "example", IO.file_key("dataset=([^/]+)", 1,
                                                                   "_metadata.file_path").alias("dataset"))
    return keyed.select("dataset", "target", "gloss", "example")


@query("s10_s3_scores_tsv", "select row_id, model, dataset, nltk_bleu, exact_match from ("
       + dg_sql(["nltk_bleu", "exact_match"]) + ") z")
def s10_s3_scores_tsv(spark: SparkSession, sf: str) -> DataFrame:
    metrics = ["nltk_bleu", "exact_match"]
    s = dg_scored(spark, sf, metrics).select("row_id", "model", "dataset", *metrics)
    path = IO.scratch_dir(spark, "scores")
    IO.write_tsv(s, path)
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("model", T.StringType()),
                           T.StructField("dataset", T.StringType())]
                          + [T.StructField(m, T.DoubleType()) for m in metrics])
    back = IO.read_tsv(spark, path, schema)
    return back.select("row_id", "model", "dataset", *[r6(m).alias(m) for m in metrics])


@query("s1_dictionary_csv", with_views(
    "select m.split, m.gloss, l.target, l.example from members m join look l on l.gloss = m.gloss", extra=_E2_CTES))
def s1_dictionary_csv(spark: SparkSession, sf: str) -> DataFrame:
    dictionary, members = _dictionary(spark, sf)
    path = IO.scratch_dir(spark, "dict")
    ordered = dictionary.repartitionByRange("line_no").sortWithinPartitions("line_no")
    ordered.select("word", "gloss", "example").write.options(header=True, quote='"', escape='"').csv(path)
    back = SR.read_csv_records(spark, path, IO.DICTIONARY)
    look = back.groupBy("gloss").agg(F.max_by(F.struct(F.col("word").alias("target"), "example"), "_order").alias("x"))
    return members.join(look, "gloss").select("split", "gloss", "x.target", "x.example")


_MEMBER = T.StructType([T.StructField("line_no", T.LongType()), T.StructField("gloss", T.StringType()),
                        T.StructField("note", T.StructType([T.StructField("source", T.StringType())]))])


@query("s4_json_array", "select row_number() over (order by doc_id) - 1 as place, doc_id as line_no, text as gloss, "
       "source from documents")
def s4_json_array(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as an object of JSON arrays (one a part file), read back over splits in exact order."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("line_no"), F.col("text").alias("gloss"), F.struct("source").alias("note"))
    path = IO.scratch_dir(spark, "arrays")
    SR.write_json_arrays(d.withColumn("_at", F.col("line_no")), path, "_at")
    back = SR.read_json_records(spark, path, _MEMBER)
    places = running_totals(back.select("_order", F.lit(1).cast("long").alias("one")), [], "_order", {"place": "one"})
    return back.join(places, "_order").select("place", "line_no", "gloss", "note.source")


@query("s2_sense_lines", with_views(
    "select line_no, case when rejected then null else split_part(sense, '%', 1) end as target, "
    "case when rejected then null else gloss end as gloss, rejected from ("
    "select row_number() over (order by doc_id) - 1 as line_no, lang || '%' || doc_id as sense, doc_id % 17 = 0 as rejected, "
    f"{_NL.format(c='replace(text, chr(9), chr(32))')} as gloss from documents) d"))
def s2_sense_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    g = _flat(F.translate(F.col("text"), "\t", " "))
    cols = [F.concat(F.col("lang"), F.lit("%"), F.col("doc_id").cast("string")), F.lit("x"), F.lit("y"), g,
            F.lit("z"), F.lit("w")]
    # every 17th physical line carries a stray extra field: pandas skips it with a warning
    line = F.when(F.col("doc_id") % 17 == 0, F.concat_ws("\t", *cols, F.lit("extra"))).otherwise(F.concat_ws("\t", *cols))
    path = IO.scratch_dir(spark, "tsv")
    IO.write_lines(d.select("doc_id", line.alias("value")), path, "doc_id")
    ok, bad = IO.read_tsv_lines(spark, path, IO.SENSE_LINE, per_file=False)
    rows = ok.select("line_no", F.substring_index("sense", "%", 1).alias("target"), "gloss", F.lit(False).alias("rejected"))
    rej = bad.select("line_no", F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("gloss"),
                     F.lit(True).alias("rejected"))
    return rows.unionByName(rej)


@query("s12_append_results", with_views(
    "select sbert, model, accuracy from (select 'enc-a' as sbert union all select 'enc-b') s, "
    "(select b.model, round(ta.accuracy + 1e-12, 3) as accuracy from best b join ta on ta.model = b.model) r",
    "v_wic", extra=_WIC))
def s12_append_results(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import pairs as PR
    dev, test = _wic(spark, sf)
    r = PR.evaluate_wic(dev, test).select("model", F.round(F.col("accuracy") + F.lit(1e-12), 3).alias("accuracy"))
    path = IO.scratch_dir(spark, "results")
    for enc in ("enc-a", "enc-b"):
        IO.append_results(r.select(F.lit(enc).alias("sbert"), "model", "accuracy"), path)
    return spark.read.schema(IO.WIC_RESULT).json(path)
