"""Queries of the sweep summaries (E12) and the pending-work list."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import pairs as PR
from ..operators import runs as RU
from ..operators import summary as SU
from ..oracle import DG_CTES, DG_METRIC_CTES, r6 as q6, with_views
from .registry import query, r6
from .scoring import scored as dg_scored
from .senses import _WIC, _wic

# Display names of the three reported datasets and, below, of the encoder ('SBERT(def.)').
DATASET_NAMES = {"wordnet_test": "WordNet", "oxford_test": "Oxford"}
DATASET_OTHER = "CoDWoe"
SWEEP_DATASETS = ("oxford_test", "en-codwoe_test", "wordnet_test")
# Generator display names (a parameter of the summaries); the fixture's brands stand in for the
# model ids, and the labels are neutral placeholders.
MODEL_NAMES = {"Brand#1": "gen-A", "Brand#2": "gen-B"}
MODEL_OTHER = "gen-C"
KEPT_MODELS = ("Brand#1", "Brand#2", "Brand#3")
ENCODER = "STANDARD"

def _q(c: str) -> str:
    return f'"{c}"'


_PARSE = ("select run_id, parts[1] as model, cast(parts[2] as double) as lora_rank, parts[3] as lora_alpha, "
          "cast(parts[4] as double) as dropout, parts[5] as wd, parts[len(parts) - 1] || '-' || parts[len(parts)] as lr "
          "from (select distinct run_id, string_split(run_id, '-') as parts from v_runs) x")


@query("p19_parse_run_id", with_views(_PARSE, "v_runs"))
def p19_parse_run_id(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.runs(spark, sf).select("run_id").distinct()
    return r.select("run_id", RU.parse_run("run_id").alias("p")).select("run_id", "p.*")


@query("a2_sweep_means", with_views(
    f'select run_id, dataset, {q6("avg(nltk_bleu)")} as nltk_bleu, {q6("avg(" + _q("rougeL") + ")")} '
    f'as "rougeL", {q6("avg(bertscore)")} as bertscore, count(*) as n_rows from v_runs group by run_id, dataset', "v_runs"))
def a2_sweep_means(spark: SparkSession, sf: str) -> DataFrame:
    m = SU.summarise_definitions(fx.runs(spark, sf), by=("run_id", "dataset"), metrics=["nltk_bleu", "rougeL", "bertscore"])
    return m.select("run_id", "dataset", r6("nltk_bleu").alias("nltk_bleu"), r6("rougeL").alias("rougeL"),
                    r6("bertscore").alias("bertscore"), "n_rows")


_SWEEP = {
    "m": "select run_id, dataset, avg(nltk_bleu) as nltk_bleu from v_runs group by run_id, dataset",
    "p": "select string_split(run_id, '-')[1] as model, cast(string_split(run_id, '-')[2] as double) as lora_rank, "
         "dataset, nltk_bleu from m",
    "r": "select model, lora_rank, case dataset when 'wordnet_test' then 'WordNet' when 'oxford_test' then 'Oxford' "
         "else 'CoDWoe' end as \"Datasets\", nltk_bleu from p where dataset in ('oxford_test', 'en-codwoe_test', 'wordnet_test')",
    "x": "select *, dense_rank() over (partition by model order by lora_rank) - 1 as x from r",
}


@query("e12_summarise_sweep", with_views(
    f'select model, x, "Datasets", {q6("avg(nltk_bleu)")} as nltk_bleu, count(*) as n from x group by model, x, "Datasets"',
    "v_runs", extra=_SWEEP))
def e12_summarise_sweep(spark: SparkSession, sf: str, metric: str = "nltk_bleu") -> DataFrame:
    m = SU.summarise_definitions(fx.runs(spark, sf), by=("run_id", "dataset"), metrics=[metric])
    p = m.select(RU.parse_run("run_id").alias("p"), "dataset", metric).select("p.model", "p.lora_rank", "dataset", metric)
    p = p.where(F.col("dataset").isin(*SWEEP_DATASETS))  # F3
    p = p.withColumn("Datasets", RU.recode("dataset", DATASET_NAMES, DATASET_OTHER))  # P18
    # Ordinal of the rank within a model; the table has one row per run x dataset
    p = p.withColumn("x", (F.dense_rank().over(Window.partitionBy("model").orderBy("lora_rank")) - 1).cast("long"))
    s = SU.line_summary(p, ["model", "x", "Datasets"], metric)  # A15
    return s.select("model", "x", "Datasets", r6(metric).alias(metric), "n")


_RES = {
    "rr": "select case when suffix = '' then 150 else cast(suffix as bigint) end as suffix, filter_, "
          "case ft_model_name when 'Brand#1' then 'gen-A' when 'Brand#2' then 'gen-B' else 'gen-C' end "
          "as ft_model_name, model, \"ARI\", \"PUR\", \"RI\", \"APD\", \"APDP\" from v_results",
    "kept": "select * from v_results where ft_model_name in ('Brand#1', 'Brand#2', 'Brand#3') and model = 'STANDARD'",
    "lsc": "select case when suffix = '' then 150 else cast(suffix as bigint) end as suffix, filter_, \"APD\", \"APDP\" from kept",
    "melted": "select case when suffix = '' then 150 else cast(suffix as bigint) end as suffix, filter_, ft_model_name, "
              "\"Metric\", \"Value\" from kept unpivot (\"Value\" for \"Metric\" in (\"ARI\", \"PUR\", \"RI\"))",
}


def _results(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.results(spark, sf)
    return r.withColumn("suffix", RU.suffix_to_int("suffix"))


@query("p18_recode", with_views("select suffix, filter_, ft_model_name from rr", "v_results", extra=_RES))
def p18_recode(spark: SparkSession, sf: str) -> DataFrame:
    r = _results(spark, sf)
    return r.select("suffix", "filter_", RU.recode("ft_model_name", MODEL_NAMES, MODEL_OTHER).alias("ft_model_name"))


def _melted(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.results(spark, sf)
    r = r.where(F.col("ft_model_name").isin(*KEPT_MODELS) & (F.col("model") == ENCODER))  # F3
    r = r.withColumn("suffix", RU.suffix_to_int("suffix"))
    return SU.melt(r, ["suffix", "filter_", "ft_model_name"], ["ARI", "PUR", "RI"])  # R3


@query("r3_melt", with_views(f'select suffix, filter_, ft_model_name, "Metric", {q6(_q("Value"))} as "Value" '
                             "from melted", "v_results", extra=_RES))
def r3_melt(spark: SparkSession, sf: str) -> DataFrame:
    return _melted(spark, sf).select("suffix", "filter_", "ft_model_name", "Metric", r6("Value").alias("Value"))


_BOX = {
    "q": 'select "Metric", quantile_cont("Value", [0.25, 0.5, 0.75]) as qs from melted group by "Metric"',
    "bx": 'select m."Metric", q.qs[1] as q1, q.qs[2] as median, q.qs[3] as q3, m."Value", '
          '(m."Value" >= q.qs[1] - 1.5 * (q.qs[3] - q.qs[1]) and m."Value" <= q.qs[3] + 1.5 * (q.qs[3] - q.qs[1])) as inside '
          'from melted m join q on q."Metric" = m."Metric"',
}


@query("a14_e12_summarise_wsi", with_views(
    f'select "Metric", {q6("q1")} as q1, {q6("median")} as median, {q6("q3")} as q3, '
    f'{q6("min(case when inside then " + _q("Value") + " end)")} as whisker_lo, '
    f'{q6("max(case when inside then " + _q("Value") + " end)")} as whisker_hi, '
    'cast(sum(case when inside then 0 else 1 end) as bigint) as n_outliers, count(*) as n from bx '
    'group by "Metric", q1, median, q3',
    "v_results", extra={**_RES, **_BOX}))
def a14_e12_summarise_wsi(spark: SparkSession, sf: str) -> DataFrame:
    b = SU.box_summary(_melted(spark, sf), ["Metric"], "Value")
    return b.select("Metric", *[r6(c).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                    "n_outliers", "n")


@query("f4_e12_summarise_lsc", with_views(
    f'select 1 as panel, suffix as x, {q6("avg(" + _q("APD") + ")")} as "APD", '
    f'{q6("avg(" + _q("APDP") + ")")} as "APDP", count(*) as n from lsc where filter_ = 1 group by suffix '
    f'union all select 2, filter_, {q6("avg(" + _q("APD") + ")")}, '
    f'{q6("avg(" + _q("APDP") + ")")}, count(*) from lsc where suffix = 100 group by filter_',
    "v_results", extra=_RES))
def f4_e12_summarise_lsc(spark: SparkSession, sf: str) -> DataFrame:
    r = _results(spark, sf)
    r = r.where(F.col("ft_model_name").isin(*KEPT_MODELS) & (F.col("model") == ENCODER))  # F3
    r = r.select("suffix", "filter_", "APD", "APDP")
    by_len = r.where(F.col("filter_") == 1).groupBy(F.col("suffix").alias("x")).agg(
        F.avg("APD").alias("APD"), F.avg("APDP").alias("APDP"), F.count(F.lit(1)).alias("n"))
    by_filter = r.where(F.col("suffix") == 100).groupBy(F.col("filter_").alias("x")).agg(
        F.avg("APD").alias("APD"), F.avg("APDP").alias("APDP"), F.count(F.lit(1)).alias("n"))
    out = by_len.withColumn("panel", F.lit(1)).unionByName(by_filter.withColumn("panel", F.lit(2)))
    return out.select("panel", "x", r6("APD").alias("APD"), r6("APDP").alias("APDP"), "n")


@query("e12_summarise_wic", with_views(
    f"select 'SBERT(def.)' as model, {q6('quantile_cont(accuracy, 0.25)')} as q1, {q6('quantile_cont(accuracy, 0.5)')} as median, "
    f"{q6('quantile_cont(accuracy, 0.75)')} as q3, count(*) as n from ta where model in ('m0', 'm1', 'm2')",
    "v_wic", extra=_WIC))
def e12_summarise_wic(spark: SparkSession, sf: str) -> DataFrame:
    dev, test = _wic(spark, sf)
    kept = ("m0", "m1", "m2")
    acc = PR.evaluate_wic(dev, test).where(F.col("model").isin(*kept))  # F3
    # Every kept generator is drawn as one box (a recode of the column, not a constant,
    # so the box summary's join stays an equi-join)
    acc = acc.withColumn("model", RU.recode("model", {m: "SBERT(def.)" for m in kept}))
    b = SU.box_summary(acc, ["model"], "accuracy")
    return b.select("model", r6("q1").alias("q1"), r6("median").alias("median"), r6("q3").alias("q3"), "n")


_LO, _HI = (1 - 0.95) / 2, 1 - (1 - 0.95) / 2
_CDF = "[" + ", ".join(f"{c!r}::double" for c in SU.POISSON1_CDF) + "]"
_BAND = {
    **{k: DG_CTES[k] for k in ["prep", "tk", *DG_METRIC_CTES["nltk_bleu"][1]]},
    "sc": "select tk.row_id, tk.model, ngs.nltk_bleu as y from tk join ngs on ngs.row_id = tk.row_id",
    "u": "select model, y, b, (('0x' || substr(md5('0:' || row_id || ':' || b), 1, 8))::bigint + 0.5::double) / 4294967296 as u "
         "from sc, range(1, 201) r(b)",
    "w": f"select model, y, b, len(list_filter({_CDF}, lambda c: c <= u)) as w from u",
    "m": "select model, b, sum(w * y) / nullif(sum(w), 0) as m from w group by model, b",
}


@query("a16_bootstrap_band", with_views(
    f"select c.model, {q6('mean')} as mean, {q6('lo')} as ci_lo, {q6('hi')} as ci_hi from "
    "(select model, avg(y) as mean from sc group by model) c join "
    f"(select model, quantile_cont(m, {_LO!r}) as lo, quantile_cont(m, {_HI!r}) as hi from m group by model) d on d.model = c.model",
    "v_pairs", extra=_BAND))
def a16_bootstrap_band(spark: SparkSession, sf: str) -> DataFrame:
    s = dg_scored(spark, sf, ["nltk_bleu"])
    b = SU.bootstrap_band(s.select("model", "row_id", "nltk_bleu"), ["model"], "nltk_bleu", "row_id", replicates=200)
    return b.select("model", r6("mean").alias("mean"), r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"))


_LINE = {
    "k": _RES["kept"],
    "sfx": "select case when suffix = '' then 150 else cast(suffix as bigint) end as x, row_key, \"APD\" as y from k",
    "u": "select x, y, b, (('0x' || substr(md5('0:' || row_key || ':' || b), 1, 8))::bigint + 0.5::double) / 4294967296 as u "
         "from sfx, range(1, 101) r(b)",
    "w": f"select x, y, b, len(list_filter({_CDF}, lambda c: c <= u)) as w from u",
    "m": "select x, b, sum(w * y) / nullif(sum(w), 0) as m from w group by x, b",
}


@query("a15_line_band", with_views(
    f"select c.x, {q6('mean')} as \"APD\", n, {q6('lo')} as ci_lo, {q6('hi')} as ci_hi from "
    "(select x, avg(y) as mean, count(*) as n from sfx group by x) c join "
    f"(select x, quantile_cont(m, {_LO!r}) as lo, quantile_cont(m, {_HI!r}) as hi from m group by x) d on d.x = c.x",
    "v_results", extra=_LINE))
def a15_line_band(spark: SparkSession, sf: str) -> DataFrame:
    """The line of mean APD over context lengths with its bootstrap band."""
    r = _results(spark, sf).where(F.col("ft_model_name").isin(*KEPT_MODELS) & (F.col("model") == ENCODER))
    s = SU.line_summary(r.select(F.col("suffix").alias("x"), "row_key", "APD"), ["x"], "APD", replicates=100, row_key="row_key")
    return s.select("x", r6("APD").alias("APD"), "n", r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"))


@query("j12_e13_pending_runs", with_views(
    "select distinct model, dataset from v_pairs except "
    "select distinct model, dataset from v_pairs where ((row_id // 4294967296) % 4 + (row_id // 4294967296) % 5) % 3 = 0",
    "v_pairs"))
def j12_e13_pending_runs(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.pairs(spark, sf)
    conv = F.floor(F.col("row_id") / fx.TURNS)
    done = p.where(((conv % 4 + conv % 5) % 3) == 0)
    return RU.pending_runs(p, done)
