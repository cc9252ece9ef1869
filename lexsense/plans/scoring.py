"""Queries of the definition-scoring task: E8 and its metrics, A2 summary."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..oracle import dg_sql
from ..operators import metrics as M
from ..operators.summary import summarise_definitions
from .registry import query, r6

ALL = list(M.METRICS)


def _vectors(spark: SparkSession, sf: str):
    """Token vectors for M7, built from the prepared (normalised) tokens of the pairs."""
    def build(prep: DataFrame) -> DataFrame:
        toks = prep.select(F.explode(F.concat("g_tokens", "p_tokens")).alias("token"))
        return fx.token_vectors(spark, sf, toks)
    return build


def scored(spark: SparkSession, sf: str, metrics=ALL) -> DataFrame:
    pairs = fx.pairs(spark, sf)
    vec = _vectors(spark, sf) if "bertscore" in metrics else None
    return M.score_definitions(pairs, metrics, vectors=vec)


def _rounded(df: DataFrame, metrics) -> DataFrame:
    return df.select("row_id", "model", "dataset", "gloss", "answer", *[r6(m).alias(m) for m in metrics])


def _metric_query(name: str, metrics):
    @query(name, dg_sql(metrics))
    def q(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded(scored(spark, sf, metrics), metrics)
    return q


_metric_query("m1_rouge_l", ["rougeL"])
_metric_query("m2_bleu", ["nltk_bleu"])
_metric_query("m3_nist", ["nist"])
_metric_query("m4_sacrebleu", ["sacrebleu"])
_metric_query("m5_meteor", ["meteor"])
_metric_query("m6_exact_match", ["exact_match"])
_metric_query("m7_soft_match", ["bertscore"])
_metric_query("e8_score_definitions", ALL)


@query("a2_summarise_definitions", dg_sql(ALL, summary=True))
def a2_summarise_definitions(spark: SparkSession, sf: str) -> DataFrame:
    s = summarise_definitions(scored(spark, sf, ALL), by=("model", "dataset"), metrics=ALL)
    return s.select("model", "dataset", "n_rows", *[r6(m).alias(m) for m in ALL])


# ---------------------------------------------------------------- M5 with the stem stage

def _suffix_stem(word):
    """A supplied (word, stem) table for the stem stage: a plain suffix rule stands in for the
    stemmer the reference calls (the stage takes any such table)."""
    return F.when(F.length(word) > 4, F.regexp_replace(word, "(ing|ed|es|s)$", "")).otherwise(word)


_STEM_SQL = {
    "st": "select distinct word, case when length(word) > 4 then regexp_replace(word, '(ing|ed|es|s)$', '') "
          "else word end as stem from tp",
    "un": "select t.row_id, t.side, t.pos, coalesce(st.stem, t.word) as stem from tp t left join st on st.word = t.word "
          "where not exists (select 1 from mt where mt.row_id = t.row_id and "
          "((t.side = 'p' and mt.pp = t.pos) or (t.side = 'g' and mt.gp = t.pos)))",
    "rk2": "select *, row_number() over (partition by row_id, side, stem order by pos desc) as rk from un",
    "mts": "select p.row_id, p.pos as pp, g.pos as gp from rk2 p join rk2 g on p.row_id = g.row_id and p.stem = g.stem "
           "and p.rk = g.rk where p.side = 'p' and g.side = 'g'",
    "allm": "select * from mt union all select * from mts",
    "mt2": "select row_id, pp, gp, case when lag(pp) over (partition by row_id order by pp) = pp - 1 "
           "and lag(gp) over (partition by row_id order by pp) = gp - 1 then 0 else 1 end as st from allm",
}


def _stem_sql() -> str:
    from ..oracle import DG_CTES, r6 as q6, with_views
    ctes = {k: DG_CTES[k] for k in ("prep", "tk", "sides", "tp", "rk", "mt")}
    ctes.update({k: v for k, v in _STEM_SQL.items()})
    ctes["me"] = DG_CTES["me"]
    body = f"select tk.row_id, tk.g as gloss, tk.p as answer, {q6('me.meteor')} as meteor from tk join me on me.row_id = tk.row_id"
    return with_views(body, "v_pairs", extra=ctes)


@query("m5_meteor_stems", _stem_sql())
def m5_meteor_stems(spark: SparkSession, sf: str) -> DataFrame:
    pairs = fx.pairs(spark, sf)
    prep = M.prepare(pairs)
    words = M._token_rows(prep).select("word").distinct()
    stems = words.select("word", _suffix_stem(F.col("word")).alias("stem"))
    m = M.meteor(prep, stems)
    return prep.select("row_id", F.col("g").alias("gloss"), F.col("p").alias("answer")).join(m, "row_id").select(
        "row_id", "gloss", "answer", r6("meteor").alias("meteor"))


# ---------------------------------------------------------------- M5 with the synonym stage

def _edge_synsets(word):
    """A supplied (word, synset) table for the synonym stage: words of three letters or more belong to the
    synset of their first two letters and to that of their last two, so that words compete for each other."""
    return F.array(F.concat(F.lit("a:"), F.substring(word, 1, 2)), F.concat(F.lit("z:"), F.right(word, F.lit(2))))


_SYNONYM_CTES = {
    "free": "select t.row_id, t.side, t.pos, t.word from tp t where not exists (select 1 from mt where mt.row_id = t.row_id "
            "and ((t.side = 'p' and mt.pp = t.pos) or (t.side = 'g' and mt.gp = t.pos)))",
    "ss": "select row_id, side, pos, unnest(['a:' || left(word, 2), 'z:' || right(word, 2)]) as synset from free "
          "where length(word) >= 3",
    "cand": "select p.row_id, p.pos as pp, list(distinct g.pos) as gs from ss p join ss g on p.row_id = g.row_id "
            "and p.synset = g.synset where p.side = 'p' and g.side = 'g' group by p.row_id, p.pos",
    "turn": "select *, row_number() over (partition by row_id order by pp desc) as k from cand",
    "chosen(row_id, k, pp, gp, used)":
        "select distinct row_id, 0::bigint, null::bigint, null::bigint, []::bigint[] from turn union all "
        "select row_id, k, pp, gp, case when gp is null then used else list_append(used, gp) end from ("
        "select t.row_id, t.k, t.pp, c.used, list_max(list_filter(t.gs, lambda g: not list_contains(c.used, g))) as gp "
        "from chosen c join turn t on t.row_id = c.row_id and t.k = c.k + 1) x",
    "allm": "select * from mt union all select row_id, pp, gp from chosen where gp is not null",
    "mt2": _STEM_SQL["mt2"],
}


def _synonym_sql() -> str:
    from ..oracle import DG_CTES, r6 as q6, with_views
    ctes = {k: DG_CTES[k] for k in ("prep", "tk", "sides", "tp", "rk", "mt")} | _SYNONYM_CTES | {"me": DG_CTES["me"]}
    body = f"select tk.row_id, tk.g as gloss, tk.p as answer, {q6('me.meteor')} as meteor from tk join me on me.row_id = tk.row_id"
    return with_views(body, "v_pairs", extra=ctes).replace("with ", "with recursive ", 1)


@query("m5_meteor_synonyms", _synonym_sql())
def m5_meteor_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    prep = M.prepare(fx.pairs(spark, sf))
    words = M._token_rows(prep).select("word").distinct().where(F.length("word") >= 3)
    synonyms = words.select("word", F.explode(_edge_synsets(F.col("word"))).alias("synset"))
    m = M.meteor(prep, synonyms=synonyms)
    return prep.select("row_id", F.col("g").alias("gloss"), F.col("p").alias("answer")).join(m, "row_id").select(
        "row_id", "gloss", "answer", r6("meteor").alias("meteor"))
