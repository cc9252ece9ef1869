"""Queries of the WiC (E9), WSI (E10) and LSC (E11) evaluations over vector tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import clusters as C
from ..operators import pairs as PR
from ..operators import senses as SE
from ..operators import vectors as V
from ..operators.ranks import spearman_columns, with_ranks
from ..oracle import r6 as q6, with_views
from ..session import table
from .prepare import q_split
from .registry import query, r6


def _q(c: str) -> str:
    return f'"{c}"'


# ---------------------------------------------------------------- WiC: R2, V1, W1, W2, A12, E9

_WIC = {
    "sims": "select pair_id, model, part, label, list_cosine_similarity(cast(e1 as double[]), cast(e2 as double[])) as sim "
            "from v_wic",
    "dev": "select * from sims where part = 'dev'",
    "test": "select * from sims where part = 'test'",
    "cand": "select distinct model, sim as thr from dev union select distinct model, 'inf'::double from dev",
    "acc": "select c.model, c.thr, avg((((d.sim >= c.thr)::int) = d.label)::double) as acc "
           "from cand c join dev d on d.model = c.model group by c.model, c.thr",
    "best": "select model, thr as threshold, acc as dev_accuracy from (select *, row_number() over "
            "(partition by model order by acc desc, thr desc) as rn from acc) x where rn = 1",
    "ta": "select t.model, avg((((t.sim >= b.threshold)::int) = t.label)::double) as accuracy "
          "from test t join best b on b.model = t.model group by t.model",
}


def _wic(spark: SparkSession, sf: str):
    s = PR.pair_similarity(fx.wic(spark, sf))
    return s.where(F.col("part") == "dev"), s.where(F.col("part") == "test")


@query("r2_pair_adjacent", with_views(
    f"select a.vec_id // 2 as pair_id, {q6('list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[]))')} as sim "
    "from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 and a.vec_id % 2 = 0"))
def r2_pair_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("line_no"), "embedding")
    p = PR.pair_adjacent(e, "line_no", ("embedding",))
    return p.select("pair_id", r6(V.cosine("embedding1", "embedding2")).alias("sim"))


@query("v1_pair_cosine", with_views(f"select pair_id, model, part, label, {q6('sim')} as sim from sims",
                                    "v_wic", extra={"sims": _WIC["sims"]}))
def v1_pair_cosine(spark: SparkSession, sf: str) -> DataFrame:
    s = PR.pair_similarity(fx.wic(spark, sf))
    return s.select("pair_id", "model", "part", "label", r6("sim").alias("sim"))


@query("w1_best_threshold", with_views(
    f"select model, {q6('threshold')} as threshold, {q6('dev_accuracy')} as dev_accuracy from best",
    "v_wic", extra={k: _WIC[k] for k in ("sims", "dev", "cand", "acc", "best")}))
def w1_best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    dev, _ = _wic(spark, sf)
    t = PR.best_threshold(dev)
    return t.select("model", r6("threshold").alias("threshold"), r6("dev_accuracy").alias("dev_accuracy"))


@query("w2_apply_threshold", with_views(
    "select t.pair_id, t.model, (t.sim >= b.threshold)::int as pred from test t join best b on b.model = t.model",
    "v_wic", extra={k: _WIC[k] for k in ("sims", "dev", "test", "cand", "acc", "best")}))
def w2_apply_threshold(spark: SparkSession, sf: str) -> DataFrame:
    dev, test = _wic(spark, sf)
    return PR.apply_threshold(test, PR.best_threshold(dev)).select("pair_id", "model", "pred")


@query("e9_evaluate_wic", with_views(
    f"select b.model, {q6('b.threshold')} as threshold, {q6('b.dev_accuracy')} as dev_accuracy, "
    f"{q6('ta.accuracy')} as accuracy from best b join ta on ta.model = b.model",
    "v_wic", extra=_WIC))
def e9_evaluate_wic(spark: SparkSession, sf: str) -> DataFrame:
    dev, test = _wic(spark, sf)
    r = PR.evaluate_wic(dev, test)
    return r.select("model", r6("threshold").alias("threshold"), r6("dev_accuracy").alias("dev_accuracy"),
                    r6("accuracy").alias("accuracy"))


# ---------------------------------------------------------------- WSI / LSC over v_usages

_U = {
    "u": "select * from v_usages where gloss <> '' and not starts_with(gloss, 'Please provide')",
    "firsts": 'select target, gloss, min(line_no) as line_no, arg_min("grouping", line_no) as "grouping", '
              "arg_min(embedding, line_no) as embedding from u group by target, gloss",
    "lab": "select target, gloss, line_no // 24 % 5 as label from firsts",
    "labelled": 'select u.target, u.line_no, u."grouping", u.cluster, u.gloss, u.embedding, l.label '
                "from u join lab l on l.target = u.target and l.gloss = u.gloss",
    "cont": "select target, cluster, label, count(*) as n from labelled group by target, cluster, label",
    "s": "select target, sum(n) as n, sum(n::double * (n - 1) / 2) as S from cont group by target",
    "sa": "select target, sum(a::double * (a - 1) / 2) as Sa from "
          "(select target, cluster, sum(n) as a from cont group by target, cluster) x group by target",
    "sb": "select target, sum(b::double * (b - 1) / 2) as Sb, sum(top) as top from "
          "(select target, label, sum(n) as b, max(n) as top from cont group by target, label) x group by target",
    "ps": """select s.target, top / n as "PUR",
  case when n::double * (n - 1) / 2 = 0 then 1.0 else (n::double * (n - 1) / 2 + 2 * S - Sa - Sb) / (n::double * (n - 1) / 2) end as "RI",
  case when Sa = S and Sb = S then 1.0 else (S - Sa * Sb / (n::double * (n - 1) / 2))
       / ((Sa + Sb) / 2 - Sa * Sb / (n::double * (n - 1) / 2)) end as "ARI"
from s join sa on sa.target = s.target join sb on sb.target = s.target""",
    "cc": "select a.target, a.n_cluster, b.n_true_cluster from "
          "(select f.target, count(distinct l.label) as n_cluster from firsts f join lab l on l.target = f.target "
          "and l.gloss = f.gloss group by f.target) a join "
          "(select target, count(distinct cluster) as n_true_cluster from labelled group by target) b on b.target = a.target",
    "apd": 'select t.target, x."APD" from (select distinct target from u) t left join '
           '(select a.target, avg(1 - list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[]))) as "APD" '
           'from firsts a join firsts b on a.target = b.target and a."grouping" = 1 and b."grouping" = 2 group by a.target) x '
           "on x.target = t.target",
    "dims": 'select target, "grouping", label, d, avg(x) as m from (select target, "grouping", label, '
            "generate_subscripts(embedding, 1) as d, unnest(cast(embedding as double[])) as x from labelled) y "
            'group by target, "grouping", label, d',
    "cent": 'select target, "grouping", label, list(m order by d) as c from dims group by target, "grouping", label',
    "apdp": 'select t.target, x."APDP" from (select distinct target from u) t left join '
            '(select a.target, avg(list_sum(list_transform(range(1, len(a.c) + 1), lambda i: case when abs(a.c[i]) + abs(b.c[i]) = 0 '
            'then 0.0 else abs(a.c[i] - b.c[i]) / (abs(a.c[i]) + abs(b.c[i])) end))) as "APDP" '
            'from cent a join cent b on a.target = b.target and a."grouping" = 1 and b."grouping" = 2 group by a.target) x '
            "on x.target = t.target",
    "scores": 'select ps.target, ps."PUR", ps."RI", ps."ARI", cc.n_cluster, cc.n_true_cluster, apd."APD", apdp."APDP" '
              "from ps join cc on cc.target = ps.target join apd on apd.target = ps.target join apdp on apdp.target = ps.target",
}
_GOLD = {
    "gold": "select lemma, change_graded, cast(substring(lemma, 2) as bigint) as line_no from v_gold "
            "where lemma in (select target from u)",
    "j": "select s.*, g.change_graded, g.line_no from scores s join gold g on g.lemma = s.target",
    "rk": 'select *, rank() over (order by change_graded) + (count(*) over (partition by change_graded) - 1) / 2.0 as r_gold, '
          'rank() over (order by "APD") + (count(*) over (partition by "APD") - 1) / 2.0 as r_apd, '
          'rank() over (order by "APDP") + (count(*) over (partition by "APDP") - 1) / 2.0 as r_apdp from j',
}


def _given_labels(firsts: DataFrame) -> DataFrame:
    return firsts.select("target", "gloss", (F.floor(F.col("line_no") / 24) % 5).alias("label"))


def _usage_parts(spark: SparkSession, sf: str):
    u = SE.clean_usages(fx.usages(spark, sf)).drop("embedding")
    return u, fx.gloss_vectors(spark, sf), SE.keep_first(u, ["target"])


@query("d2_keep_first", with_views('select target, gloss, line_no, "grouping" from firsts', "v_usages",
                                   extra={k: _U[k] for k in ("u", "firsts")}))
def d2_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    _, _, firsts = _usage_parts(spark, sf)
    return firsts.select("target", "gloss", "line_no", "grouping")


@query("j8_label_spread", with_views("select line_no, label from labelled", "v_usages",
                                     extra={k: _U[k] for k in ("u", "firsts", "lab", "labelled")}))
def j8_label_spread(spark: SparkSession, sf: str) -> DataFrame:
    u, _, firsts = _usage_parts(spark, sf)
    return SE.spread_labels(u, _given_labels(firsts), ["target"]).select("line_no", "label")


@query("a5_contingency", with_views("select target, cluster, label, n from cont", "v_usages",
                                    extra={k: _U[k] for k in ("u", "firsts", "lab", "labelled", "cont")}))
def a5_contingency(spark: SparkSession, sf: str) -> DataFrame:
    u, _, firsts = _usage_parts(spark, sf)
    return C.contingency(SE.spread_labels(u, _given_labels(firsts), ["target"]), ["target"])


@query("a6_a8_partition_scores", with_views(
    f'select target, {q6(_q("PUR"))} as "PUR", {q6(_q("RI"))} as "RI", '
    f'{q6(_q("ARI"))} as "ARI" from ps', "v_usages",
    extra={k: _U[k] for k in ("u", "firsts", "lab", "labelled", "cont", "s", "sa", "sb", "ps")}))
def a6_a8_partition_scores(spark: SparkSession, sf: str) -> DataFrame:
    u, _, firsts = _usage_parts(spark, sf)
    p = C.partition_scores(C.contingency(SE.spread_labels(u, _given_labels(firsts), ["target"]), ["target"]), ["target"])
    return p.select("target", r6("PUR").alias("PUR"), r6("RI").alias("RI"), r6("ARI").alias("ARI"))


@query("a4_cluster_counts", with_views("select target, n_cluster, n_true_cluster from cc", "v_usages",
                                       extra={k: _U[k] for k in ("u", "firsts", "lab", "labelled", "cc")}))
def a4_cluster_counts(spark: SparkSession, sf: str) -> DataFrame:
    u, _, firsts = _usage_parts(spark, sf)
    lab = _given_labels(firsts)
    labelled = SE.spread_labels(u, lab, ["target"])
    gl = firsts.join(lab, ["target", "gloss"])
    return C.cluster_counts(labelled, gl, ["target"]).select("target", "n_cluster", "n_true_cluster")


@query("a9_centroids", with_views(
    'select target, "grouping", label, list_transform(c, lambda x: round(x + 1e-12, 6) + 0.0) as centroid from cent', "v_usages",
    extra={k: _U[k] for k in ("u", "firsts", "lab", "labelled", "dims", "cent")}))
def a9_centroids(spark: SparkSession, sf: str) -> DataFrame:
    u, vectors, firsts = _usage_parts(spark, sf)
    lv = SE.attach_vectors(SE.spread_labels(u, _given_labels(firsts), ["target"]), vectors)
    c = V.centroids(lv, ["target", "grouping", "label"])
    return c.select("target", "grouping", "label",
                    F.transform("centroid", lambda x: F.round(x + F.lit(1e-12), 6) + F.lit(0.0)).alias("centroid"))


@query("a10_apd", with_views(f'select target, {q6(_q("APD"))} as "APD" from apd', "v_usages",
                             extra={k: _U[k] for k in ("u", "firsts", "apd")}))
def a10_apd(spark: SparkSession, sf: str) -> DataFrame:
    _, vectors, firsts = _usage_parts(spark, sf)
    a = V.mean_shift(SE.attach_vectors(firsts, vectors), ["target"])
    return a.select("target", r6("APD").alias("APD"))


@query("a11_apdp", with_views(f'select target, {q6(_q("APDP"))} as "APDP" from apdp', "v_usages",
                              extra={k: _U[k] for k in ("u", "firsts", "lab", "labelled", "dims", "cent", "apdp")}))
def a11_apdp(spark: SparkSession, sf: str) -> DataFrame:
    u, vectors, firsts = _usage_parts(spark, sf)
    lv = SE.attach_vectors(SE.spread_labels(u, _given_labels(firsts), ["target"]), vectors)
    return V.centroid_shift(lv, ["target"]).select("target", r6("APDP").alias("APDP"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    u, vectors, firsts = _usage_parts(spark, sf)
    _, _, scores = SE.sense_scores(u, vectors, ["target"], labels=_given_labels(firsts))
    return scores


def _gold(spark: SparkSession, sf: str, targets: DataFrame) -> DataFrame:
    g = fx.gold(spark, sf).withColumn("line_no", F.expr("substring(lemma, 2)").cast("long"))
    return SE.limit_gold(g, targets)


@query("j7_gold_semi", with_views("select lemma, change_graded from gold", "v_usages", "v_gold",
                                  extra={"u": _U["u"], "gold": _GOLD["gold"]}))
def j7_gold_semi(spark: SparkSession, sf: str) -> DataFrame:
    u, _, _ = _usage_parts(spark, sf)
    return _gold(spark, sf, u.select("target")).select("lemma", "change_graded")


@query("w3_average_rank", with_views(
    'select target, r_gold, r_apd from rk', "v_usages", "v_gold", extra={**_U, **_GOLD}))
def w3_average_rank(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf)
    g = _gold(spark, sf, s.select("target"))
    j = s.join(g.withColumnRenamed("lemma", "target"), "target")
    r = with_ranks(j, [], ["change_graded", "APD"])
    return r.select("target", F.col("_r_change_graded").alias("r_gold"), F.col("_r_APD").alias("r_apd"))


_RUN_BODY = f"""select {q6('avg("ARI")')} as "ARI", {q6('avg("RI")')} as "RI", {q6('avg("PUR")')} as "PUR",
  list(n_cluster order by line_no) as n_cluster, list(n_true_cluster order by line_no) as n_true_cluster,
  {q6('corr(r_gold, r_apd)')} as "APD", {q6('corr(r_gold, r_apdp)')} as "APDP" from rk"""


@query("e10_e11_evaluate_senses_change", with_views(_RUN_BODY, "v_usages", "v_gold", extra={**_U, **_GOLD}))
def e10_e11_evaluate_senses_change(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf)
    rec = SE.run_record(s, _gold(spark, sf, s.select("target")))
    return rec.select(r6("ARI").alias("ARI"), r6("RI").alias("RI"), r6("PUR").alias("PUR"),
                      "n_cluster", "n_true_cluster", r6("APD").alias("APD"), r6("APDP").alias("APDP"))


@query("a13_spearman", with_views(
    f'select {q6("corr(r_gold, r_apd)")} as "APD", {q6("corr(r_gold, r_apdp)")} as "APDP" from rk',
    "v_usages", "v_gold", extra={**_U, **_GOLD}))
def a13_spearman(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf)
    g = _gold(spark, sf, s.select("target"))
    j = s.join(g.withColumnRenamed("lemma", "target"), "target")
    r = with_ranks(j, [], ["change_graded", "APD", "APDP"])
    out = r.groupBy().agg(*spearman_columns("_r_change_graded", [("_r_APD", "APD"), ("_r_APDP", "APDP")]))
    return out.select(r6("APD").alias("APD"), r6("APDP").alias("APDP"))


# ---------------------------------------------------------------- V3 density clustering

_V3_SQL = """with recursive
u as (select 't' || (vec_id // 512 * 8 + vec_id % 8) as target, vec_id as id,
             list_transform(embedding, lambda x: x::double) as v from embeddings),
d as (select a.target, a.id as i, b.id as j,
             case when a.id = b.id then 0 else 1 - list_cosine_similarity(a.v, b.v) end as dist
      from u a join u b on a.target = b.target),
core as (select i, dist as cd from (select *, row_number() over (partition by target, i order by dist, j) as rn from d)
         where rn = 2),
e as (select d.i, d.j from d join core x on x.i = d.i join core y on y.i = d.j
      where greatest(d.dist, x.cd, y.cd) <= 0.7),
r(i, j) as (select i, j from e union select r.i, e.j from r join e on e.i = r.j),
lab as (select i, min(j) as l from r group by i)
select u.target, u.id, coalesce(lab.l, -1) as label from u left join lab on lab.i = u.id"""


@query("v3_density_clusters", _V3_SQL)
def v3_density_clusters(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(
        fx.vector_target(F.col("vec_id")).alias("target"), F.col("vec_id").alias("id"), "embedding")
    return C.density_clusters(e, ["target"], eps=0.7).select("target", "id", "label")


@query("v3_density_clusters_k3", _V3_SQL.replace("where rn = 2", "where rn = 3"))
def v3_density_clusters_k3(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(
        fx.vector_target(F.col("vec_id")).alias("target"), F.col("vec_id").alias("id"), "embedding")
    return C.density_clusters(e, ["target"], eps=0.7, k=3).select("target", "id", "label")


# ---------------------------------------------------------------- E10 + E11 with clustering (V3 labels)

_CLUSTER_CTES = {
    "fu": "select target, line_no as id, list_transform(embedding, lambda x: x::double) as v from firsts",
    "d": "select a.target, a.id as i, b.id as j, case when a.id = b.id then 0 else 1 - list_cosine_similarity(a.v, b.v) end "
         "as dist from fu a join fu b on a.target = b.target",
    "core": "select i, dist as cd from (select *, row_number() over (partition by target, i order by dist, j) as rn from d) x "
            "where rn = 2",
    "e": "select d.i, d.j from d join core x on x.i = d.i join core y on y.i = d.j where greatest(d.dist, x.cd, y.cd) <= 0.7",
    "r(i, j)": "select i, j from e union select r.i, e.j from r join e on e.i = r.j",
    "lab0": "select i, min(j) as l from r group by i",
    "lab": "select f.target, f.gloss, coalesce(lab0.l, -1) as label from firsts f left join lab0 on lab0.i = f.line_no",
}


def _clustered_sql() -> str:
    from ..oracle import VIEWS
    parts = [f"v_usages as ({VIEWS['v_usages']}\n)", f"v_gold as ({VIEWS['v_gold']}\n)",
             f"u as ({_U['u']})", f"firsts as ({_U['firsts']})"]
    parts += [f"{k} as ({v})" for k, v in _CLUSTER_CTES.items()]
    parts += [f"{k} as ({v})" for k, v in _U.items() if k not in ("u", "firsts", "lab")]
    parts += [f"{k} as ({v})" for k, v in _GOLD.items()]
    return "with recursive " + ",\n".join(parts) + "\n" + _RUN_BODY


@query("e10_e11_with_clusters", _clustered_sql())
def e10_e11_with_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """E10 + E11 as the reference runs them: the de-duplicated glosses of each target are
    clustered (V3), labels are spread to every usage (J8), then scored."""
    u, vectors, _ = _usage_parts(spark, sf)
    _, _, scores = SE.sense_scores(u, vectors, ["target"], labels=None, eps=0.7)
    rec = SE.run_record(scores, _gold(spark, sf, scores.select("target")))
    return rec.select(r6("ARI").alias("ARI"), r6("RI").alias("RI"), r6("PUR").alias("PUR"),
                      "n_cluster", "n_true_cluster", r6("APD").alias("APD"), r6("APDP").alias("APDP"))


# ---------------------------------------------------------------- E10 + E11 over a sweep of runs

_KEYS = "suffix, model_folder, ft_model_name, filter_"
_RK = f"{_KEYS}, target"


def _on(a: str, b: str, keys: str = _RK) -> str:
    return " and ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))


_VEC = "(select count(*) from embeddings)"
_HASH = "('0x' || substr(md5({x}), 1, 8))::bigint"
_SWEEP_RUNS = {
    "g": f"select {_KEYS}, target, line_no, \"grouping\", cluster, array_to_string(list_filter({q_split('answer')}, "
         "lambda t: length(t) > filter_), ' ') as gloss from v_answers, (values (1::bigint), (2), (3), (4)) f(filter_)",
    "u": "select * from g where gloss <> '' and not starts_with(gloss, 'Please provide')",
    "firsts": f"select x.*, cast(e.embedding as double[]) as v from (select {_RK}, gloss, min(line_no) as line_no, "
              f'arg_min("grouping", line_no) as "grouping" from u group by {_RK}, gloss) x '
              f"join embeddings e on e.vec_id = {_HASH.format(x='gloss')} % {_VEC}",
    "labelled": f"select u.*, f.v, {_HASH.format(x='u.gloss')} % 5 as label from u join firsts f on {_on('u', 'f')} and u.gloss = f.gloss",
    "cont": f"select {_RK}, cluster, label, count(*) as n from labelled group by {_RK}, cluster, label",
    "s": f"select {_RK}, sum(n) as n, sum(n::double * (n - 1) / 2) as S from cont group by {_RK}",
    "sa": f"select {_RK}, sum(a::double * (a - 1) / 2) as Sa, count(*) as n_true_cluster from "
          f"(select {_RK}, cluster, sum(n) as a from cont group by {_RK}, cluster) x group by {_RK}",
    "sb": f"select {_RK}, sum(b::double * (b - 1) / 2) as Sb, sum(top) as top, count(*) as n_cluster from "
          f"(select {_RK}, label, sum(n) as b, max(n) as top from cont group by {_RK}, label) x group by {_RK}",
    "ps": f"""select s.*, n_cluster, n_true_cluster, top / n as "PUR",
  case when n::double * (n - 1) / 2 = 0 then 1.0 else (n::double * (n - 1) / 2 + 2 * S - Sa - Sb) / (n::double * (n - 1) / 2) end as "RI",
  case when Sa = S and Sb = S then 1.0 else (S - Sa * Sb / (n::double * (n - 1) / 2))
       / ((Sa + Sb) / 2 - Sa * Sb / (n::double * (n - 1) / 2)) end as "ARI"
from s join sa on {_on('s', 'sa')} join sb on {_on('s', 'sb')}""",
    "apd": f'select {", ".join("a." + k.strip() for k in _RK.split(","))}, avg(1 - list_cosine_similarity(a.v, b.v)) as "APD" from firsts a '
           f'join firsts b on {_on("a", "b")} and a."grouping" = 1 and b."grouping" = 2 group by all',
    "dims": f'select {_RK}, "grouping", label, d, avg(x) as m from (select {_RK}, "grouping", label, '
            f"generate_subscripts(v, 1) as d, unnest(v) as x from labelled) y group by all",
    "cent": f'select {_RK}, "grouping", label, list(m order by d) as c from dims group by {_RK}, "grouping", label',
    "apdp": f'select {", ".join("a." + k.strip() for k in _RK.split(","))}, avg(list_sum(list_transform(range(1, len(a.c) + 1), '
            'lambda i: case when abs(a.c[i]) + abs(b.c[i]) = 0 then 0.0 else abs(a.c[i] - b.c[i]) / (abs(a.c[i]) + abs(b.c[i])) end))) '
            f'as "APDP" from cent a join cent b on {_on("a", "b")} and a."grouping" = 1 and b."grouping" = 2 group by all',
    "j": f'select ps.*, apd."APD", apdp."APDP", gold.change_graded, cast(substring(gold.lemma, 2) as bigint) as line_no from ps '
         f"join v_gold gold on gold.lemma = ps.target left join apd on {_on('ps', 'apd')} left join apdp on {_on('ps', 'apdp')}",
    "rk": "select *, " + ", ".join(
        f'rank() over (partition by {_KEYS} order by {c} nulls first) + (count(*) over (partition by {_KEYS}, {c}) - 1) / 2.0 as {r}'
        for c, r in (("change_graded", "r_gold"), ('"APD"', "r_apd"), ('"APDP"', "r_apdp"))) + " from j",
}


@query("e10_e11_sweep", with_views(
    f"select {_KEYS}, 'enc-a' as model, " + _RUN_BODY[len("select "):] + f" group by {_KEYS}", "v_answers", "v_gold", extra=_SWEEP_RUNS))
def e10_e11_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """One record for every context length, folder, model and answer filter, in one job."""
    keys = ["suffix", "model_folder", "ft_model_name", "model"]
    a = fx.answers(spark, sf).withColumn("model", F.lit("enc-a"))
    label = (F.conv(F.substring(F.md5("gloss"), 1, 8), 16, 10).cast("long") % 5).alias("label")
    g = fx.gold(spark, sf).withColumn("line_no", F.expr("substring(lemma, 2)").cast("long"))
    rec = SE.evaluate_runs(a, lambda glosses: fx.text_vectors(spark, sf, glosses, "gloss"), g, keys,
                           labels=lambda firsts: firsts.select(*keys, "filter_", "target", "gloss", label))
    return rec.select(*keys, "filter_", r6("ARI").alias("ARI"), r6("RI").alias("RI"), r6("PUR").alias("PUR"),
                      "n_cluster", "n_true_cluster", r6("APD").alias("APD"), r6("APDP").alias("APDP"))


# ---------------------------------------------------------------- E9 from answers

_WIC_RUNS = {
    "a": f"select model, part, line_no, array_to_string(list_filter({q_split('answer')}, lambda t: strpos(';.,()', t) = 0), ' ') as text "
         "from v_wic_answers",
    "av": f"select a.*, cast(e.embedding as double[]) as v from a join embeddings e on e.vec_id = {_HASH.format(x='text')} % {_VEC}",
    "sims": "select a.model, a.part, a.line_no // 2 as pair_id, list_cosine_similarity(a.v, b.v) as sim, "
            "(trim(g.gold) = 'T')::int as label from av a join av b on b.model = a.model and b.part = a.part and b.line_no = a.line_no + 1 "
            "join v_wic_gold g on g.pair_id = a.line_no // 2 where a.line_no % 2 = 0",
}


@query("e9_answers_sweep", with_views(
    f"select 'enc-a' as sbert, b.model, {q6('b.threshold')} as threshold, {q6('b.dev_accuracy')} as dev_accuracy, "
    f"{q6('ta.accuracy')} as accuracy from best b join ta on ta.model = b.model",
    "v_wic_answers", "v_wic_gold", extra=_WIC_RUNS | {k: v for k, v in _WIC.items() if k != "sims"}))
def e9_answers_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """E9 from the answer and gold lines on: one record for every encoder and generator."""
    a = fx.wic_answers(spark, sf).withColumn("sbert", F.lit("enc-a"))
    r = PR.evaluate_wic_answers(a, fx.wic_gold(spark, sf), lambda texts: fx.text_vectors(spark, sf, texts, "text"), ["sbert", "model"])
    return r.select("sbert", "model", r6("threshold").alias("threshold"), r6("dev_accuracy").alias("dev_accuracy"), r6("accuracy").alias("accuracy"))
