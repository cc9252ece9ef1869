"""Word-sense induction (E10) and lexical semantic change (E11) evaluation.

The reference loops over runs x targets and handles one target in memory at a time; here the run
keys and the target are columns of one DataFrame, so a single job covers a whole sweep.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import answered, drop_short_tokens, strip_pos
from ..session import written
from . import clusters as C
from . import vectors as V
from .ranks import spearman_columns, with_ranks


def keep_first(usages: DataFrame, keys, order: str = "line_no") -> DataFrame:
    """The first usage (in ``order``) of each gloss per key, across both periods.

    ``min_by`` is a partial + final aggregate, so a gloss repeated in a third of the rows is
    combined before the shuffle."""
    keys = list(keys)
    others = [c for c in usages.columns if c not in keys + ["gloss", order]]
    first = F.min_by(F.struct(F.col(order), *others), F.col(order)).alias("_f")
    return usages.groupBy(*keys, "gloss").agg(first).select(*keys, "gloss", "_f.*")


def attach_vectors(df: DataFrame, vectors: DataFrame) -> DataFrame:
    """One vector per distinct gloss, looked up per usage (AQE picks broadcast or shuffle)."""
    return df.join(vectors.select("gloss", "embedding"), "gloss")


def spread_labels(usages: DataFrame, labels: DataFrame, keys) -> DataFrame:
    """Label found on the distinct gloss, joined back to every usage of that gloss."""
    keys = list(keys)
    return usages.join(labels.select(*keys, "gloss", "label"), keys + ["gloss"])


def clean_usages(usages: DataFrame) -> DataFrame:
    """drop usages the model did not answer."""
    return usages.where(answered("gloss"))


def sense_scores(usages: DataFrame, vectors: DataFrame, keys=("target",), labels: DataFrame | None = None,
                 eps: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per (run keys, target): labelled usages, distinct glosses with labels, and the scores
    PUR, RI, ARI (A6-A8), n_cluster, n_true_cluster (A4), APD (A10) and APDP (A11)."""
    keys = list(keys)
    u = clean_usages(usages)
    firsts = attach_vectors(keep_first(u, keys), vectors)
    if labels is None:
        firsts = written(firsts)  # read by the clustering and once more
        labels = C.density_clusters(firsts, keys, eps=eps, id_col="line_no").join(
            firsts.select(*keys, "line_no", "gloss"), keys + ["line_no"])
    labelled = written(spread_labels(u, labels, keys))  # read by the contingency and the centroids
    gl = firsts.join(labels.select(*keys, "gloss", "label"), keys + ["gloss"])
    part = C.partition_scores(C.contingency(labelled, keys), keys, counts=True)
    apd, apdp = V.shifts(keep_first(u, keys), labelled, vectors, keys)
    scores = part.join(apd, keys, "left").join(apdp, keys, "left")
    return labelled, gl, scores


def evaluate_runs(answers: DataFrame, vectors, gold: DataFrame, run_keys, filters=(1, 2, 3, 4), labels=None,
                  eps: float = 0.7) -> DataFrame:
    """E10 + E11 over a sweep: one record per run (``run_keys`` and ``filter_``), all runs in one job.

    answers: run keys, target, line_no, grouping, cluster, answer. The gloss of a usage is its answer without the
    tokens of ``filter_`` characters or fewer (P10), for each of ``filters``. ``vectors``: a (gloss, embedding) table
    or a function that makes one from the glosses; ``labels``: a function that labels the distinct glosses (run
    keys, target, gloss, line_no), else they are clustered (V3)."""
    keys = [*run_keys, "filter_", "target"]
    length = F.explode(F.array(*[F.lit(k).cast("long") for k in filters]))
    u = answers.select("*", length.alias("filter_")).withColumn("gloss", drop_short_tokens("answer", F.col("filter_")))
    u = written(clean_usages(u).select(*keys, "line_no", "grouping", "cluster", "gloss"))
    table = written(vectors(u.select("gloss").distinct())) if callable(vectors) else vectors
    given = labels(keep_first(u, keys)) if labels else None
    _, _, scores = sense_scores(u, table, keys, given, eps)
    scores = written(scores)
    return run_record(scores, limit_gold(gold, scores.select("target")), [*run_keys, "filter_"])


def limit_gold(gold: DataFrame, targets: DataFrame) -> DataFrame:
    """Gold lemmas, part-of-speech suffixes stripped (P9), limited to known targets."""
    g = gold.withColumn("lemma", strip_pos("lemma"))
    return g.join(targets.select(F.col("target").alias("lemma")).distinct(), "lemma", "left_semi")


def run_record(scores: DataFrame, gold: DataFrame, run_keys=()) -> DataFrame:
    """E10 + E11 record per run: ARI, RI, PUR means over gold lemmas (A3), Spearman of APD and
    APDP with the graded change (A13), cluster counts as arrays in gold order (R4).

    Ranks are windows over one run's lemmas; everything else is a single aggregation per run, so
    the record needs no join at all."""
    run_keys = list(run_keys)
    g = gold.select("lemma", "change_graded", "line_no")
    j = scores.withColumnRenamed("target", "lemma").join(g, "lemma")
    j = with_ranks(j, run_keys, ["change_graded", "APD", "APDP"])
    agg = j.groupBy(*run_keys) if run_keys else j.groupBy()
    return agg.agg(
        F.avg("ARI").alias("ARI"), F.avg("RI").alias("RI"), F.avg("PUR").alias("PUR"),
        F.transform(F.sort_array(F.collect_list(F.struct("line_no", "n_cluster"))), lambda x: x["n_cluster"])
        .alias("n_cluster"),
        F.transform(F.sort_array(F.collect_list(F.struct("line_no", "n_true_cluster"))), lambda x: x["n_true_cluster"])
        .alias("n_true_cluster"),
        *spearman_columns("_r_change_graded", [("_r_APD", "APD"), ("_r_APDP", "APDP")]))
