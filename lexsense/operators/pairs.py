"""WiC operators: adjacent-row pairing (R2), pair similarity (V1), threshold sweep (W1),
threshold application (W2) and accuracy (A12)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import drop_punct_tokens, label_true
from ..session import written
from .prefix import running_totals
from .vectors import cosine

def pair_adjacent(df: DataFrame, line: str = "line_no", cols=("embedding",), by=()) -> DataFrame:
    """R2: rows 2i and 2i+1 (file order) become pair i; an odd tail row is dropped."""
    by = list(by)
    g = df.select(*by, F.floor(F.col(line) / 2).alias("pair_id"), (F.col(line) % 2).alias("_pos"), *cols)
    aggs = []
    for c in cols:
        aggs.append(F.max_by(F.col(c), F.when(F.col("_pos") == 0, 1).otherwise(0)).alias(f"{c}1"))
        aggs.append(F.max_by(F.col(c), F.when(F.col("_pos") == 1, 1).otherwise(0)).alias(f"{c}2"))
    return g.groupBy(*by, "pair_id").agg(F.count("*").alias("_n"), *aggs).where(F.col("_n") == 2).drop("_n")


def pair_similarity(pairs: DataFrame, a: str = "e1", b: str = "e2", out: str = "sim") -> DataFrame:
    """V1: cosine of the two vectors of each pair (the reference reads it off an n x n matrix)."""
    return pairs.withColumn(out, cosine(a, b))


def best_threshold(scored: DataFrame, by=("model",), score: str = "sim", label: str = "label") -> DataFrame:
    """For every distinct score (and +inf) the accuracy of ``score >= thr``; the best one,
    ties to the highest threshold. One sort instead of the reference's thresholds x rows loop.

    Equal scores are pre-aggregated (a hot score is one row); the counts of rows at and above a score
    are running totals in descending score order (``running_totals``), over ranges of equal row counts.
    """
    by = list(by)
    if not by:
        raise ValueError("best_threshold needs the group columns (e.g. the model) to sweep within")
    c = scored.groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    c = running_totals(c, by, score, {"_tp": "pos", "_fp": "neg"}, {"P": "pos", "N": "neg"}, descending=True)
    tp, fp = F.col("_tp") + F.col("pos"), F.col("_fp") + F.col("neg")
    acc = ((tp + (F.col("N") - fp)) / (F.col("P") + F.col("N")))
    none = F.col("N") / (F.col("P") + F.col("N"))  # accuracy at +inf, which wins its ties
    best = c.groupBy(*by).agg(F.max_by(F.col(score), F.struct(acc.alias("a"), F.col(score).alias("s"))).alias("_thr"),
                              F.max(acc).alias("_acc"), F.max(none).alias("_none"))
    return best.select(*by, F.when(F.col("_none") >= F.col("_acc"), F.lit(float("inf"))).otherwise(F.col("_thr")).alias("threshold"),
                       F.greatest("_acc", "_none").alias("dev_accuracy"))


def apply_threshold(scored: DataFrame, thresholds: DataFrame, by=("model",), score: str = "sim",
                    out: str = "pred") -> DataFrame:
    """``score >= threshold``. One threshold row per group: Spark broadcasts the table when its measured
    size allows, and splits a hot group otherwise."""
    by = list(by)
    return scored.join(thresholds.select(*by, "threshold"), by) \
        .withColumn(out, (F.col(score) >= F.col("threshold")).cast("int"))


def accuracy(pred: DataFrame, by=("model",), p: str = "pred", y: str = "label") -> DataFrame:
    """Mean of (prediction == label) per group."""
    return pred.groupBy(*by).agg(F.avg((F.col(p) == F.col(y)).cast("double")).alias("accuracy"))


def evaluate_wic(dev: DataFrame, test: DataFrame, by=("model",)) -> DataFrame:
    """Tune the threshold on dev pairs, apply it to test pairs, accuracy per group."""
    thr = best_threshold(dev, by)
    acc = accuracy(apply_threshold(test, thr, by), by)
    return thr.join(acc, list(by))


def evaluate_wic_answers(answers: DataFrame, gold: DataFrame, vectors, by=("sbert", "model")) -> DataFrame:
    """E9 as a sweep from the answer lines on, one record per ``by``: answers (by, part dev or test, line_no, answer)
    lose their punctuation tokens (P11) and get the vector of their text, lines 2i and 2i + 1 are paired (R2) and
    compared (V1), and the gold line of the pair (pair_id, gold) decides (P17).

    ``vectors``: a (text, embedding) table or a function that makes one from the texts."""
    by = list(by)
    a = written(answers.select(*by, "part", "line_no", drop_punct_tokens("answer").alias("text")))
    table = vectors(a.select("text")) if callable(vectors) else vectors
    pairs = pair_adjacent(a.join(table, "text"), "line_no", ("embedding",), [*by, "part"])
    scored = pair_similarity(pairs, "embedding1", "embedding2").join(gold.select("pair_id", label_true("gold").alias("label")), "pair_id")
    scored = written(scored.select(*by, "part", "pair_id", "sim", "label"))
    return evaluate_wic(scored.where("part = 'dev'"), scored.where("part = 'test'"), by)
