"""Set-oriented n-gram tables shared by BLEU, NIST and sacreBLEU.

One row per (row_id, n, gram) with the gold count ``cg`` and prediction count ``cp``. Grams are
generated per row (linear in the text length: each gram is a slice of the token array); counting is a hash aggregate keyed by ``row_id`` first, so when the input
is hash-partitioned on ``row_id`` no further exchange is needed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(prepared: DataFrame) -> DataFrame:
    """(row_id, side, toks): the gold and the prediction token arrays as two rows."""
    return prepared.select("row_id", F.explode(F.array(
        F.struct(F.lit("g").alias("side"), F.col("g_tokens").alias("toks")),
        F.struct(F.lit("p").alias("side"), F.col("p_tokens").alias("toks")))).alias("s")).select(
        "row_id", "s.side", "s.toks")


def gram_counts(prepared: DataFrame, max_n: int = 5) -> DataFrame:
    """(row_id, n, gram, prefix, cg, cp) from a frame with row_id, g_tokens, p_tokens.

    Built with generators only (position, then order) and ``slice``/``array_join``, so the whole
    chain runs in one code-generated stage; each gram is a slice, so the work is linear in the
    text length."""
    pos = _sides(prepared).select("row_id", "side", "toks", F.posexplode("toks").alias("pos", "_tok"))
    grams = pos.select("row_id", "side", "toks", "pos",
                       F.explode(F.sequence(F.lit(1), F.least(F.lit(max_n), F.size("toks") - F.col("pos")))).alias("n"))
    grams = grams.select("row_id", "side", "n",
                         F.array_join(F.slice("toks", F.col("pos") + 1, F.col("n")), " ").alias("gram"))
    return grams.groupBy("row_id", "n", "gram").agg(
        F.sum(F.when(F.col("side") == "g", 1).otherwise(0)).cast("long").alias("cg"),
        F.sum(F.when(F.col("side") == "p", 1).otherwise(0)).cast("long").alias("cp"),
    ).withColumn("prefix", F.expr("case when n > 1 then substring_index(gram, ' ', n - 1) end"))
