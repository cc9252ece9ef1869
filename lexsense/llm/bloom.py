"""A bounded Bloom filter as a broadcast table: thins a large table before an exact join."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 16  # rows of the broadcast table at most, of 64 bits each


def thin(rows: DataFrame, ids: DataFrame, key: str, mark: str | None = None) -> DataFrame:
    """``rows`` whose ``key`` may be among ``ids`` (none that is is lost; an exact join must follow).

    The filter has ``WORDS`` words whatever the number of ids; with very many ids it fills up and lets
    all rows through, which costs time and no result. With ``mark`` all rows stay, and that column tells.
    """
    h = F.xxhash64(F.lit(64), key)
    word = F.shiftright(h, 32).bitwiseAND(F.lit(WORDS - 1))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(64, {key}), 64) as int))")
    bits = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    if mark:
        return (rows.withColumn("_w", word).join(F.broadcast(bits), F.col("_w") == F.col("_word"), "left")
                .withColumn(mark, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_w", "_word", "_bits"))
    return (rows.withColumn("_w", word).join(F.broadcast(bits), F.col("_w") == F.col("_word"))
            .where(F.col("_bits").bitwiseAND(bit) != 0).drop("_w", "_word", "_bits"))
