"""Run bookkeeping: parsed run ids (P19), display recodes (P18) and the pending-work list."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_run(c="run_id") -> Column:
    """``model-rank-alpha-dropout-wd-lr`` with the learning rate holding a dash (``1e-4``)."""
    parts = F.split(F.col(c) if isinstance(c, str) else c, "-")
    n = F.size(parts)
    return F.struct(
        F.element_at(parts, 1).alias("model"),
        F.element_at(parts, 2).cast("double").alias("lora_rank"),
        F.element_at(parts, 3).alias("lora_alpha"),
        F.element_at(parts, 4).cast("double").alias("dropout"),
        F.element_at(parts, 5).alias("wd"),
        F.concat_ws("-", F.slice(parts, n - 1, 2)).alias("lr"),
    )


def recode(c, mapping: dict, default=None) -> Column:
    """Value -> display value from a small fixed mapping (a CASE expression, no join)."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.lit(default) if default is not None else col
    for k, v in reversed(list(mapping.items())):
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def suffix_to_int(c="suffix", none_value: int = 150) -> Column:
    """Context-width suffix '' (no limit) -> 150, else its integer."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col == "", F.lit(none_value)).otherwise(col.cast("int")).cast("long")


def pending_runs(inputs: DataFrame, outputs: DataFrame, keys=("model", "dataset")) -> DataFrame:
    """(run, dataset) pairs that have an input and no output yet.

    The reference walks runs x datasets and acts only where an input exists, so the grid
    restricted to existing inputs is just the distinct input keys: no cross join is needed."""
    keys = list(keys)
    return inputs.select(*keys).distinct().join(outputs.select(*keys).distinct(), keys, "left_anti")
