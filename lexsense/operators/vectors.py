"""Vector operators: cosine of a row pair (V1), centroids (A9), mean cross-period cosine distance
(A10, closed form), mean Canberra distance between period centroids (A11).

Vectors are ``array<float>``; they are cast to double before any arithmetic. Sums by component move each vector
once, as it is, into ranges of the groups (``component_sums``), and are made there.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """V1: cosine similarity of two vectors (zip_with + aggregate, JVM side, no shuffle)."""
    return dot(a, b) / (norm(a) * norm(b))


def unit(a) -> Column:
    """The norm is the one element of an array, so that it is found once and not for every component."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(as_double(a), lambda x: x / n))[0]


def canberra(a, b) -> Column:
    """Canberra distance; a 0/0 term counts 0 (as scipy)."""
    terms = F.zip_with(as_double(a), as_double(b), lambda x, y: F.when(
        (F.abs(x) + F.abs(y)) == 0, F.lit(0.0)).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y))))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


CHUNK = 16  # components of an aggregated row


def component_sums(df: DataFrame, by, parts, keys, vec: str = "embedding") -> DataFrame:
    """(by, keys, _d, _s, _w, _n): sums by component over the rows of a group, in chunks ``_d`` of ``CHUNK`` components.

    ``parts``: an array of structs (keys, ``weight``, ``unit``), one for each group a row's vector goes into, as it is
    or as a unit vector. ``_s`` and ``_w`` hold the weighted sum of every component and the weights of its values,
    ``_n`` the weights of all rows. Null and empty vectors are left out.

    A vector is moved once, whatever the number of its parts, into ranges of (by, row) with about the same number
    of rows each. So the rows of a group meet before they are added up, a hot group spreads over ranges, and
    only one row for each group, chunk and range goes on."""
    by, keys = list(by), list(keys)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.size(vec) > 0).select(*by, parts.alias("_p"), F.col(vec).alias("_v"))
    rows = rows.repartitionByRange(n, *by, F.xxhash64(*[F.col(c) for c in rows.columns]))
    rows = rows.select(*by, "_v", F.explode("_p").alias("_p"))
    rows = rows.select(*by, *[F.col("_p")[k].alias(k) for k in keys], F.col("_p")["weight"].cast("double").alias("_w"),
                       F.when(F.col("_p")["unit"], unit("_v")).otherwise(as_double("_v")).alias("_v"))
    starts = F.sequence(F.lit(0), F.floor((F.size("_v") - 1) / CHUNK).cast("int"))
    rows = rows.select(*by, *keys, "_w", F.posexplode(F.transform(starts, lambda k: F.slice("_v", k * CHUNK + 1, CHUNK))).alias("_d", "_c"))
    x = [F.get("_c", F.lit(i)) for i in range(CHUNK)]
    sums = rows.groupBy(*by, *keys, "_d").agg(
        F.max(F.size("_c")).alias("_l"), F.sum("_w").alias("_n"), *[F.sum(F.col("_w") * c).alias(f"_s{i}") for i, c in enumerate(x)],
        *[F.sum(F.when(c.isNotNull(), F.col("_w"))).alias(f"_w{i}") for i, c in enumerate(x)])
    listed = lambda c: F.slice(F.array(*[f"{c}{i}" for i in range(CHUNK)]), F.lit(1), F.col("_l")).alias(c)
    return sums.select(*by, *keys, "_d", listed("_s"), listed("_w"), "_n")


def _means(sums: DataFrame, keys, out: str) -> DataFrame:
    """(keys, out, n_rows) from ``component_sums``: the chunks' means in order."""
    mean = F.zip_with("_s", "_w", lambda s, w: F.when(w > 0, s / w))
    chunks = F.sort_array(F.collect_list(F.struct("_d", mean.alias("_m"))))
    return sums.groupBy(*keys).agg(F.flatten(F.transform(chunks, lambda c: c["_m"])).alias(out), F.max("_n").cast("long").alias("n_rows"))


def centroids(df: DataFrame, keys, vec: str = "embedding", out: str = "centroid") -> DataFrame:
    """Element-wise mean vector per key. The array collected per key has the vector's dimension, whatever
    the number of rows."""
    keys = list(keys)
    return _means(component_sums(df, keys, F.array(F.struct(F.lit(1).alias("weight"), F.lit(False).alias("unit"))), [], vec), keys, out)


def _mean_distance(sums: DataFrame, by, period: str, first: int, second: int) -> DataFrame:
    """(by, APD) from the sums of unit vectors by period."""
    by = list(by)
    of = lambda p, c: F.max(F.when(F.col(period) == p, F.col(c)))  # noqa: E731  one row a period
    per_d = sums.groupBy(*by, "_d").agg(of(first, "_s").alias("_s1"), of(second, "_s").alias("_s2"),
                                        of(first, "_n").alias("_n1"), of(second, "_n").alias("_n2"))
    some = lambda x: F.coalesce(x, F.lit(0.0))
    dot_d = F.aggregate(F.zip_with("_s1", "_s2", lambda x, y: some(x) * some(y)), F.lit(0.0), lambda s, x: s + x)
    out = per_d.groupBy(*by).agg(F.sum(dot_d).alias("_dot"), F.max("_n1").alias("_n1"), F.max("_n2").alias("_n2"))
    apd = F.when((F.col("_n1") > 0) & (F.col("_n2") > 0), F.lit(1.0) - F.col("_dot") / (F.col("_n1") * F.col("_n2")))
    return out.select(*by, apd.alias("APD"))


def mean_shift(usages: DataFrame, by, period: str = "grouping", vec: str = "embedding",
               first: int = 1, second: int = 2) -> DataFrame:
    """A10 (APD): mean cosine distance over all cross-period pairs, in closed form
    ``1 - (sum u1) . (sum u2) / (n1 n2)`` of the unit vectors: linear, no pair is formed.

    Null if a period is empty (the reference gives NaN)."""
    part = F.struct(F.col(period).alias("_period"), F.lit(1).alias("weight"), F.lit(True).alias("unit"))
    return _mean_distance(component_sums(usages, by, F.array(part), ["_period"], vec), by, "_period", first, second)


TILE = 64  # centroids of a block


def centroid_tiles(usages: DataFrame, by, label: str = "label", period: str = "grouping", vec: str = "embedding",
                   first: int = 1, second: int = 2, tile: int = TILE) -> DataFrame:
    """(by, i, j, a, b): block i of a group's first-period centroids beside block j of the second period's.

    Labels are hashed into blocks of about ``tile``; each block is listed once for each partner number and
    joined on (group, i, j), so the tiles of a hot group spread over all tasks and no pair of rows is made."""
    by = list(by)
    c = written(centroids(usages, by + [period, label], vec, "_c"))
    return _tiled(c, c, by, label, period, first, second, tile)


def _tiled(c: DataFrame, groups: DataFrame, by, label: str, period: str, first: int, second: int, tile: int = TILE) -> DataFrame:
    """``groups``: one row a centroid; the centroids themselves are then made once."""
    side = F.when(F.col(period) == first, 1).when(F.col(period) == second, 2).alias("_p")
    blocks = lambda p: F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("_p") == p, 1)) / tile)).cast("long").alias(f"_n{p}")
    sizes = groups.select(*by, side).where("_p is not null").groupBy(*by).agg(blocks(1), blocks(2))
    c = c.select(*by, side, label, "_c").where("_p is not null").join(sizes, by)
    own = F.when(F.col("_p") == 1, F.col("_n1")).otherwise(F.col("_n2"))
    packed = c.withColumn("_b", F.pmod(F.xxhash64(label), own)).groupBy(*by, "_p", "_b", "_n1", "_n2").agg(F.collect_list("_c").alias("_cs"))
    partners = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = packed.where("_p = 1").select(*by, F.col("_b").alias("i"), partners("_n2").alias("j"), F.col("_cs").alias("a"))
    b = packed.where("_p = 2").select(*by, partners("_n1").alias("i"), F.col("_b").alias("j"), F.col("_cs").alias("b"))
    return a.join(b, [*by, "i", "j"])


@F.pandas_udf(T.StructType([T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())]))
def _canberra_tile(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Sum and number of the Canberra distances of all pairs of a tile; a 0/0 term counts 0."""
    total, n = [], []
    for x, y in zip(a, b):
        y, s = np.stack(y), 0.0
        for u in np.stack(x):
            size = np.abs(u) + np.abs(y)
            s += float(np.divide(np.abs(u - y), size, out=np.zeros_like(size), where=size > 0).sum())
        total.append(s)
        n.append(len(x) * len(y))
    return pd.DataFrame({"total": total, "n": n})


def centroid_shift(usages: DataFrame, by, label: str = "label", period: str = "grouping",
                   vec: str = "embedding", first: int = 1, second: int = 2) -> DataFrame:
    """A11 (APDP): mean Canberra distance between every period-1 and every period-2 cluster
    centroid of a group (J10). Tiles of centroid blocks give only (sum, count); null if a period is empty."""
    by = list(by)
    out = _mean_tiles(centroid_tiles(usages, by, label, period, vec, first, second), by)
    keys = usages.select(*by).distinct()
    return keys.join(out, by, "left")


def _mean_tiles(tiles: DataFrame, by) -> DataFrame:
    return tiles.select(*by, _canberra_tile("a", "b").alias("t")).groupBy(*by).agg((F.sum("t.total") / F.sum("t.n")).alias("APDP"))


def shifts(firsts: DataFrame, labelled: DataFrame, vectors: DataFrame, by, first: int = 1, second: int = 2) -> tuple[DataFrame, DataFrame]:
    """A10 of the distinct glosses ``firsts`` (by, gloss, grouping) and A11 of all usages ``labelled`` (by, gloss,
    grouping, label): (by, APD) and (by, APDP). Groups without any vector, or with an empty period, may be left out.

    Usages are counted by gloss, and every (by, gloss) gets its vector once for both results."""
    by = list(by)
    kind = labelled.schema["label"].dataType
    one = firsts.select(*by, "gloss", F.struct(F.lit(True).alias("unit"), F.col("grouping").alias("period"),
                                               F.lit(None).cast(kind).alias("label"), F.lit(1).cast("long").alias("weight")).alias("p"))
    many = labelled.groupBy(*by, "gloss", "grouping", "label").agg(F.count(F.lit(1)).alias("weight"))
    many = many.select(*by, "gloss", F.struct(F.lit(False).alias("unit"), F.col("grouping").alias("period"), "label", "weight").alias("p"))
    parts = one.unionByName(many).groupBy(*by, "gloss").agg(F.collect_list("p").alias("parts"))
    held = parts.join(vectors.select("gloss", "embedding"), "gloss")
    marked = F.transform("parts", lambda p: F.struct(p["unit"].alias("_unit"), p["period"].alias("_period"), p["label"].alias("_label"),
                                                     p["weight"].alias("weight"), p["unit"].alias("unit")))
    sums = written(component_sums(held, by, marked, ["_unit", "_period", "_label"]))
    apd = _mean_distance(sums.where("_unit"), by, "_period", first, second)
    sums = sums.where("not _unit")
    c = _means(sums, [*by, "_period", "_label"], "_c")
    return apd, _mean_tiles(_tiled(c, sums.where("_d = 0"), by, "_label", "_period", first, second), by)
