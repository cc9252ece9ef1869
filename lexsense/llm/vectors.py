"""Embedding near-dedup: spherical k-means cells, blocked cosine products (operator 9).

Vectors with equal label and equal components are one class, so copies cost nothing. Each class goes to
its nearest centroid's cell; a cell's classes are ordered by their distance to the centroid and cut into blocks
with a centre and a radius. Two blocks of a label, of one cell or of two, are multiplied unless the distance of their
centres exceeds both radii and that of the threshold: for unit vectors with cosine >= t, |x - y| <= sqrt(2 - 2t).
Hence no link is lost, whatever the centroids, and no vector is copied to other cells. A task multiplies two
blocks, and returns for each class its links and its root in the tile, never pairs.

Defined results: a null label, a null or empty vector, null or non-finite components, or only zeros: no
links, own component. Vectors of different lengths are never compared. Identical rows count once. A class as near
to two centroids goes to the first. Extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsense.llm.graph import components
from lexsense.llm.scratch import saved
from lexsense.operators.clusters import metric_blocks, near_tiles, tiles, unit_rows

BLOCK = 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(9)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        new = np.zeros_like(c)
        np.add.at(new, home, x)
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, new / np.maximum(norm, 1e-12), c)
    return c


def links(vectors: DataFrame, threshold: float = 0.93, sample: int = 8192, cell: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector. Centroids are fitted on about ``sample``
    classes (a bound), one for each ``cell`` classes, 256 at most; every vector is indexed."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").distinct()
    fine = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
            & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
            & F.exists("embedding", lambda v: v != 0))
    fine = F.coalesce(fine, F.lit(False))
    classes = (rows.where(fine).groupBy("label", "embedding")
               .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).checkpoint())
    total = classes.count()
    u = F.pmod(F.xxhash64(F.lit(9), "rep"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = classes.where(u * total < sample).select("rep", "embedding").limit(2 * sample).collect()
    by_dim: dict[int, list] = {}
    for r in sorted(picked, key=lambda r: r["rep"]):
        by_dim.setdefault(len(r["embedding"]), []).append(r["embedding"])
    k = int(np.clip(total // cell, 1, 256))
    centroids = {d: kmeans(unit_rows(v), min(k, len(v))) for d, v in by_dim.items()}
    by = ["label", "dim"]
    points = classes.select("label", F.size("embedding").alias("dim"), F.col("rep").alias("id"), F.col("embedding").alias("v"), "n")
    blocks = metric_blocks(points, by, BLOCK, spread=2.0, centres=centroids, carry=["n"])
    pairs = tiles(blocks, near_tiles(blocks, by, 1 - threshold), by, ("ids", "vs", "ns"))

    def compare(batches):
        for t in batches:
            for r in t.itertuples(index=False):
                same = r.bi == r.bj
                on = np.stack(r.vs_i) @ np.stack(r.vs_j).T >= threshold
                if same:
                    on |= on.T
                    np.fill_diagonal(on, False)
                ra, rb = np.asarray(r.ids_i), np.asarray(r.ids_j)
                la, lb = on @ np.asarray(r.ns_j), on.T @ np.asarray(r.ns_i)
                i, j = np.nonzero(on)
                ca, cb = ra.copy(), rb.copy()
                while len(i):  # smallest class reachable within the tile
                    low = np.minimum(ca[i], cb[j])
                    na, nb = ca.copy(), cb.copy()
                    np.minimum.at(na, i, low)
                    np.minimum.at(nb, j, low)
                    if same:
                        na = nb = np.minimum(na, nb)
                    if (na == ca).all() and (nb == cb).all():
                        break
                    ca, cb = na, nb
                parts = [(ra, la, ca)] if same else [(ra, la, ca), (rb, lb, cb)]
                yield pd.concat([pd.DataFrame({"rep": x[n > 0], "links": n[n > 0], "root": c[n > 0]}) for x, n, c in parts])

    found = saved(pairs.mapInPandas(compare, "rep long, links long, root long"))
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    info = (classes.join(degree, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
            .select("label", "embedding", "n", F.coalesce("links", F.lit(0)).alias("links"),
                    F.coalesce("component", "rep").alias("component")))
    full = rows.where(fine).join(info, ["label", "embedding"]).select(
        "vec_id", (F.col("n") - 1 + F.col("links")).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_dedup(spark, sf_dir):
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
c(n, r) AS (SELECT vec_id, vec_id FROM ok UNION SELECT p.b, c.r FROM c JOIN p ON p.a = c.n WHERE c.r < p.b),
m AS (SELECT n, min(r) AS r FROM c GROUP BY n), d AS (SELECT a, count(*) AS k FROM p GROUP BY a)
SELECT v.vec_id, coalesce(d.k, 0)::BIGINT AS n_links, coalesce(m.r, v.vec_id)::BIGINT AS component_id,
  coalesce(m.r, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN m ON m.n = v.vec_id LEFT JOIN d ON d.a = v.vec_id
"""
