"""Clustering comparison (A4-A8) and density clustering (V3).

The comparison metrics are all functions of the contingency table (true, predicted, n) per
group, which is a small aggregate of the rows: no pair of rows is ever formed.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def _pairs(n):
    return n * (n - 1) / 2.0


def contingency(df: DataFrame, by, true: str = "cluster", pred: str = "label") -> DataFrame:
    """A5: count per (group, true, predicted)."""
    return df.groupBy(*by, true, pred).agg(F.count("*").alias("n"))


def margins(cont: DataFrame, by, true: str = "cluster", pred: str = "label") -> DataFrame:
    """One row per group: n, S (pairs within cells), Sa and Sb (pairs within true and predicted clusters), the sum
    of each predicted cluster's largest cell (``top``) and the number of clusters of either side.

    Both margins of the contingency table come from one aggregation over grouping sets, which a second one sums up
    by group: no join, and the cells are read once."""
    by = list(by)
    sides = cont.groupingSets([[*by, true], [*by, pred]], *by, true, pred).agg(
        F.grouping(pred).alias("_true"), F.sum("n").alias("m"), F.max("n").alias("top"), F.sum(_pairs(F.col("n"))).alias("S"))
    one, two = F.col("_true") == 1, F.col("_true") == 0
    return sides.groupBy(*by).agg(
        F.sum(F.when(one, F.col("m"))).alias("n"), F.sum(F.when(one, F.col("S"))).alias("S"),
        F.sum(F.when(one, _pairs(F.col("m")))).alias("Sa"), F.sum(F.when(two, _pairs(F.col("m")))).alias("Sb"),
        F.sum(F.when(two, F.col("top"))).alias("top"), F.count(F.when(one, 1)).alias("n_true_cluster"), F.count(F.when(two, 1)).alias("n_cluster"))


def partition_scores(cont: DataFrame, by, true: str = "cluster", pred: str = "label", counts: bool = False) -> DataFrame:
    """Purity, Rand index and adjusted Rand index per group from the contingency table; with ``counts``
    also the number of predicted and of true clusters (A4)."""
    by = list(by)
    j = margins(cont, by, true, pred)
    c = _pairs(F.col("n").cast("double"))
    ri = F.when(c == 0, F.lit(1.0)).otherwise((c + 2 * F.col("S") - F.col("Sa") - F.col("Sb")) / c)
    expected = F.col("Sa") * F.col("Sb") / c
    ari = F.when((F.col("Sa") == F.col("S")) & (F.col("Sb") == F.col("S")), F.lit(1.0)).otherwise(
        (F.col("S") - expected) / ((F.col("Sa") + F.col("Sb")) / 2 - expected))
    return j.select(*by, (F.col("top") / F.col("n")).alias("PUR"), ri.alias("RI"), ari.alias("ARI"),
                    *(["n_cluster", "n_true_cluster"] if counts else []))


def cluster_counts(labelled: DataFrame, glosses: DataFrame, by, true: str = "cluster",
                   pred: str = "label") -> DataFrame:
    """A4: distinct predicted labels over the distinct glosses (noise counts as one) and distinct
    true clusters over all usages, per group."""
    a = glosses.groupBy(*by).agg(F.countDistinct(pred).alias("n_cluster"))
    b = labelled.groupBy(*by).agg(F.countDistinct(true).alias("n_true_cluster"))
    return a.join(b, list(by), "full")


# ---------------------------------------------------------------- V3 density clustering

BLOCK = 256      # points of a block
SUPER = 64       # blocks of a super-block
PIVOTS = 64      # vectors that all points measure their distance to
SLACK = 1e-9     # of distances, against rounding


def unit_rows(v) -> np.ndarray:
    a = np.asarray(np.stack(v), dtype=np.float64)
    a = a / np.abs(a).max(axis=1, keepdims=True)  # squares of very large and small numbers leave the range
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors along the chord, ``sqrt(2 * cosine distance)``: a metric, unlike the cosine
    distance itself, so the triangle inequality can rule blocks out."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _schema(df: DataFrame, by, extra: str) -> str:
    return ", ".join([f"{k} {t}" for k, t in df.select(*by).dtypes] + [extra])


def _usable(points: DataFrame) -> DataFrame:
    """Points with a direction: vectors that are null, zero or not finite are in no cluster."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return points.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def metric_blocks(points: DataFrame, by, block: int = BLOCK, pivots: int = PIVOTS, spread: float = 0.5,
                  centres: dict | None = None, carry=()) -> DataFrame:
    """(by, blk, ids, vs, centre, radius): the points (by, id, v) of each group in blocks of neighbours; for each
    column c of ``carry`` also the list ``cs``. ``centres`` (unit vectors by their length) may replace the pivots.

    Every point gets the numbers of its three nearest pivots (``pivots`` vectors of the whole table) and the
    distance to the first. Points are range-partitioned and sorted by group and that path, and each stretch
    is cut into blocks of at most ``block`` points, earlier (but not before an eighth) at a point that is further
    than ``spread`` from the block's first. So a group of any size spreads over tasks without its size being looked up. ``radius`` is the largest chord distance of the block's points to its centre. The result
    is a table: block numbers must not change when a task is repeated."""
    by, least = list(by), max(1, block // 8)
    spark = points.sparkSession
    extra = "".join(f", {c}s array<{t}>" for c, t in points.select(*carry).dtypes)
    extra = f"blk long, ids array<long>, vs array<array<double>>, centre array<double>, radius double{extra}"
    if centres is None:
        picked = points.select(F.struct(F.xxhash64("id").alias("h"), "v").alias("p")).orderBy("p.h").limit(pivots).collect()
        # a shorter vector cannot meet a longer one in a group, but both may be in the table
        width = len(picked[0]["p"]["v"]) if picked else 0
        centres = {width: unit_rows([r["p"]["v"] for r in picked if len(r["p"]["v"]) == width])} if picked else {}

    def path(it):
        for pdf in it:
            near = np.zeros((len(pdf), 3), dtype=np.int32)
            far = np.zeros(len(pdf))
            size = pdf["v"].map(len).to_numpy()
            for width, held in centres.items():
                fits = np.flatnonzero(size == width)
                if len(fits):
                    d = _chord(unit_rows(pdf["v"].iloc[fits]), held)
                    order = np.argsort(d, axis=1)[:, :3]
                    near[fits, :order.shape[1]] = order
                    far[fits] = d[np.arange(len(fits)), order[:, 0]]
            yield pdf.assign(p1=near[:, 0], p2=near[:, 1], p3=near[:, 2], d=far)

    keys = [*by, "p1", "p2", "p3", "d", "id"]
    kept = "".join(f", {c} {t}" for c, t in points.select(*carry).dtypes)
    kind = _schema(points, by, f"id long, v array<double>{kept}, p1 int, p2 int, p3 int, d double")
    placed = points.select(*by, "id", F.col("v").cast("array<double>").alias("v"), *carry).mapInPandas(path, kind)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())

    def cut(it):
        number, rest = 0, None

        def packed(pdf):
            nonlocal number
            u = unit_rows(pdf["v"])
            centre = u.mean(axis=0)
            row = {k: pdf[k].iloc[0] for k in by} | {
                "blk": int(pdf["_part"].iloc[0]) << 40 | number, "ids": pdf["id"].to_numpy(), "vs": list(u),
                "centre": centre, "radius": float(np.linalg.norm(u - centre, axis=1).max())}
            row |= {f"{c}s": pdf[c].to_numpy() for c in carry}
            number += 1
            return row

        def pieces(pdf, last):
            """Whole blocks of ``pdf``; what may go on in the next batch comes back, too."""
            spans = []
            new = np.ones(len(pdf), bool)
            new[1:] = (pdf[by].iloc[1:].to_numpy() != pdf[by].iloc[:-1].to_numpy()).any(axis=1)
            starts = np.flatnonzero(new)
            for start, end in zip(starts, [*starts[1:], len(pdf)]):  # vectors of a group have one length
                u, a = unit_rows(pdf["v"].iloc[start:end]), start
                while a < end:
                    b = min(a + block, end)
                    far = np.linalg.norm(u[a - start:b - start] - u[a - start], axis=1) > spread
                    far[:least] = False
                    b = a + int(far.argmax()) if far.any() else b
                    spans.append((a, b))
                    a = b
            done = spans if last else spans[:-1]
            return [packed(pdf.iloc[a:b]) for a, b in done], None if last else pdf.iloc[spans[-1][0]:]

        for pdf in it:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if len(pdf):
                rows, rest = pieces(pdf, False)
                if rows:
                    yield pd.DataFrame(rows)
        if rest is not None and len(rest):
            yield pd.DataFrame(pieces(rest, True)[0])

    return written(placed.mapInPandas(cut, _schema(points, by, extra)))


def near_tiles(blocks: DataFrame, by, eps: float) -> DataFrame:
    """(by, bi, bj), bi <= bj: pairs of blocks of a group that may hold points within cosine distance ``eps``.

    Blocks are first taken together, ``SUPER`` in a row, with a centre and radius of their own. Pairs of these are
    dropped when the distance of their centres exceeds both radii and eps, and the blocks of the pairs that
    stay are tested alike, by numpy. Each super-block is listed once for each partner number and joined on
    (group, i, j), so the pairs of a hot group spread over all tasks."""
    by, reach = list(by), float(np.sqrt(2 * eps)) + SLACK
    # block numbers run on within a partition of ``metric_blocks``, so neighbours share a quotient
    listed = blocks.select(*by, F.expr(f"blk div {SUPER}").alias("s0"), F.struct("blk", "centre", "radius").alias("x"))
    packed = listed.groupBy(*by, "s0").agg(F.collect_list("x").alias("b"))
    packed = packed.select(*by, "s0", F.col("b")["blk"].alias("blks"), F.col("b")["centre"].alias("cs"), F.col("b")["radius"].alias("rs"))

    def summary(it):
        for pdf in it:
            rows = []
            for cs, rs in zip(pdf["cs"], pdf["rs"]):
                c = np.stack(cs)
                mid = c.mean(axis=0)
                rows.append((mid, float((np.linalg.norm(c - mid, axis=1) + np.asarray(rs)).max())))
            yield pdf.assign(c=[r[0] for r in rows], r=[r[1] for r in rows])

    packed = written(packed.mapInPandas(summary, _schema(packed, by, "s0 long, blks array<long>, cs array<array<double>>, "
                                                        "rs array<double>, c array<double>, r double")))
    # numbers from 0 for each group: a window over keys only, one row for SUPER * BLOCK points
    numbers = packed.select(*by, "s0", (F.row_number().over(Window.partitionBy(*by).orderBy("s0")) - 1).cast("long").alias("s"))
    packed = packed.join(numbers, [*by, "s0"])
    many = packed.groupBy(*by).agg(F.max("s").alias("top"))
    small = packed.select(*by, "s", "c", "r").join(many, by)
    left = small.select(*by, F.col("s").alias("i"), F.explode(F.sequence("s", "top")).alias("j"), F.col("c").alias("c_i"), F.col("r").alias("r_i"))
    right = small.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), "s")).alias("i"), F.col("s").alias("j"), F.col("c").alias("c_j"), F.col("r").alias("r_j"))
    gap = F.sqrt(F.aggregate(F.zip_with("c_i", "c_j", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = left.join(right, [*by, "i", "j"]).where(gap <= F.col("r_i") + F.col("r_j") + F.lit(reach)).select(*by, "i", "j")
    own = lambda k: packed.select(*by, F.col("s").alias(k), *[F.col(x).alias(f"{x}_{k}") for x in ("blks", "cs", "rs")])
    wide = pairs.join(own("i"), [*by, "i"]).join(own("j"), [*by, "j"])

    def test(it):
        for pdf in it:
            for r in pdf.itertuples(index=False):
                ci, cj = np.stack(r.cs_i), np.stack(r.cs_j)
                gap = np.sqrt(np.maximum(0.0, (ci * ci).sum(1)[:, None] + (cj * cj).sum(1)[None] - 2 * ci @ cj.T))
                ok = gap <= np.asarray(r.rs_i)[:, None] + np.asarray(r.rs_j)[None] + reach + 1e-6
                bi, bj = np.asarray(r.blks_i)[:, None] + 0 * np.asarray(r.blks_j)[None], np.asarray(r.blks_j)[None] + 0 * np.asarray(r.blks_i)[:, None]
                ok &= bi <= bj
                if ok.any():
                    yield pd.DataFrame({**{k: getattr(r, k) for k in by}, "bi": bi[ok], "bj": bj[ok]})

    return wide.mapInPandas(test, _schema(packed, by, "bi long, bj long"))


def tiles(blocks: DataFrame, pairs: DataFrame, by, cols=("ids", "vs")) -> DataFrame:
    """The pairs with both blocks' lists."""
    side = lambda k: blocks.select(*by, F.col("blk").alias(f"b{k}"), *[F.col(c).alias(f"{c}_{k}") for c in cols])
    return pairs.join(side("i"), [*by, "bi"]).join(side("j"), [*by, "bj"])


def _distance_tile(vi, vj):
    return 1.0 - np.stack(vi) @ np.stack(vj).T


def _core_distance(tiles: DataFrame, by, k: int, eps: float) -> DataFrame:
    """(by, blk, pos, core): distance of a block's point to its k-th nearest point, itself the first, where that is
    at most ``eps``; other points have no row.

    Each tile gives the at most ``k - 1`` smallest distances up to eps of its points to other points; the smallest of
    all of a point's tiles decide. Tiles that were ruled out hold none of them."""
    by, m = list(by), k - 1

    def run(it):
        for pdf in it:
            for r in pdf.itertuples(index=False):
                d = _distance_tile(r.vs_i, r.vs_j)
                d[np.asarray(r.ids_i)[:, None] == np.asarray(r.ids_j)[None]] = np.inf
                for blk, x in ((r.bi, d), (r.bj, d.T)) if r.bi != r.bj else ((r.bi, d),):
                    near = np.sort(np.partition(x, m - 1, axis=1)[:, :m] if m < x.shape[1] else x, axis=1)
                    pos = np.flatnonzero(near[:, 0] <= eps)
                    if len(pos):
                        yield pd.DataFrame({**{c: getattr(r, c) for c in by}, "blk": blk, "pos": pos.astype(np.int32),
                                            "near": [x[x <= eps] for x in near[pos]]})

    part = tiles.mapInPandas(run, _schema(tiles, by, "blk long, pos int, near array<double>"))
    near = F.array_sort(F.flatten(F.collect_list("near")))
    return part.groupBy(*by, "blk", "pos").agg(F.try_element_at(near, F.lit(m)).alias("core")).where("core is not null")


_BIG = np.iinfo(np.int64).max


def _tile_roots(ids_i: np.ndarray, ids_j: np.ndarray, ok: np.ndarray, same: bool):
    """Components of one tile's links by vectorised min-label propagation on its dense adjacency
    (at most block x block); returns (nodes with a link, smallest id of their tile component)."""
    if same:
        # the columns may hold the points in another order than the rows
        order = np.argsort(ids_j, kind="stable")
        ok = ok[:, order[np.searchsorted(ids_j[order], ids_i)]]
        ok = ok | ok.T  # links are undirected; a @ a.T need not be bit-symmetric
        lab = ids_i.copy()
        while True:
            new = np.minimum(lab, np.where(ok, lab[None, :], _BIG).min(axis=1))
            if np.array_equal(new, lab):
                break
            lab = new
        has = ok.any(axis=1)
        return ids_i[has], lab[has]
    li, lj = ids_i.copy(), ids_j.copy()
    while True:
        ni = np.minimum(li, np.where(ok, lj[None, :], _BIG).min(axis=1))
        nj = np.minimum(lj, np.where(ok, ni[:, None], _BIG).min(axis=0))
        if np.array_equal(ni, li) and np.array_equal(nj, lj):
            break
        li, lj = ni, nj
    hi, hj = ok.any(axis=1), ok.any(axis=0)
    return np.concatenate([ids_i[hi], ids_j[hj]]), np.concatenate([li[hi], lj[hj]])


def _local_stars(tiles: DataFrame, by, eps: float) -> DataFrame:
    """Mutual-reachability edges of each tile, resolved into components inside the tile
    (vectorised label propagation); emits (by, id, root) with root = smallest id of the node's
    tile component. Only star edges leave a task, never the pairwise distances."""
    by = list(by)

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                d = _distance_tile(r.vs_i, r.vs_j)
                ids_i, ids_j = np.asarray(r.ids_i, dtype=np.int64), np.asarray(r.ids_j, dtype=np.int64)
                ci, cj = np.asarray(r.cores_i, dtype=np.float64), np.asarray(r.cores_j, dtype=np.float64)
                ok = np.maximum(d, np.maximum(ci[:, None], cj[None, :])) <= eps
                ok &= ids_i[:, None] != ids_j[None, :]
                nodes, roots = _tile_roots(ids_i, ids_j, ok, r.bi == r.bj) if ok.any() else (ids_i[:0], ids_i[:0])
                # a dense point without a link in its own block: null root, as it may have one elsewhere
                lone = ids_i[(ci <= eps) & ~ok.any(axis=1)] if r.bi == r.bj else ids_i[:0]
                frame = pd.DataFrame({"id": np.concatenate([nodes, lone]),
                                      "root": pd.array([*roots, *[None] * len(lone)], dtype="Int64")})
                for k in by:
                    frame[k] = getattr(r, k)
                out.append(frame[[*by, "id", "root"]])
            if out:
                yield pd.concat(out, ignore_index=True)
    return tiles.mapInPandas(run, _schema(tiles, by, "id long, root long"))


def connected_components(edges: DataFrame, nodes: DataFrame, by, init: DataFrame | None = None) -> DataFrame:
    """Min-label propagation with pointer jumping: every node ends with the smallest id of its
    component. ``init`` may give starting labels (by, id, l). The driver loop only counts
    changed labels and ends when there are none; each round is written to ``spark.checkpoint.dir``."""
    by = list(by)
    lab = init if init is not None else nodes.select(*by, "id", F.col("id").alias("l"))
    e = written(edges.select(*by, "i", "j"))  # computed once, read every round
    while True:
        # smallest label among the neighbours
        nb = e.join(lab.select(*by, F.col("id").alias("j"), F.col("l").alias("lj")), by + ["j"]) \
            .groupBy(*by, "i").agg(F.min("lj").alias("m"))
        new = lab.join(nb.withColumnRenamed("i", "id"), by + ["id"], "left") \
            .select(*by, "id", F.least("l", F.coalesce("m", "l")).alias("l"))
        # pointer jumping: take the label of your label
        hop = new.select(*by, F.col("id").alias("l"), F.col("l").alias("ll"))
        jump = new.join(hop, by + ["l"], "left").select(*by, "id", F.least("l", F.coalesce("ll", "l")).alias("l"))
        jump = written(jump)
        changed = jump.join(lab.withColumnRenamed("l", "old"), by + ["id"]).where(F.col("l") != F.col("old")).count()
        lab = jump
        if changed == 0:
            return lab


def density_clusters(points: DataFrame, by, eps: float = 0.7, k: int = 2, block: int = BLOCK,
                     id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """V3: DBSCAN* over cosine distance per group (the flat cut of the HDBSCAN hierarchy at
    ``eps`` with min_samples = ``k`` of at least 2, self counted).

    core(p) = distance to the k-th nearest point, p the first; p and q are linked when
    max(d(p, q), core(p), core(q)) <= eps; labels are connected components of the points with
    core <= eps (label = min id of the component); the other points are noise (-1), as are points without
    a direction (null, zero or non-finite vectors). Vectors of a group have one length.

    The points are put in blocks of neighbours (``metric_blocks``); only the pairs of blocks that may hold points
    within eps (``near_tiles``) are compared, in two passes of bounded numpy tiles: core distances, then links,
    resolved into components inside the tile by vectorised label propagation. Only (node, tile root) star
    edges leave a task, and the global label propagation only has to stitch tiles together.
    """
    by = list(by)
    pts = points.select(*by, F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"))
    blocks = metric_blocks(_usable(pts), by, block, spread=float(np.sqrt(2 * eps)))
    pairs = written(near_tiles(blocks, by, eps))
    core = _core_distance(tiles(blocks, pairs, by), by, k, eps)
    cores = core.groupBy(*by, "blk").agg(F.map_from_entries(F.collect_list(F.struct("pos", "core"))).alias("m"))
    # only blocks with a dense point can hold links
    dense = blocks.join(cores, [*by, "blk"]).select(*by, "blk", "ids", "vs", F.transform("ids", lambda x, i: F.coalesce(
        F.try_element_at("m", i), F.lit(float("inf")))).alias("cores"))
    stars = _local_stars(tiles(written(dense), pairs, by, ("ids", "vs", "cores")), by, eps)
    # Tile components are final unless some node sits in two tile components with different
    # roots; one aggregation decides whether the propagation loop is needed at all.
    stars = written(stars)
    first = stars.groupBy(*by, "id").agg(
        F.coalesce(F.min("root"), F.col("id")).alias("l"), F.countDistinct("root").alias("_k"))
    if first.where(F.col("_k") > 1).limit(1).count() == 0:
        comp = first.select(*by, "id", "l")
    else:
        edges = stars.select(*by, F.col("id").alias("i"), F.col("root").alias("j")).unionByName(
            stars.select(*by, F.col("root").alias("i"), F.col("id").alias("j"))).where(F.col("i") != F.col("j"))  # null roots fall out
        comp = connected_components(edges, None, by, init=first.select(*by, "id", "l"))
    out = pts.select(*by, "id").join(comp, by + ["id"], "left") \
        .select(*by, F.col("id").alias(id_col), F.coalesce("l", F.lit(-1)).cast("long").alias("label"))
    return out
