"""Clustering comparison, density clustering and vector distances against brute force."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexsense.operators import clusters as C
from lexsense.operators import vectors as V


def pair_counts(t, p):
    n = len(t)
    a = b = c = d = 0
    for i, j in itertools.combinations(range(n), 2):
        st, sp = t[i] == t[j], p[i] == p[j]
        a += st and sp
        b += (not st) and (not sp)
        c += st and not sp
        d += sp and not st
    return a, b, c, d


def ari_ref(t, p):
    a, b, c, d = pair_counts(t, p)
    if c == 0 and d == 0:
        return 1.0
    tp, tn, fn, fp = 2 * a, 2 * b, 2 * c, 2 * d
    return 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))


@pytest.mark.parametrize("seed", range(5))
def test_partition_scores(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for g in ("x", "y"):
        for _ in range(rnd.randint(1, 25)):
            rows.append((g, rnd.randint(-1, 3), rnd.randint(0, 2)))
    df = spark.createDataFrame(rows, "target string, cluster int, label int")
    got = {r.target: r for r in C.partition_scores(C.contingency(df, ["target"]), ["target"]).collect()}
    for g in ("x", "y"):
        t = [r[1] for r in rows if r[0] == g]
        p = [r[2] for r in rows if r[0] == g]
        a, b, c, d = pair_counts(t, p)
        total = a + b + c + d
        ri = 1.0 if total == 0 else (a + b) / total
        pur = sum(max(sum(1 for x, y in zip(t, p) if y == lab and x == cl) for cl in set(t)) for lab in set(p)) / len(t)
        assert got[g].RI == pytest.approx(ri)
        assert got[g].ARI == pytest.approx(ari_ref(t, p))
        assert got[g].PUR == pytest.approx(pur)
        assert 0 <= got[g].RI <= 1 and 0 <= got[g].PUR <= 1


def test_ari_invariant_to_relabelling(spark):
    rows = [("x", c, l) for c, l in [(0, 0), (0, 0), (1, 1), (1, 2), (2, 2), (2, 2)]]
    relab = [("x", c, {0: 7, 1: 5, 2: 9}[l]) for _, c, l in rows]
    s = "target string, cluster int, label int"
    a = C.partition_scores(C.contingency(spark.createDataFrame(rows, s), ["target"]), ["target"]).first()
    b = C.partition_scores(C.contingency(spark.createDataFrame(relab, s), ["target"]), ["target"]).first()
    assert a.ARI == pytest.approx(b.ARI) and a.RI == pytest.approx(b.RI)


def test_apd_closed_form_equals_pairwise(spark):
    rng = np.random.default_rng(0)
    rows = []
    for t in ("a", "b"):
        for g in (1, 2):
            for _ in range(int(rng.integers(1, 7))):
                rows.append((t, g, rng.normal(size=5).astype(float).tolist()))
    df = spark.createDataFrame(rows, "target string, grouping int, embedding array<double>")
    got = {r.target: r.APD for r in V.mean_shift(df, ["target"]).collect()}
    for t in ("a", "b"):
        u = [np.array(v) for tt, g, v in rows if tt == t and g == 1]
        w = [np.array(v) for tt, g, v in rows if tt == t and g == 2]
        pair = np.mean([1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y) for x in u for y in w])
        assert got[t] == pytest.approx(pair, abs=1e-12)


def test_centroid_shift_canberra(spark):
    rows = [("a", 1, 0, [1.0, 0.0]), ("a", 1, 0, [3.0, 0.0]), ("a", 2, 1, [0.0, 0.0]), ("a", 2, 2, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "target string, grouping int, label int, embedding array<double>")
    got = V.centroid_shift(df, ["target"]).first().APDP
    c1 = np.array([2.0, 0.0])

    def canb(x, y):
        return sum(0.0 if abs(a) + abs(b) == 0 else abs(a - b) / (abs(a) + abs(b)) for a, b in zip(x, y))
    assert got == pytest.approx(np.mean([canb(c1, [0, 0]), canb(c1, [2, 2])]))


def dbscan_ref(vecs, eps):
    n = len(vecs)
    x = np.array(vecs, dtype=float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x @ x.T
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, 1]
    adj = (np.maximum(d, np.maximum(core[:, None], core[None, :])) <= eps) & ~np.eye(n, dtype=bool)
    lab = [-1] * n
    for i in range(n):
        if lab[i] != -1 or not adj[i].any():
            continue
        stack, comp = [i], {i}
        while stack:
            k = stack.pop()
            for j in np.nonzero(adj[k])[0]:
                if j not in comp:
                    comp.add(j)
                    stack.append(j)
        m = min(comp)
        for k in comp:
            lab[k] = m
    return lab


@pytest.mark.parametrize("block", [3, 64])
def test_density_clusters_brute_force(spark, block):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(3, 8))
    rows, vecs = [], {"a": [], "b": []}
    for i in range(40):
        t = "a" if i % 2 else "b"
        v = centers[i % 3] + 0.3 * rng.normal(size=8) if i % 5 else rng.normal(size=8)
        rows.append((t, i, v.tolist()))
        vecs[t].append((i, v))
    df = spark.createDataFrame(rows, "target string, id long, embedding array<double>")
    got = {(r.target, r.id): r.label for r in C.density_clusters(df, ["target"], eps=0.3, block=block).collect()}
    for t, items in vecs.items():
        ids = [i for i, _ in items]
        ref = dbscan_ref([v for _, v in items], 0.3)
        want = {ids[k]: (-1 if l == -1 else ids[l]) for k, l in enumerate(ref)}
        assert {i: got[(t, i)] for i in ids} == want


@pytest.mark.parametrize("k", [3, 5])
def test_density_clusters_with_k(spark, k):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 3))
    df = spark.createDataFrame([("t", i, x.tolist()) for i, x in enumerate(v)] + [("few", 0, [1.0, 0.0, 0.0])],
                               "target string, id long, embedding array<double>")
    got = {(r.target, r.id): r.label for r in C.density_clusters(df, ["target"], eps=0.08, k=k, block=16).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, 0)
    dense = np.sort(d, axis=1)[:, k - 1] <= 0.08
    own = np.where(dense, np.arange(60), -1)
    while True:
        new = np.array([min(own[j] for j in range(60) if dense[j] and d[i, j] <= 0.08) if dense[i] else -1 for i in range(60)])
        if (new == own).all():
            break
        own = new
    assert dense.any() and not dense.all()
    assert [got[("t", i)] for i in range(60)] == own.tolist() and got[("few", 0)] == -1


def test_tile_roots_independent_of_side_order():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(2, 25))
        ids = rng.permutation(500)[:n].astype(np.int64)
        a = rng.random((n, n)) < 0.1
        ok = (a | a.T) & ~np.eye(n, dtype=bool)
        base = C._tile_roots(ids, ids, ok, True)
        perm = rng.permutation(n)  # the other side of the block self-join in another order
        got = C._tile_roots(ids, ids[perm], ok[:, perm], True)
        assert dict(zip(*[x.tolist() for x in base])) == dict(zip(*[x.tolist() for x in got]))


def _clustered(spark, m, per=80, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(m // per, dim))
    rows = [("t", i, (centers[i % len(centers)] + 0.02 * rng.normal(size=dim)).tolist()) for i in range(m)]
    return spark.createDataFrame(rows, "target string, id long, v array<double>")


def test_tiles_grow_slowly_on_clustered_vectors(spark):
    made = {}
    for m in (1500, 6000):
        blocks = C.metric_blocks(_clustered(spark, m), ["target"], block=64, spread=0.3)
        made[m] = C.near_tiles(blocks, ["target"], 0.05).count()
        n = blocks.count()
        assert made[m] < n * (n + 1) / 2 / 2  # of all pairs of blocks
    assert np.log(made[6000] / made[1500]) / np.log(4) < 1.5


def test_no_near_pair_is_ruled_out(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=(300, 6)), rng.normal(size=(1, 6)) + 0.1 * rng.normal(size=(100, 6))])
    df = spark.createDataFrame([("ab"[i % 2], i, x.tolist()) for i, x in enumerate(v)], "g string, id long, v array<double>")
    blocks = C.metric_blocks(df, ["g"], block=8, pivots=10)
    rows = blocks.collect()
    assert sorted(i for r in rows for i in r.ids) == list(range(400)) and max(len(r.ids) for r in rows) <= 8
    home = {i: r.blk for r in rows for i in r.ids}
    kept = {(r.bi, r.bj) for r in C.near_tiles(blocks, ["g"], 0.1).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    for i in range(400):
        for j in range(i % 2, 400, 2):
            if d[i, j] <= 0.1:
                assert (min(home[i], home[j]), max(home[i], home[j])) in kept
    assert len(kept) < len(rows) ** 2 / 4


def test_points_without_direction_are_noise(spark):
    rows = [("t", 0, [0.0, 0.0]), ("t", 1, [1.0, 0.0]), ("t", 2, [1.0, 0.01]), ("t", 3, None), ("t", 4, [float("nan"), 1.0]), ("t", 5, [])]
    df = spark.createDataFrame(rows, "target string, id long, embedding array<double>")
    got = {r.id: r.label for r in C.density_clusters(df, ["target"], eps=0.1).collect()}
    assert got == {0: -1, 1: 1, 2: 1, 3: -1, 4: -1, 5: -1}
    assert C.density_clusters(df.limit(0), ["target"]).count() == 0


@pytest.mark.parametrize("shift", [V.mean_shift, V.centroids])
def test_vectors_move_before_they_are_cut_into_components(spark, shift):
    """Rows of single components are made, and added up, where a group's vectors have already met."""
    df = spark.createDataFrame([("a", 1, [1.0, 2.0])], "target string, grouping int, embedding array<double>")
    plan = shift(df, ["target"])._jdf.queryExecution().executedPlan().toString().splitlines()
    cut = max(i for i, x in enumerate(plan) if "Generate" in x)
    assert any("rangepartitioning" in x for x in plan[cut:]), plan


def test_shifts_brute_force(spark):
    """Usages of a gloss weigh as often as they occur; null components and vectors; more components than a chunk."""
    from lexsense.operators import senses as SE
    dim = 2 * V.CHUNK + 3
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(60, dim))
    rows = [(f"g{i}", v.tolist()) for i, v in enumerate(vecs)] + [("none", None)]
    vectors = spark.createDataFrame(rows, "gloss string, embedding array<double>")
    use = [(f"t{i % 3}", i, 1 + (i // 3) % 2, 0, f"g{i % 60}" if i < 200 else "none") for i in range(210)]
    u = spark.createDataFrame(use, "target string, line_no long, grouping int, cluster int, gloss string")
    number = F.expr("cast(substring(gloss, 2) as int)")
    labels = u.select("target", "gloss", F.when(F.col("gloss") == "none", 9).otherwise(number % 4).alias("label")).distinct()
    _, _, scores = SE.sense_scores(u, vectors, ["target"], labels)
    got = {r.target: r for r in scores.collect()}
    for t in ("t0", "t1", "t2"):
        mine = [x for x in use if x[0] == t and x[4] != "none"]
        first, cells = {}, {}
        for _, _, g, _, gloss in mine:
            i = int(gloss[1:])
            first.setdefault(i, g)
            cells.setdefault((g, i % 4), []).append(vecs[i])
        unit = {p: [vecs[i] / np.linalg.norm(vecs[i]) for i, g in first.items() if g == p] for p in (1, 2)}
        assert got[t].APD == pytest.approx(float(np.mean([1 - a @ b for a in unit[1] for b in unit[2]])))
        mean = {k: np.mean(v, axis=0) for k, v in cells.items()}
        far = [float((np.abs(a - b) / (np.abs(a) + np.abs(b))).sum()) for p, a in mean.items() for q, b in mean.items() if p[0] == 1 and q[0] == 2]
        assert got[t].APDP == pytest.approx(float(np.mean(far)))
