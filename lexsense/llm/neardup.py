"""Near-duplicates by SetSketch registers, bands, joint likelihood and exact verification (operator 4).

A document's set holds the distinct hashes of its ``shingle``-word shingles (lower-case A-Z). Equal sets
are one class. A register holds the truncated, exponentially spaced minimum of one hash function over the
set: floor(-log_BASE(min)), so registers of unions are maxima (mergeable) and equal registers are as
likely as the sets are similar (locality-sensitive). Bands of registers give candidate edges to one class
of each bucket, and these the candidate components, which hold every candidate pair. Components are cut
into blocks; a task takes two blocks, keeps pairs that the joint likelihood of their registers doesn't
rule out, verifies them on the full sets (products of incidence matrices) and returns for each class its
root in the tile: never pairs. With 32 bands of 7 registers a pair at similarity 0.85 is missed with a
probability of 3e-6; verification is exact up to 64-bit hashes.

Defined results: null and empty texts, and texts without words: no shingles, no links, own component.
Texts with fewer words than a shingle: the whole sequence is the one shingle. Documents with equal doc_id
count as one. A null doc_id links with nothing. Extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsense.llm import flat
from lexsense.llm.bloom import thin
from lexsense.llm.graph import components

BANDS, ROWS = 32, 7
REGISTERS = BANDS * ROWS
BASE = 1.1  # registers stay below 256
BLOCK, BLOCK_BYTES = 1024, 8 << 20
SMALL = 64  # components up to this size share tasks

_RNG = np.random.default_rng(4)
_XOR = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_MUL = (_RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    low = flat.LOWER[data]
    start, end, row = flat.word_spans(data, off)
    w = flat.span_hash(flat.prefix_hash(low), start, end)
    n = len(off) - 1
    cut = np.searchsorted(row, np.arange(n + 1))
    step = np.uint64(0x9E3779B97F4A7C15)
    run = np.zeros(len(w), np.uint64)  # hash of the k words from here (or of all, where a row has fewer)
    for j in range(min(k, len(w))):
        run[:len(w) - j] = flat.mix(run[:len(w) - j] + w[j:] * (step + np.uint64(2 * j))) if j else flat.mix(w * step)
    out = []
    for i in range(n):
        a, b = cut[i], cut[i + 1]
        if b - a >= k:
            out.append(np.unique(run[a:b - k + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for x in w[a:b]:
                h = flat.mix(np.array([h + x * step], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(s: np.ndarray) -> np.ndarray:
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(x), 512):
        np.minimum(low, ((x[a:a + 512, None] ^ _XOR) * _MUL).min(0), out=low)
    return np.floor(-np.log((low + 1.0) / 4294967296.0) / np.log(BASE)).astype(np.uint8)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    with np.errstate(over="ignore"):
        a = flat.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))
        b = flat.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketches(documents: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, k1, k2, regs) of every row; null keys where there are no shingles."""
    flat.prepare(documents.sparkSession)

    def run(batches):
        for batch in batches:
            data, off = flat.flat(batch.column(1))
            n, k1, k2, regs = [], [], [], []
            for a, b in flat.chunks(off):
                for s in shingle_sets(data[off[a]:off[b]], off[a:b + 1] - off[a], shingle):
                    n.append(len(s))
                    x, y = set_key(s) if len(s) else (None, None)
                    k1.append(x)
                    k2.append(y)
                    regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(regs, pa.binary())], ["doc_id", "n", "k1", "k2", "regs"])

    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, n long, k1 long, k2 long, regs binary"))


def _bands(batches):
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BANDS, ROWS).astype(np.uint64)
        h = np.tile(np.arange(BANDS, dtype=np.uint64), (len(key), 1))
        for j in range(ROWS):
            h = flat.mix(h * np.uint64(257) + regs[:, :, j] + np.uint64(1))
        yield pa.RecordBatch.from_arrays([pa.array(h.ravel().astype(np.int64)), pa.array(np.repeat(key, BANDS))], ["band", "key"])


def likely(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, share: float, slack: float = 14.0) -> np.ndarray:
    """Pairs whose registers don't rule a similarity of ``share`` or more out: the best likelihood at
    such similarities is within ``slack`` (log) of the best of all. Sizes of the sets are known."""
    more, less = (ra > rb).sum(1), (ra < rb).sum(1)
    same = REGISTERS - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    best_all, best_high = np.full(len(ra), -np.inf), np.full(len(ra), -np.inf)
    for j in np.r_[np.linspace(0.05, share, 18, endpoint=False), np.linspace(share, 1, 12)]:
        p, q = np.maximum(chance(u - v * j), 1e-4), np.maximum(chance(v - u * j), 1e-4)
        like = more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-4))
        best_all = np.maximum(best_all, like)
        if j >= share:
            best_high = np.maximum(best_high, like)
    return best_high >= best_all - slack


def verified(sets: list[np.ndarray], regs: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether each pair (left x right, places in ``sets``) has 100 * common >= percent * union."""
    n = np.array([len(s) for s in sets])
    on = np.zeros((len(left), len(right)), bool)
    for r, i in enumerate(left):
        c = np.flatnonzero((regs[i] == regs[right]).sum(1) >= 0.6 * REGISTERS * percent / 100)
        c = c[(np.minimum(n[right[c]], n[i]) * 100 >= percent * np.maximum(n[right[c]], n[i])) & (right[c] != i)]
        if len(c):
            on[r, c] = likely(regs[np.full(len(c), i)], regs[right[c]], np.full(len(c), n[i]), n[right[c]], percent / 100)
    rows, cols = np.flatnonzero(on.any(1)), np.flatnonzero(on.any(0))
    if not len(rows):
        return on
    used = np.unique(np.r_[left[rows], right[cols]])
    item = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), n[used])
    order = np.argsort(item, kind="stable")
    item, owner = item[order], owner[order]
    first = np.r_[True, item[1:] != item[:-1]]
    column = np.cumsum(first) - 1
    count = np.bincount(column)
    keep = (count > 1)[column]
    column, owner = (np.cumsum(count > 1) - 1)[column[keep]], owner[keep]
    common = np.zeros((len(rows), len(cols)), np.float32)
    at_left, at_right = np.searchsorted(used, left[rows]), np.searchsorted(used, right[cols])
    step = max(256, (32 << 20) // (4 * len(used)))
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + step + 1, step))
    for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            m = np.zeros((len(used), step), np.float32)
            m[owner[a:b], column[a:b] - c * step] = 1
            common += m[at_left] @ m[at_right].T
    common = np.rint(common).astype(np.int64)
    union = n[left[rows]][:, None] + n[right[cols]][None] - common
    out = np.zeros_like(on)
    out[np.ix_(rows, cols)] = (100 * common >= percent * union) & on[np.ix_(rows, cols)]
    return out


def _tile(shingle: int, percent: int):
    def run(t: pd.DataFrame) -> pd.DataFrame:
        column = pa.array(t["text"], pa.string())
        data, off = flat.flat(column)
        sets = [s for a, b in flat.chunks(off) for s in shingle_sets(data[off[a]:off[b]], off[a:b + 1] - off[a], shingle)]
        key = t["key"].to_numpy()
        right_text = np.array([bool(len(s)) and set_key(s)[0] == k for s, k in zip(sets, key, strict=True)], bool)
        regs = np.frombuffer(b"".join(t["regs"]), np.uint8).reshape(-1, REGISTERS)
        comp, block = t["component"].to_numpy(), t["block"].to_numpy()
        i, j = t["i"].iat[0], t["j"].iat[0]
        a_out, b_out = [], []
        order = np.argsort(comp, kind="stable")
        for g in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            g = g[right_text[g]]
            _, u = np.unique(key[g], return_index=True)
            g = g[u]
            left, right = g[block[g] == i], g[block[g] == j]
            if len(left) and len(right):
                x, y = np.nonzero(verified(sets, regs, left, right, percent))
                x, y = left[x], right[y]
                own = np.arange(len(key))
                while len(x):  # roots within the tile
                    low = np.minimum(own[x], own[y])
                    new = own.copy()
                    np.minimum.at(new, x, low)
                    np.minimum.at(new, y, low)
                    if (new == own).all():
                        break
                    own = new
                hit = np.unique(np.r_[x, y])
                a_out.append(key[hit])
                b_out.append(key[own[hit]])
        cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        return pd.DataFrame({"a": cat(a_out), "b": cat(b_out)})
    return run


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row. Links: 100 * common >= percent * union."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = sketches(documents, shingle).checkpoint()
    known = rows.where("k1 IS NOT NULL AND doc_id IS NOT NULL")
    classes = (known.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"),
                                             F.first("regs").alias("regs")).drop("k2")
               .withColumnRenamed("k1", "key").checkpoint())
    bands = classes.select("key", "regs").mapInArrow(_bands, "band long, key long")
    buckets = bands.groupBy("band").agg(F.min("key").alias("center"), F.max("key").alias("_m")).where("center < _m")
    star = (bands.join(buckets, "band").where("key <> center")
            .select(F.col("key").alias("a"), F.col("center").alias("b")).distinct().checkpoint())
    # a document id with several texts joins its classes, too
    several = known.groupBy("doc_id").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a < b")
    several = known.join(several, "doc_id").select(F.col("k1").alias("a"), "b").where("a <> b").checkpoint()
    group = components(star)
    members = (group.join(classes, group["node"] == classes["key"])
               .select("key", "component", "first", "regs").checkpoint())
    texts = thin(documents.where("doc_id IS NOT NULL"), members.select(F.col("first").alias("doc_id")), "doc_id")
    full = members.join(texts, members["first"] == texts["doc_id"]).drop("doc_id", "first")
    sizes = (full.groupBy("component").agg(
        F.count("*").alias("k"), F.greatest(F.ceil(F.count("*") / BLOCK),
                                            F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks"))
        .checkpoint())
    bins = F.lit(int(sizes.where(f"k <= {SMALL}").agg(F.sum("k")).first()[0] or 0) // 512 + 1)
    small = (F.col("k") <= SMALL) & (F.col("blocks") == 1)
    tiles = (full.join(sizes, "component")
             .withColumn("bin", F.when(small, -1 - F.pmod(F.xxhash64("component"), bins)).otherwise(F.col("component")))
             .withColumn("small", small)
             .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    links = (tiles.groupBy("small", "bin", "i", "j").applyInPandas(_tile(shingle, percent), "a long, b long")
             .union(several).checkpoint())
    comp = components(links)
    first = classes.select(F.col("key").alias("node"), "first")
    root = comp.join(first, "node").groupBy("component").agg(F.min("first").alias("component_id"))
    found = comp.join(root, "component").select(F.col("node").alias("k1"), "component_id")
    alone = classes.join(comp, classes["key"] == comp["node"], "left_anti").select(
        F.col("key").alias("k1"), F.col("first").alias("component_id"))
    return (rows.join(found.union(alone), "k1", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def one_of_each(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows, all columns, of one document of each group of near-duplicates (the smallest doc_id)."""
    out = near_duplicates(documents, shingle, percent).where(~F.col("kept")).select("doc_id").distinct()
    return documents.join(out, "doc_id", "left_anti").select(*documents.columns)


def op4_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
    ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
c(m, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.m WHERE c.r < l.b),
k AS (SELECT m, min(r) AS r FROM c GROUP BY m)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.r AS component_id, k.r = d.doc_id AS kept
FROM d JOIN k ON k.m = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
