"""Quality classifier: a factorisation machine over hashed words and structure statistics (operator 10).

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise
interactions in time linear in the document's features. Inputs are the words (lower-case, hashed to
``BUCKETS``; x = sqrt of the word's share) and binned statistics of the whole text. Fitted on a
bounded sample of labelled rows outside the held-out quarter.

Defined results: null and empty texts get the score of the empty text; without labels of both
classes every score is the share of label 1 (0.5 with no label). Extra columns are ignored, rows are
scored one by one.
"""
from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsense.llm import flat

BUCKETS = 4096
BINS = 12
STATS = ("log_bytes", "log_words", "word_bytes", "words_a_line", "symbols", "capitals", "digits", "bars",
         "wide", "echo", "distinct", "stops")
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>!@~^{}[]=+_\\"))
_CAPITAL = np.isin(np.arange(256), range(65, 91))
_DIGIT = np.isin(np.arange(256), range(48, 58))
_STOP = np.isin(np.arange(256), list(b".?;:"))


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, x) of the hashed words, and the statistics (rows x STATS) of each row."""
    n = len(off) - 1
    size = np.diff(off)
    start, end, row = flat.word_spans(data, off)
    h = flat.span_hash(flat.prefix_hash(flat.LOWER[data]), start, end)
    words = np.bincount(row, minlength=n)
    key, count = np.unique(row * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    at = key // BUCKETS
    x = np.sqrt(count / words[at]).astype(np.float32)

    def share(mask):
        total = np.concatenate(([0], np.cumsum(mask[data])))
        return (total[off[1:]] - total[off[:-1]]) / np.maximum(size, 1)

    per_word = np.maximum(words, 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    lines = share(np.arange(256) == 10) * size + 1
    stats = np.stack([
        np.log1p(size), np.log1p(words), np.bincount(row, end - start, n) / per_word, words / lines,
        share(_SYMBOL), share(_CAPITAL), share(_DIGIT), share(np.arange(256) == ord("|")),
        share(np.arange(256) > 127), np.bincount(row, same, n) / per_word,
        np.bincount(at, minlength=n) / per_word, share(_STOP)], 1)
    return at, key % BUCKETS, x, stats


class Machine:
    """Fitted weights; dimensions: hashed words, then BINS bins of each statistic."""

    def __init__(self, edges: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.edges, self.bias, self.w, self.v = edges, bias, w, v

    def dims(self, stats: np.ndarray) -> np.ndarray:
        return np.stack([BUCKETS + k * BINS + np.searchsorted(self.edges[k], stats[:, k], "right")
                         for k in range(len(STATS))], 1)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, word, x, stats = features(data, off)
        n = len(off) - 1
        binned = self.dims(stats)
        out = self.bias + self.w[binned].sum(1) + np.bincount(row, self.w[word] * x, n)
        for f in range(self.v.shape[1]):
            v = self.v[:, f]
            vx, vb = v[word] * x, v[binned]
            total = np.bincount(row, vx, n) + vb.sum(1)
            squares = np.bincount(row, vx * vx, n) + (vb * vb).sum(1)
            out += 0.5 * (total * total - squares)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(rows: list, prior: tuple[float, float], factors: int = 6, steps: int = 120, rate: float = 0.05,
        decay: float = 2e-3) -> Machine:
    """Adam on the weighted logistic loss. ``rows``: (label, words, x, statistics) of the sample;
    ``prior``: the labels' counts in all training rows, so that scores are calibrated to them."""
    width = BUCKETS + BINS * len(STATS)
    y = np.array([r[0] for r in rows], np.float32)
    total = sum(prior)
    base = float(np.clip(prior[1] / total if total else 0.5, 1e-4, 1 - 1e-4))
    bias = np.log(base / (1 - base))
    blank = Machine(np.zeros((len(STATS), BINS - 1)), bias, np.zeros(width, np.float32),
                    np.zeros((width, factors), np.float32))
    if len(set(y.tolist())) < 2:
        return blank
    stats = np.array([r[3] for r in rows])
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    model = Machine(np.sort(edges, 1), bias, blank.w, blank.v)
    x = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        x[i, r[1]] = r[2]
    x[np.arange(len(rows))[:, None], model.dims(stats)] = 1
    weight = np.where(y == 1, prior[1] / max((y == 1).sum(), 1), prior[0] / max((y == 0).sum(), 1))
    weight = (weight / weight.sum()).astype(np.float32)
    rng = np.random.default_rng(10)
    w, v = np.zeros(width, np.float32), rng.normal(0, 0.02, (width, factors)).astype(np.float32)
    b, m, s = np.float32(bias), [0, 0, 0], [0, 0, 0]
    x2 = x * x
    for t in range(1, steps + 1):
        xv = x @ v
        out = b + x @ w + 0.5 * ((xv * xv).sum(1) - (x2 @ (v * v)).sum(1))
        g = weight * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y)
        grads = [x.T @ g + decay * w * 0.1, x.T @ (g[:, None] * xv) - (x2.T @ g)[:, None] * v + decay * v, g.sum()]
        new = []
        for k, (p, d) in enumerate(zip((w, v, b), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * d
            s[k] = 0.99 * s[k] + 0.01 * d * d
            new.append(p - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.99 ** t)) + 1e-6))
        w, v, b = new
    return Machine(model.edges, float(b), w.astype(np.float32), v.astype(np.float32))


def train(documents: DataFrame, labels: DataFrame, per_class: int = 1500) -> Machine:
    """Fit on about ``per_class`` labelled documents of each class (the bound of the sample), in one task: neither
    their texts nor their features come to the driver, only the fitted machine."""
    flat.prepare(documents.sparkSession)

    def rows(batches):
        for batch in batches:
            data, off = flat.flat(batch.column(1))
            out = []
            for a, b in flat.chunks(off):
                row, word, x, stats = features(data[off[a]:off[b]], off[a:b + 1] - off[a])
                cut = np.searchsorted(row, np.arange(b - a + 1))
                out += [(word[cut[i]:cut[i + 1]], x[cut[i]:cut[i + 1]], stats[i]) for i in range(b - a)]
            word, x, stats = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(word, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32())),
                pa.array(stats, pa.list_(pa.float64()))], ["label", "word", "x", "stats"])

    sample = (flat.labelled(documents, labels, "quality", per_class, 10)
              .select("label", "text").mapInArrow(rows, "label int, word array<int>, x array<float>, stats array<double>"))
    n = {r["label"]: r["n"] for r in
         labels.where(F.col("quality").isin(0, 1) & ~flat.held_out(F.col("doc_id")))
         .groupBy(F.col("quality").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    prior = n.get(0, 0), n.get(1, 0)

    def fitted(batches):
        got = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_pydict({"machine": [pickle.dumps(fit(got, prior))]})

    machine = sample.repartition(1).mapInArrow(fitted, "machine binary").collect()
    return pickle.loads(machine[0]["machine"]) if machine else fit([], prior)


def score(documents: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, score) of every row: the probability of label 1."""
    spark = documents.sparkSession
    flat.prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # width x factors floats, fixed by the constants above

    def run(batches):
        for batch in batches:
            data, off = flat.flat(batch.column(1))
            out = [shared.value.score(data[off[a]:off[b]], off[a:b + 1] - off[a]) for a, b in flat.chunks(off)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "score"])

    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, score double"))


def good_quality(documents: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows, all columns, whose text scores ``least`` or more."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels))
    return flat.passing(documents, lambda: lambda data, off: shared.value.score(data, off) >= least)


def op10_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", flat.held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= 0.7).cast("int").alias("predicted"))
