"""Toxicity: a subsequence-kernel support vector machine with Nyström landmarks (operator 3).

The kernel of two words sums, over all common letter triples (gaps allowed, within ``SPAN`` letters), DECAY
to the power of the spans in letters and GAP to that of the characters inserted between, and is divided by
the words' norms: ``i--d..i*o t`` still matches ``idiot``, however many characters are inserted. Landmarks
are words of labelled text; a text's kernel value
with a landmark is that of its best matching unit (a word, or a run of one-character words together;
units of more than ``WINDOW`` letters, and landmarks alike, in overlapping windows; units of scripts without
spaces in short ones, too),
which makes the text a bag of its sentences' units. The Nyström map of these values feeds a linear
SVM with squared hinge loss; a sigmoid turns margins into probabilities.

Letters outside ASCII are told by their last two bytes, hashed to ``MARKS`` classes. Equal triples are added before
they are squared, so a word's kernel with itself is 1. Ties of landmark scores are ordered by the word.

Defined results: null, empty and unmatched texts get the score of a text without any match; without
labels of both classes every score is the share of label 1. Rows are scored one by one.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsense.llm import flat

MARKS = 37  # classes of non-ASCII letters; the letters of one alphabet of two bytes each fall into different ones
FIRST, LAST = 27 + MARKS, 28 + MARKS  # the unit's two edges count as letters
LETTERS = 29 + MARKS
SPAN = 6
DECAY = 0.7
GAP = 0.9
FLOOR = 0.6  # kernel values below it count as no match
DENSITY = 20.0
CLEARED = 400_000  # hashes kept by a worker between chunks
WINDOW = 24  # longer units are read in overlapping windows of so many letters

WIDE = (6, 8)  # letters of the windows over units of scripts without spaces (a character of three bytes has two)
_CLASS = np.zeros(256, np.int32)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter class of each byte (0: not the last byte of a letter), and the running count of other characters."""
    cls = _CLASS[data]
    other = (data < 128) & (cls == 0)
    follows = np.flatnonzero((data & 0xC0) == 0x80)  # a letter is told by its last two bytes
    cls[follows] = 27 + (data[follows].astype(np.int32) + 27 * data[follows - 1].astype(np.int32)) % MARKS
    after = np.r_[data[1:], np.zeros(min(len(data), 1), np.uint8)]
    # signs and symbols of two, three and four bytes: U+0080 on, U+2000 on, U+3000 on, U+1F000 on
    for lead, low, high, size in ((0xC2, 128, 191, 2), (0xE2, 128, 175, 3), (0xE3, 128, 128, 3), (0xF0, 159, 159, 4)):
        at = np.flatnonzero((data == lead) & (after >= low) & (after <= high))
        other[at] = True
        for k in range(1, size):
            cls[np.minimum(at + k, len(data) - 1)] = 0
    return cls, np.cumsum(other)


def units(data: np.ndarray, off: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each unit: a word, or three or more in a row of one character, or of one letter
    and up to two signs, as one."""
    start, end, row = flat.word_spans(data, off)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # bytes that start a character
    size = heads[end] - heads[start]
    sign = np.concatenate(([0], other))
    single = (size == 1) | ((size <= 3) & (size - (sign[end] - sign[start]) == 1))
    if single.any():
        chain = single & np.r_[False, single[:-1] & (row[1:] == row[:-1])]
        head = np.flatnonzero(single & ~chain)
        tail = np.flatnonzero(single & ~np.r_[chain[1:], False])
        long = tail - head >= 2
        if long.any():
            drop = np.zeros(len(start), bool)
            for h, t in zip(head[long], tail[long], strict=True):
                end[h] = end[t]
                drop[h + 1:t + 1] = True
            start, end, row = start[~drop], end[~drop], row[~drop]
    return start, end, row


def windows(data: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units as ranges of ``place``, the letters' places: first, size and row, of WINDOW letters at most; units with
    characters of three bytes, which are not cut at words, also in windows of the sizes in WIDE."""
    begin = np.searchsorted(place, start)
    length = np.searchsorted(place, end) - begin
    wide = np.concatenate(([0], np.cumsum(data >= 0xE3)))
    wide = wide[end] > wide[start]
    found = []
    for width, step, pick in ((WINDOW, WINDOW // 2, np.ones(len(length), bool)), *((w, 2, wide & (length > w)) for w in WIDE)):
        first, size, own = begin[pick], length[pick], row[pick]
        if len(size) and size.max() > width:
            parts = np.maximum(1, -(-(size - width) // step) + 1)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first, size = np.repeat(first, parts) + nth * step, np.minimum(np.repeat(size, parts) - nth * step, width)
            own = np.repeat(own, parts)
        found.append((first, size, own))
    return tuple(np.concatenate(x) for x in zip(*found))


def triples(chars: np.ndarray, gaps: np.ndarray | None = None):
    """For each pair of distances: the triple codes (units x positions; 0 if not three letters) and their weights."""
    width = chars.shape[1]
    for a, b in _GAPS:
        m = width - a - b
        if m > 0:
            x, y, z = chars[:, :m], chars[:, a:a + m], chars[:, a + b:]
            weight = np.full((1, m), DECAY ** (a + b + 1), np.float32)
            if gaps is not None:
                weight = weight * np.float32(GAP) ** (gaps[:, a + b:] - gaps[:, :m])
            yield np.where((x > 0) & (y > 0) & (z > 0), (x * LETTERS + y) * LETTERS + z, 0), weight


def matrix(cls: np.ndarray, other: np.ndarray, place: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Letter classes of units of 1 to ``width`` letters, between their edges (units x width + 2), and the
    other characters before each letter (None if no unit has one inside)."""
    n = size[:, None]
    col = np.arange(width + 2)
    at = place[first[:, None] + np.clip(col - 1, 0, n - 1)]
    out = np.where((col > 0) & (col <= n), cls[at], 0)
    out[:, 0] = FIRST
    out[col == n + 1] = LAST
    gaps = (other[at] - other[at[:, :1]]).astype(np.float32)
    return out, gaps if gaps.any() else None


def word_matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
    """``matrix`` of words of WINDOW letters at most (see ``parts``)."""
    end = np.cumsum([len(w.encode()) for w in words])
    data = np.frombuffer("".join(words).encode(), np.uint8)
    cls, other = classes(data)
    place = np.append(np.flatnonzero(cls), 0)
    first = np.searchsorted(place[:-1], np.r_[0, end[:-1]])
    size = np.minimum(np.searchsorted(place[:-1], end) - first, WINDOW)
    return matrix(cls, other, place, first, size, WINDOW)


def parts(words: list[str]) -> list[str]:
    """Words whole, or longer ones in overlapping windows of WINDOW letters, as units are read; each once."""
    out: dict[str, None] = {}
    for w in words:
        n = WINDOW if all(ord(c) < 0x800 for c in w) else WINDOW // 2  # two letters a character of three bytes
        out.update(dict.fromkeys(w[k:k + n] for k in range(0, max(1, len(w) - n // 2), n // 2)))
    return list(out)


def norms(chars: np.ndarray, gaps: np.ndarray | None) -> np.ndarray:
    """Length of each unit's vector: the weights of equal triples are added before they are squared."""
    found = [(code, np.broadcast_to(weight, code.shape)) for code, weight in triples(chars, gaps)]
    if not found or not len(chars):
        return np.full(len(chars), 1e-4)
    code, weight = (np.concatenate(x, 1) for x in zip(*found))
    order = np.argsort(code, axis=1)
    code, weight = np.take_along_axis(code, order, 1), np.take_along_axis(weight, order, 1).astype(float)
    new = np.ones(code.shape, bool)
    new[:, 1:] = code[:, 1:] != code[:, :-1]
    at = np.flatnonzero(new.ravel())
    total = np.add.reduceat(weight.ravel(), at) * (code.ravel()[at] > 0)
    return np.sqrt(np.bincount(at // code.shape[1], total * total, len(chars)) + 1e-9)


class Model:
    def __init__(self, landmarks: list[str]):
        self.landmarks = raw = parts(landmarks)
        chars, gaps = word_matrix(raw) if raw else (np.zeros((0, WINDOW + 2), np.int32), None)
        found = [(code, np.broadcast_to(weight, code.shape)) for code, weight in triples(chars, gaps)]
        codes = np.unique(np.concatenate([c.ravel() for c, _ in found])) if found else np.zeros(1, int)
        codes = codes[codes > 0]
        self.index = np.zeros(LETTERS ** 3, np.int32)  # row of a triple in ``phi``; 0: in no landmark
        self.index[codes] = np.arange(1, len(codes) + 1)
        self.phi = np.zeros((len(codes) + 1, len(raw)), np.float32)
        for code, weight in found:
            np.add.at(self.phi, (self.index[code], np.arange(len(raw))[:, None]), weight)
        self.phi[0] = 0
        self.phi /= np.sqrt((self.phi.astype(float) ** 2).sum(0) + 1e-9).astype(np.float32)
        self.top = np.zeros(LETTERS ** 3, np.float32)
        self.top[codes] = self.phi[1:].max(1) if len(raw) else 0
        phi = self.phi.T
        gram = (phi @ phi.T).astype(float)
        value, vector = np.linalg.eigh(gram) if len(raw) else (np.zeros(0), np.zeros((0, 0)))
        inverse = np.where(value > 1e-3, 1 / np.sqrt(np.maximum(value, 1e-3)), 0)
        half = (vector * inverse) @ vector.T
        self.nystrom = np.kron(np.eye(2), half)  # for the best unit and for the mean
        groups: list[list[int]] = []  # of landmarks alike: their common maximum is a bound near their values
        for i in range(len(raw)):
            near = next((g for g in groups if gram[g[0], i] >= 0.35), None)
            near.append(i) if near else groups.append([i])
        self.tops = np.stack([self.phi[:, g].max(1) for g in groups], 1) if groups else self.phi
        self.cleared = np.zeros(0, np.uint64)
        self.w, self.b, self.slope, self.shift = np.zeros(2 * len(raw)), 0.0, 0.0, 0.0

    def kernel(self, chars: np.ndarray, gaps: np.ndarray | None, table: np.ndarray) -> np.ndarray:
        """Kernel values of units against the columns of ``table`` (rows as in ``phi``)."""
        out = np.zeros((len(chars), table.shape[1]), np.float32)
        for code, weight in triples(chars, gaps):
            at, weight = self.index[code], np.broadcast_to(weight, code.shape)
            for p in range(at.shape[1]):
                on = np.flatnonzero(at[:, p])
                out[on] += weight[on, p][:, None] * table[at[on, p]]
        return out / norms(chars, gaps).astype(np.float32)[:, None]

    def values(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Kernel values of each row with each landmark, 0 under FLOOR: that of the row's best unit, and
        the mean over its units (times DENSITY, 1 at most)."""
        out = np.zeros((len(off) - 1, len(self.landmarks)), np.float32)
        mean = np.zeros_like(out)
        if not self.landmarks:
            return out
        cls, other = classes(data)
        place = np.append(np.flatnonzero(cls), 0)
        begin, letters, row = windows(data, place[:-1], *units(data, off, other))
        start = place[begin]
        end = np.where(letters > 0, place[begin + np.maximum(letters, 1) - 1] + 1, start)
        h = flat.span_hash(flat.prefix_hash(flat.LOWER[data]), start, end)
        key, first, back = np.unique(h, return_index=True, return_inverse=True)
        size = letters[first]
        inner = other[end[first] - 1] > other[start[first]] if len(other) else size > 0
        if len(self.cleared):  # units of earlier chunks known to match nothing
            size[self.cleared[np.minimum(np.searchsorted(self.cleared, key), len(self.cleared) - 1)] == key] = 0
        found = np.full(len(first), -1)
        kernels: list[np.ndarray] = []
        done = 0
        low = 2
        for high in (6, 8, 10, 13, 17, WINDOW):
            fit = (size > low) & (size <= high)
            low = high
            picks = [np.flatnonzero(fit & ~inner), np.flatnonzero(fit & inner)]
            for part in (x for pick in picks for x in np.array_split(pick, len(pick) // 8192 + 1)):
                if not len(part):
                    continue
                chars, gaps = matrix(cls, other, place, begin[first[part]], size[part], high)
                upper, norm = np.zeros(len(part), np.float32), np.full(len(part), 1e-9, np.float32)
                for code, weight in triples(chars, gaps):
                    if gaps is None:
                        upper += weight[0, 0] * self.top[code].sum(1)
                        norm += weight[0, 0] ** 2 * (code > 0).sum(1)
                    else:
                        upper += (weight * self.top[code]).sum(1)
                        norm += (weight * weight * (code > 0)).sum(1)
                # a bound of all kernel values; ``norm`` takes equal triples apart, so it is never too large
                keep = np.flatnonzero(upper >= FLOOR * np.sqrt(norm))
                if len(keep):  # a nearer bound
                    some = gaps if gaps is None else gaps[keep]
                    keep = keep[self.kernel(chars[keep], some, self.tops).max(1) >= FLOOR]
                if len(keep):
                    k = self.kernel(chars[keep], gaps if gaps is None else gaps[keep], self.phi)
                    hit = k.max(1) >= FLOOR
                    found[part[keep[hit]]] = done + np.arange(hit.sum())
                    done += hit.sum()
                    kernels.append(np.where(k[hit] >= FLOOR, k[hit], 0))
        self.cleared = np.union1d(self.cleared if len(self.cleared) < CLEARED else self.cleared[:0], key[found < 0])
        if done:
            where = found[back]
            on = where >= 0
            k = np.concatenate(kernels)[where[on]]
            np.maximum.at(out, row[on], k)
            np.add.at(mean, row[on], k)
            mean /= np.maximum(np.bincount(row, minlength=len(out)), 1)[:, None]
        return np.concatenate([out, np.minimum(mean * DENSITY, 1)], 1)

    def margin(self, values: np.ndarray) -> np.ndarray:
        return (values @ self.nystrom) @ self.w + self.b

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(self.values(data, off)) + self.shift, -30, 30)))

    def fit(self, values: np.ndarray, y: np.ndarray, prior: tuple[float, float], cost: float = 20.0) -> None:
        """Squared hinge by gradient descent with momentum, classes weighted equally; then the sigmoid,
        weighted to the labels' real shares (``prior``)."""
        total = sum(prior)
        base = float(np.clip(prior[1] / total if total else 0.5, 1e-4, 1 - 1e-4))
        self.shift = float(np.log(base / (1 - base)))
        if len(set(y.tolist())) < 2 or not self.landmarks:
            return
        x = np.c_[values @ self.nystrom, np.ones(len(y))]
        sign = np.where(y == 1, 1.0, -1.0)
        weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
        ridge = np.r_[np.ones(len(w) - 1), 0] / cost
        rate = 1 / (2 * np.linalg.eigvalsh((x * weight[:, None]).T @ x).max() + ridge.max())
        for _ in range(800):
            slack = np.maximum(0, 1 - sign * (x @ w))
            speed = 0.9 * speed - rate * (ridge * w * 0.1 - 2 * x.T @ (weight * sign * slack))
            w = w + speed
        self.w, self.b = w[:-1], float(w[-1])
        f = x @ w
        real = np.where(y == 1, prior[1] / (y == 1).sum(), prior[0] / (y == 0).sum())
        real /= real.sum()
        z, p = np.c_[f, np.ones(len(f))], np.array([1.0, self.shift])
        for _ in range(50):  # Newton steps of the logistic fit
            q = 1 / (1 + np.exp(-np.clip(z @ p, -30, 30)))
            grad = z.T @ (real * (q - y)) + 1e-4 * np.array([p[0], 0])
            hess = (z * (real * q * (1 - q))[:, None]).T @ z + 1e-4 * np.eye(2)
            p = p - np.clip(np.linalg.solve(hess, grad), -1, 1)
        self.slope, self.shift = float(max(p[0], 0)), float(p[1])


def choose_landmarks(sample: DataFrame, toxic: int = 64, clean: int = 12, pool: int = 4000) -> list[str]:
    """Words of the labelled sample found clearly more often in documents of label 1; then, of the
    ``pool`` most frequent clean words, those nearest to them by the kernel (look-alikes)."""
    text = F.coalesce(F.lower("text"), F.lit(""))
    word = (sample.select("doc_id", "label", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\p{L}{3,})"), 1))).alias("word"))
            .groupBy("word").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")).persist())
    total = sample.agg(F.sum("label").alias("t1"), F.sum(1 - F.col("label")).alias("t0")).first()
    t1, t0 = float(total["t1"] or 0), float(total["t0"] or 0)
    if not t1 or not t0:
        return []
    p1, p0 = (F.col("n1") + 0.5) / (t1 + 1), (F.col("n0") + 0.5) / (t0 + 1)
    z = (p1 - p0) / F.sqrt(p1 * (1 - p1) / t1 + p0 * (1 - p0) / t0 + 0.02 / t1)
    best = [r["word"] for r in word.where((p1 > 8 * p0) & (F.col("n1") > 1)).orderBy(z.desc(), "word").limit(toxic).collect()]
    usual = [r["word"] for r in word.where(p0 > p1).orderBy(F.desc("n0"), "word").limit(pool).collect()]
    word.unpersist()
    if not best or not usual:
        return best
    model = Model(best)
    near = model.kernel(*word_matrix(usual), model.phi).max(1)
    return best + [usual[i] for i in np.argsort(-near, kind="stable")[:clean] if near[i] >= FLOOR]


def _values(model, rows):
    """mapInArrow function: column 0 kept, column 1 (text) replaced by kernel values."""
    def run(batches):
        for batch in batches:
            data, off = flat.flat(batch.column(1))
            out = [model.value.values(data[off[a]:off[b]], off[a:b + 1] - off[a]) for a, b in flat.chunks(off)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v.tolist() for x in out for v in x], pa.list_(pa.float32()))], ["label", "k"])
    return rows.mapInArrow(run, "label int, k array<float>")


def train(documents: DataFrame, labels: DataFrame, per_class: int = 1200) -> Model:
    """Landmarks and machine from about ``per_class`` labelled documents of each class (the bound)."""
    spark = documents.sparkSession
    flat.prepare(spark)
    sample = flat.labelled(documents, labels, "toxic", per_class, 3)
    model = Model(choose_landmarks(sample))
    shared = spark.sparkContext.broadcast(model)
    got = sorted((r["label"], r["k"]) for r in _values(shared, sample.select("label", F.lower("text").alias("text"))).collect())
    n = {r["label"]: r["n"] for r in
         labels.where(F.col("toxic").isin(0, 1) & ~flat.held_out(F.col("doc_id")))
         .groupBy(F.col("toxic").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    model.fit(np.array([k for _, k in got]).reshape(len(got), 2 * len(model.landmarks)), np.array([y for y, _ in got]), (n.get(0, 0), n.get(1, 0)))
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row: the probability of label 1."""
    spark = documents.sparkSession
    flat.prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # the landmarks' triples x landmarks floats

    def run(batches):
        for batch in batches:
            data, off = flat.flat(batch.column(1))
            out = [shared.value.score(data[off[a]:off[b]], off[a:b + 1] - off[a]) for a, b in flat.chunks(off)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "score"])

    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
            .mapInArrow(run, "doc_id long, score double"))


def op3_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", flat.held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= 0.3).cast("int").alias("predicted"))
