"""Packing into windows by non-negative least squares over shallow length combinations (operator 8).

Tokenising writes, for each document, its token ids and their number. Only the numbers are ranked and
planned; the ids are joined back by row and cut into the pieces. Full windows are sequences by themselves. For the rests, the combinations of two or three
lengths that fill a window exactly are the columns of A; non-negative least squares fits their repeat
counts to the histogram of lengths, the counts are rounded down within what is there, and the residual
histogram is packed greedily, longest first. The plan depends on ``WINDOW`` lengths only, never on the
number of documents; documents find their place by their rank among those of equal length.

Defined results: a null or empty text is the one id 0; repeated rows and doc_ids are separate documents;
no rows give no pieces. Extra columns are ignored.
"""
from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexsense.llm import flat

WINDOW = 1024
CACHED = 250_000  # word pieces a worker keeps
_SAFE = np.zeros(256, bool)  # bytes that surely start a character other than white space
_SAFE[0x21:0x7F] = True
_SAFE[0xC3:0xF5] = True
_SAFE[[0xE1, 0xE2, 0xE3]] = False
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True


class Encoder:
    """Token ids of texts by the vocabulary ``name``, each distinct word encoded once.

    Texts are cut before a space, or after a single line end, with a visible character behind it: the
    tokenizer's pattern always ends a match there, so the ids of the parts make up the ids of the text.
    The rank file of the vocabulary gives the same ids as ``tokenizers`` gives for ``name``.json, and
    faster; texts that hold a special token's string go to ``tokenizers`` itself.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken
        self.path = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self):
        self.index: dict[int, int] = {}
        self.start, self.size, self.store = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @functools.cached_property
    def exact(self):
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in a row, and the offsets of the rows."""
        n = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        safe = _SAFE[data]
        cut = np.zeros(len(data), bool)
        cut[:-1] |= (data[:-1] == 0x20) & safe[1:]
        cut[2:] |= (data[1:-1] == 0x0A) & safe[2:] & _PLAIN[data[:-2]]
        cut[off[off < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        row = np.searchsorted(off, start, "right") - 1
        key, first, back = np.unique(flat.span_hash(flat.prefix_hash(data), start, end), return_index=True, return_inverse=True)
        if len(self.index) > CACHED:
            self.clear()
        keys = key.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.index]
        if new:
            raw = data.tobytes()
            ids = [self.bpe.encode_ordinary(raw[start[f]:end[f]].decode()) for f in first[new]]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            base = len(self.index)
            self.index.update((keys[i], base + j) for j, i in enumerate(new))
            self.start = np.append(self.start, len(self.store) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.store = np.append(self.store, np.fromiter((x for y in ids for x in y), np.uint32, size.sum()))
        at = np.fromiter((self.index[k] for k in keys), np.int64, len(keys))[back]
        size = self.size[at]
        out = self.store[np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        return out, np.concatenate(([0], np.cumsum(np.bincount(row, size, n).astype(np.int64))))


def id_type(vocabulary: int) -> str:
    """Two bytes an id between the steps where the vocabulary's size allows it, else four."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokens(documents: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, n with the closing id 0, ids as bytes of the width ``id_type`` gives) of every row."""
    flat.prepare(documents.sparkSession)

    def run(batches):
        encoder = Encoder(name)
        kind = id_type(encoder.exact.get_vocab_size())  # here, as the driver needs no tokenizer
        special = set(encoder.exact.get_added_tokens_decoder()[i].content.encode()
                      for i in encoder.exact.get_added_tokens_decoder())
        for batch in batches:
            data, off = flat.flat(batch.column(1))
            count, lists = [], []
            for a, b in flat.chunks(off):
                raw = data[off[a]:off[b]]
                ids, at = encoder.encode(raw, off[a:b + 1] - off[a])
                text = raw.tobytes()
                held = [s for s in special if s in text]
                for i in range(b - a):
                    own = ids[at[i]:at[i + 1]]
                    if held and any(s in text[off[a + i] - off[a]:off[a + i + 1] - off[a]] for s in held):
                        own = encoder.exact.encode(text[off[a + i] - off[a]:off[a + i + 1] - off[a]].decode(), add_special_tokens=False).ids
                    full = np.append(own, 0).astype(kind)
                    count.append(len(full))
                    lists.append(full.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(lists, pa.binary())], ["doc_id", "n", "ids"])

    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, n long, ids binary"))


def combinations() -> np.ndarray:
    """All pairs and triples of lengths that fill a window (rows of three, 0 for none)."""
    a, b = np.meshgrid(np.arange(WINDOW), np.arange(WINDOW), indexing="ij")
    c = WINDOW - a - b
    on = (a <= b) & (b <= c) & (c < WINDOW)
    return np.stack([a[on], b[on], c[on]], 1)


def solve(columns: np.ndarray, h: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Non-negative least squares |Ax - h| by accelerated projected gradients; A as lists of lengths."""
    x = z = np.zeros(len(columns))
    times = lambda v: np.bincount(columns.ravel(), np.repeat(v, 3), WINDOW) * (np.arange(WINDOW) > 0)
    back = lambda r: (r * (np.arange(WINDOW) > 0))[columns].sum(1)
    v = np.ones(len(columns))
    for _ in range(12):
        v = back(times(v))
        v /= np.linalg.norm(v)
    step, t = 1 / (1.1 * np.linalg.norm(back(times(v)))), 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - step * back(times(z) - h))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def plan(h: np.ndarray) -> tuple[np.ndarray, int]:
    """Places for ``h[l]`` pieces of each length l < WINDOW: rows (length, first rank, end rank, first
    sequence, pieces of this length in a sequence, offset of the first of them); number of sequences."""
    left, used = h.astype(np.int64).copy(), np.zeros(WINDOW, np.int64)
    rows: list[tuple] = []
    sequences = 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for n in sorted(set(lengths), reverse=True):
            k = lengths.count(n)
            rows.append((n, used[n], used[n] + k * times, sequences, k, offset))
            used[n] += k * times
            left[n] -= k * times
            offset += k * n
        sequences += times

    columns = combinations()
    x = solve(columns, h.astype(float))
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        lengths = [int(n) for n in columns[i] if n]
        times = min([int(np.rint(x[i])), *(left[n] // lengths.count(n) for n in set(lengths))])
        if times > 0:
            place(lengths, int(times))
    while left.any():  # the rest: the longest piece, then ever the longest that still fits
        lengths, space = [], WINDOW
        free = left.copy()
        while True:
            fit = np.flatnonzero(free[:space + 1])
            if not len(fit):
                break
            n = int(fit[-1])
            lengths.append(n)
            free[n] -= 1
            space -= n
        place(lengths, int(min(left[n] // lengths.count(n) for n in set(lengths))))
    return np.array(rows, np.int64).reshape(-1, 6), sequences


def pack(documents: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of every piece."""
    spark = documents.sparkSession
    stored = tokens(documents, name).withColumn("uid", F.monotonically_increasing_id()).checkpoint()
    table = stored.select("uid", "n").withColumn("rest", F.col("n") % WINDOW).withColumn("full", F.floor(F.col("n") / WINDOW))
    sums = table.groupBy("rest").agg(F.count("*").alias("k"), F.sum("full").alias("full")).orderBy("rest").collect()
    h = np.zeros(WINDOW, np.int64)
    for r in sums:  # WINDOW rows at most
        h[r["rest"]] = r["k"]
    salts = int(h.sum() // 100_000 + 1)
    h[0] = 0
    rows, sequences = plan(h)
    before, total = {}, sequences
    for r in sums:
        before[r["rest"]], total = total, total + r["full"]
    shared = spark.sparkContext.broadcast((rows[np.lexsort((rows[:, 1], rows[:, 0]))], before))
    # rank among equal lengths, and full windows before it: within (length, salt), then over the salts
    table = table.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    part = table.groupBy("rest", "salt").agg(F.count("*").alias("k"), F.sum("full").alias("f"))
    ahead = W.partitionBy("rest").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    part = part.select("rest", "salt", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("k0"),
                       F.coalesce(F.sum("f").over(ahead), F.lit(0)).alias("f0"))
    inside = W.partitionBy("rest", "salt").orderBy("uid")
    ranked = (table.join(part, ["rest", "salt"])
              .withColumn("rank", F.col("k0") + F.row_number().over(inside) - 1)
              .withColumn("seq", F.col("f0") + F.sum("full").over(inside) - F.col("full")))

    def pieces(batches):
        plan_rows, first = shared.value
        key = (plan_rows[:, 0] << 40) + plan_rows[:, 1]
        for batch in batches:
            got = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "rest", "full", "rank", "seq")}
            parts = got["full"] + (got["rest"] > 0)
            at = np.repeat(np.arange(len(parts)), parts)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            rest, rank, is_full = got["rest"][at], got["rank"][at], nth < got["full"][at]
            base = np.array([first[r] for r in got["rest"].tolist()], np.int64)[at] if len(at) else at
            if len(key):
                p = plan_rows[np.clip(np.searchsorted(key, (rest << 40) + rank, "right") - 1, 0, len(key) - 1)]
            else:
                p = np.ones((len(at), 6), np.int64)
            i = rank - p[:, 1]
            length = np.where(is_full, WINDOW, rest)
            raw = flat.flat(batch.column("ids"))[0].tobytes()
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * got["n"].sum() else "<u4").astype("<u4")
            end = np.cumsum(length)  # the pieces of a row, and the rows, follow each other without gaps
            raw = memoryview(ids.tobytes())
            crcs = pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((end - length).tolist(), end.tolist(), strict=True)], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], end)), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(at)), pa.array(nth * WINDOW, pa.int64()),
                pa.array(length, pa.int64()), crcs,
                pa.array(got["n"][at], pa.int64()),
                pa.array(np.where(is_full, base + got["seq"][at] + nth, p[:, 3] + i // p[:, 4]), pa.int64()),
                pa.array(np.where(is_full, 0, p[:, 5] + i % p[:, 4] * rest), pa.int64()), lists],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = stored.select("uid", "doc_id", "ids").join(ranked.select("uid", "n", "rest", "full", "rank", "seq"), "uid")
    return placed.select("doc_id", "n", "rest", "full", "rank", "seq", "ids").mapInArrow(
        pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")


def op8_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")  # the digest is that of the ids
