"""Texts of an Arrow batch as flat numpy arrays: words, hashes and row spans without Python strings.

Python workers get Arrow batches; the functions here look at the text bytes in place. All work is
done in chunks of whole rows of about ``CHUNK`` bytes, so memory follows the longest text and not
the batch.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: list[np.ndarray] = []


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts, unless the session says otherwise."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 4096)
        inverse = pow(BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))))
                      for b in (BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows in a row, and the offsets of the rows (one more than rows); null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[off[0]: off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK):
    """Row ranges [a, b) whose texts hold about ``limit`` bytes (one row at least)."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def spans(solid: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every longest run of ``solid`` bytes; runs never cross rows."""
    inner = off[(off > 0) & (off < len(solid))]
    edge = np.diff(solid, prepend=False, append=False)
    edge[inner] |= solid[inner]
    start = np.flatnonzero(edge[:-1] & solid)
    return start, np.flatnonzero(edge[1:] & solid) + 1, np.searchsorted(off, start, "right") - 1


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = off[(off > 0) & (off < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` reads any span of it."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, the same for equal bytes anywhere."""
    _, inverse = powers(len(prefix))
    length = (end - start).astype(np.uint64)
    return mix((prefix[end] - prefix[start]) * inverse[start] + length * np.uint64(0xD6E8FEB86659FD93))


def bucket(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 4: rows with 2 are held out of every training."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(bucket(doc_id) == 2, F.lit(False))


def class_sample(rows: DataFrame, label: str, per_class: int, seed: int) -> DataFrame:
    """About ``per_class`` rows of each class of (doc_id, label), chosen by a hash of the id.

    The shares come from the class counts, so the sample's size is bounded whatever the input.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    return (rows.join(F.broadcast(counts), label).where(u * F.col("_n") < per_class).drop("_n"))


def labelled(documents: DataFrame, labels: DataFrame, name: str, per_class: int, seed: int) -> DataFrame:
    """(doc_id, label, text) of a bounded sample of labelled rows outside the held-out quarter.

    Repeated or contradictory label rows of a document count once, by their largest label.
    """
    rows = (labels.where(F.col(name).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max(name).cast("int").alias("label")))
    picked = class_sample(rows, "label", per_class, seed)
    texts = documents.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("text"))
    return texts.join(F.broadcast(picked), "doc_id")  # 2 * per_class rows, see class_sample


def passing(documents: DataFrame, good) -> DataFrame:
    """Rows of ``documents``, all columns, whose text passes ``good()(bytes, offsets) -> booleans``."""
    prepare(documents.sparkSession)
    place = documents.columns.index("text")

    def run(batches):
        judge = good()
        for batch in batches:
            data, off = flat(batch.column(place))
            keep = [judge(data[off[a]:off[b]], off[a:b + 1] - off[a]) for a, b in chunks(off, CHUNK // 2)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep), pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
