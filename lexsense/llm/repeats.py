"""Windows that come again in other documents: the search shared by substring and suffix-array dedup.

Letters are words or bytes. Each window of ``length`` letters has an anchor, the smallest hashed k-mer in
it; equal windows have equal anchors. A run is a stretch of neighbouring windows with the same anchor
place, a path that is read as a whole. Only runs whose anchor comes in several documents go on. A run
that reads the same in a smaller document is removed whole; where the runs at an anchor differ (the path
branches), the first document of each reading is left to the caller to resolve window by window.

All counts are exact and cover all documents: no caps. Runs of a document that read the same, as in a text
of one word over and over, are one row with their places.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexsense.llm import flat
from lexsense.llm.bloom import thin
from lexsense.llm.scratch import saved

#: letters of a chunk: (letters as 64-bit numbers, row offsets in letters)
Reader = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
KEY = ("doc_id", "t")
RUNS = "doc_id long, t int, a int, b int, again array<int>, o int, h long, s long, v long"
RUN = [c.split()[0] for c in RUNS.split(", ")]
SPAN = (*KEY, "a", "b", "again", "source_doc", "source_a")
AGAIN = pa.list_(pa.int32())


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, row = flat.word_spans(data, off)
    return flat.span_hash(flat.prefix_hash(data), start, end), np.searchsorted(row, np.arange(len(off)))


def octets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, off


def prefix(letters: np.ndarray) -> np.ndarray:
    if letters.dtype == np.uint8:
        return flat.prefix_hash(letters)
    p, _ = flat.powers(len(letters) + 1)
    out = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(letters * p[:-1], out=out[1:])
    return out


def runs(letters: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor place, anchor hash, prefix hashes): places in ``letters``."""
    p = prefix(letters)
    n = len(letters)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, np.zeros(0, np.uint64), p
    at = np.arange(n - k + 1)
    h = flat.span_hash(p, at, at + k)
    low = (h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    w, s = length - k + 1, 1
    while s * 2 <= w:
        low = np.minimum(low[:-s], low[s:])
        s *= 2
    low = np.minimum(low[:n - length + 1], low[w - s:w - s + n - length + 1])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = np.zeros(n + 1, np.int64)  # windows that stay within a row
    size = np.diff(off)
    long = size >= length
    np.add.at(ok, off[:-1][long], 1)
    np.add.at(ok, off[1:][long] - length + 1, -1)
    ok = np.cumsum(ok)[:n - length + 1] > 0
    change = np.r_[True, (place[1:] != place[:-1]) | ~ok[:-1]]
    head = np.flatnonzero(change & ok)
    stop = np.flatnonzero(ok & np.r_[change[1:] | ~ok[1:], True])
    return np.searchsorted(off, head, "right") - 1, head, stop, place[head], h[place[head]], p


def distinct_rows(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(row) else np.zeros(0, bool)
    return row[keep], h[keep]


def candidates(documents: DataFrame, read: Reader, length: int, k: int) -> DataFrame:
    """(doc_id, t, anchors) of the documents that share an anchor with another one."""
    def rows(batches):
        for batch in batches:
            data, off = flat.flat(batch.column(2))
            for a, b in flat.chunks(off):
                row, _, _, _, h, _ = runs(*read(data[off[a]:off[b]], off[a:b + 1] - off[a]), length, k)
                row, h = distinct_rows(row, h)
                take = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take),
                                                  pa.array(h.view(np.int64))], ["doc_id", "t", "h"])

    found = documents.select("doc_id", "t", "text").mapInArrow(rows, "doc_id long, t int, h long")
    same = W.partitionBy("h")  # one shuffle serves the counts and the rows
    several = found.select(*KEY, "h", F.min("doc_id").over(same).alias("lo"), F.max("doc_id").over(same).alias("hi")).where("lo < hi")
    return several.groupBy(*KEY).agg(F.collect_list("h").alias("anchors"))


def with_rows(documents: DataFrame, per_doc: DataFrame) -> DataFrame:
    """Texts of the documents in ``per_doc``; a bounded filter keeps the other texts out of the shuffle."""
    return thin(documents, per_doc, "doc_id").join(per_doc, list(KEY))


def once(row: np.ndarray, h: np.ndarray, s: np.ndarray, v: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(first, again): the first run of each reading in a row, and the starts of its other runs that read the
    same (null: none). A text of one word over and over has one reading at every place."""
    key = s ^ flat.mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        x, y = order[1:], order[:-1]
        new[1:] = (s[x] != s[y]) | (row[x] != row[y]) | (h[x] != h[y]) | (v[x] != v[y])
    if new.all():
        return np.arange(len(row)), pa.nulls(len(row), AGAIN)
    group = np.cumsum(new) - 1
    first = order[new]
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    more = order[~new]
    owner = rank[group[~new]]
    back = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=len(first))
    ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(a[more[back]].astype(np.int32)), mask=pa.array(count == 0))
    return np.sort(first), lists


def places(ranges: pa.Array) -> tuple[np.ndarray, ...]:
    """a, b and the other fields of structs of runs (see ``once``), a row for each place."""
    fields = {f.name: ranges.field(f.name) for f in ranges.type}
    again = fields.pop("again", None)
    out = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in fields.values()]
    if again is None or again.null_count == len(again):
        return tuple(out)
    more = pc.list_parent_indices(again).to_numpy(zero_copy_only=False)
    start = pc.list_flatten(again).to_numpy(zero_copy_only=False).astype(np.int64)
    a, b, *rest = out
    return np.r_[a, start], np.r_[b, start + (b - a)[more]], *(np.r_[x, x[more]] for x in rest)


def repeated_runs(texts: DataFrame, read: Reader, length: int, k: int) -> DataFrame:
    """(doc_id, t, a, b, again, o, h, s, v): the candidate runs with the hashes of their anchor and reading, and an
    independent hash of the reading, one row for a document's runs that read the same. Windows a to b as places in the
    document's letters; again: the other places where a may stand; o: from a to the anchor."""
    def rows(batches):
        for batch in batches:
            data, off = flat.flat(batch.column(2))
            kept = batch.column(3)
            for a, b in flat.chunks(off):
                letters, loff = read(data[off[a]:off[b]], off[a:b + 1] - off[a])
                row, head, stop, place, h, p = runs(letters, loff, length, k)
                on = np.zeros(len(row), bool)
                cut = np.searchsorted(row, np.arange(b - a + 1))
                for i in range(b - a):
                    x, y = cut[i], cut[i + 1]
                    if y > x:
                        on[x:y] = np.isin(h[x:y].view(np.int64), kept[a + i].values.to_numpy(zero_copy_only=False))
                row, head, stop, place, h = row[on], head[on], stop[on], place[on], h[on]
                s = flat.span_hash(p, head, stop + length)
                other = prefix(flat.mix(letters.astype(np.uint64) + np.uint64(0x1234567)))
                v = flat.span_hash(other, head, stop + length)
                first, again = once(row, h, s, v, head - loff[row])
                row, head, stop, place, h, s, v = (x[first] for x in (row, head, stop, place, h, s, v))
                take = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array((head - loff[row]).astype(np.int32)),
                     pa.array((stop - loff[row]).astype(np.int32)), again, pa.array((place - head).astype(np.int32)), pa.array(h.view(np.int64)),
                     pa.array(s.view(np.int64)), pa.array(v.view(np.int64))], RUN)

    return texts.select(*KEY, "text", "anchors").mapInArrow(rows, RUNS)


def opened(texts: DataFrame, read: Reader, length: int, width: int) -> DataFrame:
    """The open paths of each text (column ``paths``) cut into groups of ``width`` windows, as from
    ``repeated_runs``: the anchor of a group is what the windows of a whole group have in common."""
    def rows(batches):
        for batch in batches:
            data, off = flat.flat(batch.column(2))
            for x, y in flat.chunks(off):
                letters, loff = read(data[off[x]:off[y]], off[x:y + 1] - off[x])
                p, other = prefix(letters), prefix(flat.mix(letters.astype(np.uint64) + np.uint64(0x1234567)))
                row, first, last, core = [], [], [], []
                for i in range(x, y):
                    a, b, o = places(batch.column(3)[i].values)
                    # groups by the distance to the anchor, so that they agree wherever the anchor stands
                    low, high = (a + o - b) // width, o // width
                    n = high - low + 1
                    g = np.repeat(high, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    end = np.repeat(a + o, n) - g * width  # the group's last window, were it whole
                    row.append(np.full(len(g), i))
                    first.append(np.maximum(end - width + 1, np.repeat(a, n)) + loff[i - x])
                    last.append(np.minimum(end, np.repeat(b, n)) + loff[i - x])
                    core.append(end + loff[i - x])
                row, first, last, core = (np.concatenate(z) for z in (row, first, last, core))
                h, s, v = (flat.span_hash(p, core, core - width + 1 + length), flat.span_hash(p, first, last + length),
                           flat.span_hash(other, first, last + length))
                base = loff[row - x]
                kept, again = once(row, h, s, v, first - base)
                row, first, last, base, h, s, v = (z[kept] for z in (row, first, last, base, h, s, v))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array((first - base).astype(np.int32)),
                     pa.array((last - base).astype(np.int32)), again, pa.array(np.zeros(len(row), np.int32)),
                     pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(v.view(np.int64))], RUN)

    return texts.select(*KEY, "text", "paths").mapInArrow(rows, RUNS)


def listed(still: DataFrame) -> DataFrame:
    return saved(still.groupBy(*KEY).agg(F.collect_list(F.struct("a", "b", "o", "again")).alias("paths")))


def resolve(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, open): runs that read the same in a smaller document, verified by the independent hash of
    that source; and first readings at anchors with several readings in several documents. Both (doc_id, t, a, b, again, ...)."""
    anchor, reading = W.partitionBy("h"), W.partitionBy("h", "s").orderBy("doc_id", "a", "v")
    # one shuffle and one sort serve both windows
    both = (found.repartition("h").sortWithinPartitions("h", "s", "doc_id", "a", "v")
            .withColumn("several", (F.min("s").over(anchor) < F.max("s").over(anchor))
                        & (F.min("doc_id").over(anchor) < F.max("doc_id").over(anchor)))
            .withColumn("source", F.first(F.struct("doc_id", "a", "v")).over(reading)))
    same = F.col("v") == F.col("source.v")
    removed = (F.col("doc_id") > F.col("source.doc_id")) & same
    still = F.col("several") & ((F.col("doc_id") == F.col("source.doc_id")) | ~same)
    both = both.select(*KEY, "a", "b", "again", "o", F.col("source.doc_id").alias("source_doc"), F.col("source.a").alias("source_a"),
                       removed.alias("removed"), still.alias("still"))
    both = saved(both.where("removed OR still"))  # read for either
    return both.where("removed").select(*SPAN), both.where("still").select(*KEY, "a", "b", "again", "o")


def keyed(documents: DataFrame, *carry: str) -> DataFrame:
    """doc_id, t (hash of the text: parts documents that share an id), text; null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("t"), text.alias("text"), *carry)


def applied(documents: DataFrame, removed: DataFrame, cut: Callable, schema: str, *carry: str) -> DataFrame:
    """Every document (doc_id and the columns to carry) with its removed windows given to ``cut`` (text as bytes, starts, ends -> values of
    ``schema``). Documents surely without removed windows are cut where they are read, without a shuffle."""
    ranges = removed.groupBy(*KEY).agg(F.collect_list(F.struct("a", "b", "again")).alias("ranges"))
    ranges = saved(ranges)
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches):
        for batch in batches:
            data, off = flat.flat(batch.column(1))
            out = []
            for i in range(len(off) - 1):
                r = batch.column(2)[i]
                a, b = places(r.values) if r.is_valid else ((), ())
                out.append(cut(data[off[i]:off[i + 1]].tobytes(), a, b))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0)} | dict(zip(names, columns, strict=True)) | {c: batch.column(c) for c in carry})

    kind = "struct<a:int,b:int,again:array<int>>"
    flag = F.col("_maybe")
    marked = thin(documents, ranges, "doc_id", mark="_maybe")
    some = marked.where(flag).join(ranges, list(KEY), "left").select("doc_id", "text", "ranges", *carry)
    rest = marked.where(~flag).select("doc_id", "text", F.lit(None).cast(f"array<{kind}>").alias("ranges"), *carry)
    schema = ", ".join([f"doc_id long, {schema}", *(f"`{c}` {dict(documents.dtypes)[c]}" for c in carry)])
    return some.mapInArrow(rows, schema).union(rest.mapInArrow(rows, schema))
