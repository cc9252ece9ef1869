"""Suffix-array dedup of byte strings by a difference cover (operator 1).

Wanted: every ``length``-byte string that also starts in a smaller document. Text that cannot hold one is
set aside first, and runs of windows that read the same in a smaller document are collapsed (``repeats``):
copies end there. The suffixes that stay open, each to the depth of ``length`` bytes, are sorted by the difference
cover {1, 2} modulo 3; no suffix array of the whole text is built:

1. a sampled place (offset modulo 3 is 1 or 2) has a rank key of two triples of 8-byte letters, 48 bytes in all;
2. of any two suffixes, some shift by 0, 1 or 2 takes both to sampled places, so each suffix is listed under the two
   shifts at which it is sampled: with the triples of that place, the bytes before it and those missing to the depth.
   Only places that a listed suffix needs are read;
3. one shuffle deals the lists by their whole key and sorts them; suffixes with an equal prefix of ``length``
   bytes are neighbours there, and the smallest document comes first: it is their source.

As the depth is that of the key, triples need no names and ties no recursion.

Defined results: null and empty texts have no bytes; texts shorter than a window lose nothing; equal
doc_ids never remove each other; documents with null doc_id neither lose nor remove bytes. Extra columns
are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexsense.llm import flat
from lexsense.llm import repeats as R
from lexsense.llm.substrings import covered

LENGTH = 50
LETTER = 8
SPAN = 6 * LETTER  # two triples
WIDTH = 4  # windows of a group when a path is opened
LETTERS = [f"x{i}" for i in range(6)]


def _lists(batches):
    """Each open suffix under the two shifts that take it to a sampled place: the letters of the two triples there; rest:
    the shift, and the bytes of the suffix that the triples leave out."""
    for batch in batches:
        data, off = flat.flat(batch.column(2))
        for x, y in flat.chunks(off):
            row, start = [], []
            for i in range(x, y):
                a, b = R.places(batch.column(3)[i].values)[:2]
                n = b - a + 1
                start.append(np.unique(np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)))
                row.append(np.full(len(start[-1]), i))
            row, start = np.concatenate(row), np.concatenate(start)
            if not len(row):
                continue
            spans = np.lib.stride_tricks.sliding_window_view(data, SPAN)
            for part in np.array_split(np.arange(len(row)), len(row) // 100_000 + 1):
                for shift in range(3):
                    on = part[(start[part] + shift) % 3 > 0]
                    begin = off[row[on]] + start[on]
                    letters = spans[begin + shift].view(">u8").astype(np.int64)
                    left = [d if d < shift else d + SPAN for d in range(LENGTH - SPAN)]
                    rest = (shift << 16) | (data[begin + left[0]].astype(np.int32) << 8) | data[begin + left[1]]
                    take = pa.array(row[on])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), pa.array(start[on].astype(np.int32)),
                         *(pa.array(np.ascontiguousarray(z)) for z in letters.T), pa.array(rest)],
                        ["doc_id", "t", "a", *LETTERS, "rest"])


def sorted_groups(texts: DataFrame) -> DataFrame:
    """(doc_id, t, a, b, ...): the windows of the open paths of ``texts`` that start in a smaller document."""
    lists = texts.select("doc_id", "t", "text", "paths").mapInArrow(
        _lists, f"doc_id long, t int, a int, {', '.join(f'{c} long' for c in LETTERS)}, rest int")
    key = [*LETTERS, "rest"]
    # the one shuffle and sort of the lists; of equal suffixes the first has the smallest document
    low = F.first("doc_id").over(W.partitionBy(*key).orderBy("doc_id"))
    return (lists.withColumn("low", low).where("doc_id > low")
            .select("doc_id", "t", "a", F.col("a").alias("b"), F.lit(None).cast("array<int>").alias("again"),
                    F.col("low").alias("source_doc"), F.lit(None).cast("int").alias("source_a")))


def repeated_spans(documents: DataFrame, k: int = 22) -> DataFrame:
    """(doc_id, t, a, b, again, source_doc, source_a): byte windows a to b that also start in a smaller document;
    again: the other places where a may stand."""
    documents = documents.where("doc_id IS NOT NULL")
    flat.prepare(documents.sparkSession)
    per_doc = R.saved(R.candidates(documents, R.octets, LENGTH, k))
    runs, still = R.resolve(R.repeated_runs(R.with_rows(documents, per_doc), R.octets, LENGTH, k))
    paths = R.listed(still)
    some, still = R.resolve(R.opened(R.with_rows(documents, paths), R.octets, LENGTH, WIDTH))
    paths = R.listed(still)
    return runs.union(some).union(R.saved(sorted_groups(R.with_rows(documents, paths))))


def _cut(raw: bytes, a, b) -> tuple:
    if not len(a):
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    gone = covered(len(raw), a, b, LENGTH)
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


def deduplicate(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    docs = R.keyed(documents)
    return R.applied(docs, repeated_spans(docs), _cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_array_dedup(spark, sf_dir):
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS g
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(g)) AS m FROM s) WHERE doc_id > m),
e AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r),
f AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM e),
g AS (SELECT doc_id, n, min(i) AS a, max(i) + 50 AS b FROM f GROUP BY doc_id, n),
h AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM g),
k AS (SELECT h.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS z,
    string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS y FROM h JOIN d USING (doc_id) GROUP BY h.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN x ELSE y || substr(x, 2 * z + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
