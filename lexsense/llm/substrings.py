"""Substring dedup by anchored runs of windows, in place of a de Bruijn graph's paths (operator 2).

Windows are the token ``length``-mers of the documents. Neighbouring windows of a document with the same
anchor (smallest hashed k-mer) form a run; where all occurrences of a run read the same, it stays one row,
found by grouping the hashes of anchor and reading (see ``repeats``). Only runs whose readings differ are
opened into single windows. No nodes or edges are built, and no paths joined. Every removed span has a source (the
smallest document that holds it, and the place there), and is verified against it by an independent hash.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; equal
doc_ids never remove each other; documents with null doc_id neither lose nor remove words. Extra columns
are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsense.llm import flat
from lexsense.llm import repeats as R


def repeated_spans(documents: DataFrame, length: int = 50, k: int = 17) -> DataFrame:
    """(doc_id, t, a, b, again, source_doc, source_a): windows a to b that also start in a smaller document;
    again: the other places where a may stand. ``documents`` as from ``repeats.keyed``."""
    documents = documents.where("doc_id IS NOT NULL")
    flat.prepare(documents.sparkSession)
    per_doc = R.saved(R.candidates(documents, R.words, length, k))
    removed, still = R.resolve(R.repeated_runs(R.with_rows(documents, per_doc), R.words, length, k))
    paths = R.listed(still)
    single, _ = R.resolve(R.opened(R.with_rows(documents, paths), R.words, length, 1))
    return removed.union(single)


def covered(n: int, a, b, length: int) -> np.ndarray:
    """Which of n letters lie in a window starting at a .. b (pairs)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.asarray(a, np.int64), 1)
    np.add.at(step, np.minimum(np.asarray(b, np.int64) + length, n), -1)
    return np.cumsum(step[:n]) > 0


def _cut(length: int, text: bool):
    def cut(raw: bytes, a, b) -> tuple:
        w = raw.split()
        gone = covered(len(w), a, b, length) if len(a) else np.zeros(0, bool)
        kept = b" ".join([x for x, g in zip(w, gone, strict=True) if not g] if len(a) else w)
        return (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()) + ((kept.decode(),) if text else ())
    return cut


def deduplicate(documents: DataFrame, length: int = 50, text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text) of every row."""
    docs = R.keyed(documents)
    schema = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * text
    return R.applied(docs, repeated_spans(docs, length), _cut(length, text), schema)


def without_repeats(documents: DataFrame, length: int = 50) -> DataFrame:
    """The rows, columns of documents, with repeated spans taken out of their texts. Changed texts are the
    kept words joined by one space; other texts stay as they are."""
    docs = R.keyed(documents, "lang", "source")

    def cut(raw: bytes, a, b) -> tuple:
        return (_cut(length, True)(raw, a, b)[3] if len(a) else raw.decode(),)

    out = R.applied(docs, repeated_spans(docs, length), cut, "text string", "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars")


def op2_substring_dedup(spark, sf_dir):
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), text=False)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(g)) AS m FROM s) WHERE doc_id > m),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest(range(0, 50)) AS k)),
k AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
    list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
