"""Source divergence audit (operator 11).

Compares the term shares of every (lang, source) group with those of the other sources of its lang, and lists
the terms that a group uses more than its lang does.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z in lower case. Spark's ``CountVectorizer`` with
``minDF`` and the largest integer as ``vocabSize`` keeps every term that comes in ``min_df`` documents of
its lang and gives each document its exact sparse vector. The terms carry their lang, so that one fit has a
vocabulary and a document frequency for each lang. The vocabulary goes through the driver and a broadcast, as
this estimator's always does; its size is bounded: terms are dealt by hash over as many fits as keep about
``block_terms`` different terms (kept or not) in each. Vectors are summed over each group in a task first,
then the sums of all tasks by parts of the vocabulary; pairs of sources are evaluated in blocks of terms, where only the terms that one of the two
has are looked at and all others add the same amount each.

``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))`` and ``f = floor((p - q)**2 / (p + q))`` are whole
numbers and exact for N up to 9 * 10**15.

Defined results: null text, lang and source are ''; groups without kept terms take part with counts of 0; a lang
that keeps no term gives pairs of value 0 and no terms; a source that is alone in its lang has no pairs; repeated
rows count each; long texts are taken whole; extra columns are ignored; empty tables give no rows; ties
are ordered by the item's UTF-8 bytes.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexsense.llm.flat import LOWER, chunks, flat, prepare, spans
from lexsense.llm.scratch import saved

TERM = np.ones(256, bool)  # bytes of terms: letters, and all of what is not ASCII
TERM[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
NO_TERM = "\x01"  # keeps the estimator's vocabulary from being empty
CELLS = 2_000_000  # (term, source) cells of a block
PART = 4096  # ids of a part of a group's sums
ROW = "lang string, part string, source string, item string, id long, value long"


def tagged_terms(documents: DataFrame) -> DataFrame:
    """lang, source and the terms of each row, each term after its lang and a blank."""
    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(0))
            langs = batch.column(1).dictionary_encode()
            tags = [np.frombuffer(f"{x} ".encode(), np.uint8) for x in langs.dictionary.to_pylist()]
            width = np.array([len(t) for t in tags] or [0])
            code = langs.indices.to_numpy(zero_copy_only=False)
            for a, b in chunks(off):
                text = LOWER[data[off[a]:off[b]]]
                solid = TERM[text]
                start, end, row = spans(solid, off[a:b + 1] - off[a])
                own = code[a:b][row]
                stop = np.cumsum(end - start + width[own])
                put = stop - (end - start)
                out = np.empty(stop[-1] if len(stop) else 0, np.uint8)
                out[np.flatnonzero(solid) + np.repeat(put - start, end - start)] = text[solid]
                for k in np.unique(own):
                    at = put[own == k] - width[k]
                    for i, byte in enumerate(tags[k]):
                        out[at + i] = byte
                ends = np.concatenate(([0], stop)).astype(np.int32)
                terms = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(out))
                rows = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a),
                                                  pa.ListArray.from_arrays(pa.array(rows), terms)], ["lang", "source", "terms"])

    rows = documents.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    return rows.mapInArrow(run, "lang string, source string, terms array<string>")


def block_of(term, blocks: int):
    return F.pmod(F.xxhash64(term), F.lit(blocks))


def group_counts(rows: DataFrame, min_df: int, block_terms: int) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, id, n) of the kept terms in each group, and the vocabulary (lang, id, term)."""
    spark = rows.sparkSession
    distinct = rows.select(F.explode("terms").alias("t")).agg(F.approx_count_distinct("t")).first()[0]
    blocks = max(1, math.ceil(distinct / block_terms))
    pad = spark.range(min_df).select(F.lit("").alias("lang"), F.lit("").alias("source"), F.array(F.lit(NO_TERM)).alias("terms"))
    counts, terms = [], []
    for k in range(blocks):
        mine = rows if blocks == 1 else rows.withColumn("terms", F.filter("terms", lambda t: block_of(t, blocks) == k))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df),
                                vocabSize=2**31 - 1).fit(mine.unionByName(pad))
        place = {t: i for i, t in enumerate(model.vocabulary)}
        none = place.pop(NO_TERM)
        names = spark.createDataFrame(pa.table({"id": pa.array(place.values(), pa.int64()), "t": pa.array(place.keys(), pa.string())}))
        terms.append(names.select(F.regexp_extract("t", "(?s)^(.*) ", 1).alias("lang"), (F.col("id") * blocks + k).alias("id"),
                                  F.substring_index("t", " ", -1).alias("term")))
        counts.append(summed(model.transform(mine).select("lang", "source", "vector"), none, blocks, k))
    total = counts[0]
    for more in counts[1:]:
        total = total.unionByName(more)
    total = added(total)
    names = terms[0]
    for more in terms[1:]:
        names = names.unionByName(more)
    return saved(total), saved(names)


def summed(vectors: DataFrame, none: int, blocks: int, k: int) -> DataFrame:
    """(lang, source, part, ids, n): sums of the sparse vectors over each group within a task, a row for each part of
    the ids (``i * blocks + k`` for place i; place ``none`` is left out). ``ids`` are places in the part."""
    size_of_part = PART

    def run(batches):
        held: dict = {}
        size = 0

        def out():
            for (lang, source), runs in held.items():
                ids, n = joined(runs)
                ids, n = ids[ids != none].astype(np.int64) * blocks + k, n[ids != none]
                part, at = np.divmod(ids, size_of_part)
                cut = np.r_[np.flatnonzero(np.diff(part, prepend=-1)), len(part)].astype(np.int32)
                many = len(cut) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * many, pa.string()), pa.array([source] * many, pa.string()), pa.array(part[cut[:-1]]),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(at.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(n))], ["lang", "source", "part", "ids", "n"])

        def joined(runs):
            ids, n = (np.concatenate(x) for x in zip(*runs))
            order = np.argsort(ids, kind="stable")
            ids, n = ids[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))[:len(ids)]
            return ids[at], np.add.reduceat(n, at) if len(ids) else n

        for batch in batches:
            vector = batch.column(2)
            ids, n = (pc.struct_field(vector, x) for x in ("indices", "values"))
            place = pc.list_parent_indices(ids).to_numpy(zero_copy_only=False)
            ids = pc.list_flatten(ids).to_numpy(zero_copy_only=False)
            n = pc.list_flatten(n).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = pd.MultiIndex.from_arrays([batch.column(0).to_pandas(), batch.column(1).to_pandas()])
            code, names = pd.factorize(keys)
            group = code[place]
            order = np.argsort(group, kind="stable")
            cut = np.searchsorted(group[order], np.arange(len(names) + 1))
            for g, name in enumerate(names):
                at = order[cut[g]:cut[g + 1]]
                runs = held.setdefault(tuple(name), [])
                runs.append(joined([(ids[at], n[at])]))
                size += len(runs[-1][0])
                if len(runs) > 16:
                    size -= sum(len(x) for x, _ in runs)
                    runs[:] = [joined(runs)]
                    size += len(runs[0][0])
            if size > CELLS:
                yield from out()
                held, size = {}, 0
        yield from out()

    return vectors.mapInArrow(run, "lang string, source string, part long, ids array<int>, n array<long>")


def added(sums: DataFrame) -> DataFrame:
    """(lang, source, id, n): the rows of ``summed`` added up, in the memory of one part."""
    size_of_part = PART

    def run(batches):
        total, held = np.zeros(size_of_part, np.int64), None

        def out():
            lang, source, part = held
            at = np.flatnonzero(total)
            n = total[at]
            total[at] = 0
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()),
                                               pa.array(part * size_of_part + at), pa.array(n)], ["lang", "source", "id", "n"])

        for batch in batches:
            ids, n = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False) for c in (3, 4))
            end = np.cumsum(pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))
            start = 0
            for *key, stop in zip(*(batch.column(c).to_pylist() for c in range(3)), end, strict=True):
                if key != held:
                    if held:
                        yield out()
                    held = key
                total[ids[start:stop]] += n[start:stop]  # ids of a row differ
                start = stop
        if held:
            yield out()

    key = ["lang", "source", "part"]
    return sums.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "lang string, source string, id long, n long")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / total) for 0 < count <= total < 9 * 10**15."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return 1 + whole


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def evaluate(lang: str, sources: list, totals: np.ndarray, vocabulary: int, place: np.ndarray, source: np.ndarray,
             n: np.ndarray, top: int) -> pd.DataFrame:
    """Partial sums of all pairs of ``sources`` over one block's terms, and each source's ``top`` terms there.

    ``place``, ``source`` and ``n``: the counts above 0; places are those of the block's terms."""
    size, width = int(place.max()) + 1 if len(place) else 0, len(sources)
    count = np.zeros((size, width), np.int64)
    count[place, source] = n
    out = []
    base = share(np.full(width, 2), totals + 2 * vocabulary) if vocabulary else np.ones(width, np.int64)
    p = share(count + 2, totals + 2 * vocabulary) if size else count
    q = share(count.sum(1) + 2, totals.sum() + 2 * vocabulary) if size else None
    value = apart(base[:, None], base[None]) * size
    for s in range(width):
        rows = np.flatnonzero(count[:, s])
        more = apart(p[rows, s][:, None], p[rows]) - apart(base[s], base)
        value[s] += more.sum(0)
        value[:, s] += np.where(count[rows] == 0, more, 0).sum(0)
        f = np.where(p[rows, s] > q[rows], apart(p[rows, s], q[rows]), -1) if size else np.zeros(0, np.int64)
        floor = max(0, np.partition(f, -top)[-top]) if len(f) > top else 0
        best = f >= floor  # ties at the end stay until all blocks meet
        out.append(pd.DataFrame({"part": "term", "source": sources[s], "item": None, "id": rows[best], "value": f[best]}))
    for s in range(width):
        others = np.arange(width) != s
        out.append(pd.DataFrame({"part": "pair", "source": sources[s], "item": np.array(sources, object)[others],
                                 "id": 0, "value": value[s][others]}))
    out = pd.concat(out, ignore_index=True)
    out.insert(0, "lang", lang)
    return out


def audit(documents: DataFrame, min_df: int = 10, top: int = 10, block_terms: int = 4_000_000) -> DataFrame:
    """lang, source, part, item, value, rank: the audit's rows (see the contract of ``op11``)."""
    spark = documents.sparkSession
    prepare(spark)
    rows = saved(tagged_terms(documents))
    groups = rows.select("lang", "source").distinct()
    counts, names = group_counts(rows, min_df, block_terms)
    size = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = names.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = saved(groups.join(size, ["lang", "source"], "left").join(kept, "lang", "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept")))
    # blocks of terms of each lang: about CELLS (term, source) cells in each, one block at least
    cells = F.count("*") * F.max("kept")
    blocks = groups.groupBy("lang").agg(F.ceil(cells / CELLS + F.lit(1)).cast("long").alias("blocks"))
    head = groups.join(blocks, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source",
        F.lit(None).cast("long").alias("id"), "n", "kept")
    body = counts.join(blocks, "lang").select(
        "lang", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "source", "id", "n", F.lit(0).cast("long").alias("kept"))

    def run(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        heads = table["id"].isna()
        group, cell = table[heads].sort_values("source"), table[~heads]
        sources = group["source"].tolist()
        code = pd.Index(sources).get_indexer(cell["source"])
        place, ids = pd.factorize(cell["id"].astype("int64"))
        out = evaluate(key[0], sources, group["n"].to_numpy(np.int64), int(group["kept"].iloc[0]), place, code,
                       cell["n"].to_numpy(np.int64), top)
        terms = out["part"] == "term"
        out.loc[terms, "id"] = np.asarray(ids, np.int64)[out.loc[terms, "id"].to_numpy(np.int64)]
        return out

    found = saved(head.unionByName(body).groupBy("lang", "block").applyInPandas(run, ROW))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.where("part = 'term' and value >= 0").join(names, ["lang", "id"]).select(
        "lang", "source", "part", F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS MATERIALIZED (SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source,
    unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, sum(n) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS t FROM c GROUP BY ALL),
cell AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n, coalesce(t.t, 0)::HUGEINT + 2 * v.v AS total
    FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t USING (lang, source)),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // total AS p FROM cell),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)) // (any_value(u.u) + 2 * any_value(v.v)) AS q
    FROM cell JOIN (SELECT lang, sum(t)::HUGEINT AS u FROM t GROUP BY lang) u USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
    FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (FROM every UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
