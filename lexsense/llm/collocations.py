"""Phrase collocation mining by HAT-trie counting (operator 12).

Phrases are counted level by level (one, two, three words). Each task counts in a ``Trie``: the key of a
phrase starts with 16 bits of its first word's id and 16 bits of the next one's, so its upper bytes are a
shallow trie over word ids; leaves are hash-ordered containers that burst into their 256 children when
they grow too large. When a task's trie holds more than ``LIMIT`` phrases, whole subtrees are spilled, the
largest first, as runs in key order. Spark deals the runs by phrase (a prefix alone may hold a third of all
rows) and adds the counts, which merges them.

A phrase can only be frequent if its first and its last words are: from the second level on, phrases pass a
Bloom filter of the frequent shorter phrases first. The filter has a fixed size (``WORDS`` * 64 bits); when
full it only stops helping, as the counts of whole phrases decide.

Words are told apart by 64-bit ids of lang and word. Ids that two words share are looked for over the whole
corpus, and the job then fails rather than give wrong counts; another ``seed`` cures it.

Defined results: null texts are empty; null langs are ``und``; repeated rows count each; words of any length and
texts of any length are taken whole; extra columns are ignored; empty tables give no rows; ties are ordered by
the phrase's UTF-8 bytes. Counts are exact, scores are floors of exact quotients (38 digits).
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsense.llm.flat import LOWER, chunks, flat, mix, prefix_hash, prepare, span_hash, spans
from lexsense.llm.scratch import saved
from lexsense.operators.prefix import running_totals

WORDS = 1 << 20  # 64-bit words of the Bloom filter: 8 MB
LIMIT = 2_000_000  # phrases in a task's trie
BURST = 1 << 14  # phrases in a container
DEEPEST = 4  # bytes of the key that the trie branches on: two of the first word's id, two of the second's
GAP = np.zeros(256, bool)
GAP[[0x20, 9]] = True
STOP = np.zeros(256, bool)
STOP[[10, 11, 12, 13, *b".,;:!?"]] = True


def phrase_key(ids: list[np.ndarray]) -> np.ndarray:
    """Key of phrases given by their word ids: 16 bits of each of the first two words, 32 of the whole phrase."""
    whole = ids[0]
    for x in ids[1:]:
        whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + x)
    second = ids[1] if len(ids) > 1 else whole
    return (ids[0] >> np.uint64(48) << np.uint64(48)) | (second >> np.uint64(48) << np.uint64(32)) | (whole >> np.uint64(32))


def merged(runs: list[tuple]) -> tuple:
    """One run (key, ids..., n) in key order out of several; equal phrases are added.

    Phrases of equal key stay apart; one whose rows do not meet here stays in several rows, and Spark adds those."""
    columns = [np.concatenate(c) for c in zip(*runs)] if len(runs) > 1 else list(runs[0])
    if not len(columns[0]):
        return tuple(columns)
    order = np.argsort(columns[0], kind="stable" if len(runs) > 1 else None)  # runs are merged, not sorted anew
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns[:-1]:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return (*(c[at] for c in columns[:-1]), np.add.reduceat(columns[-1], at))


class Trie:
    """Phrase counts in containers below a trie over the upper bytes of the key."""

    def __init__(self, limit: int = LIMIT, burst: int = BURST):
        self.limit, self.burst, self.size, self.root = limit, burst, 0, [None] * 256

    def _branch(self, children: list, run: tuple, depth: int) -> None:
        byte = (run[0] >> np.uint64(56 - 8 * depth)).astype(np.uint8)
        start = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        for a, b in zip(start, [*start[1:], len(byte)]):
            children[byte[a]] = self._put(children[byte[a]], tuple(c[a:b] for c in run), depth + 1)

    def _put(self, node, run: tuple, depth: int):
        if isinstance(node, list):
            self._branch(node, run, depth)
            return node
        runs, size = node or ((), 0)
        runs, size = (*runs, run), size + len(run[0])
        self.size += len(run[0])
        if size <= self.burst:
            return runs, size
        whole = merged(list(runs))
        self.size += len(whole[0]) - size
        if len(whole[0]) <= self.burst // 2 or depth >= DEEPEST:
            return (whole,), len(whole[0])
        children = [None] * 256  # the container bursts
        self.size -= len(whole[0])
        self._branch(children, whole, depth)
        return children

    def add(self, run: tuple):
        """Counts a run in key order; yields the runs of subtrees that have to go."""
        if len(run[0]):
            self._branch(self.root, run, 0)
        if self.size > self.limit:
            sizes = [self._size(x) for x in self.root]
            for k in sorted(range(256), key=lambda k: -sizes[k]):
                if self.size <= self.limit // 2:
                    break
                yield from self._spill(k, sizes[k])

    def _size(self, node) -> int:
        return sum(map(self._size, node)) if isinstance(node, list) else node[1] if node else 0

    def _spill(self, k: int, size: int):
        def below(node):
            if isinstance(node, list):
                for x in node:
                    yield from below(x)
            elif node:
                yield merged(list(node[0]))

        parts = list(below(self.root[k]))
        self.root[k] = None
        self.size -= size
        if parts:
            yield tuple(np.concatenate(c) for c in zip(*parts))

    def rest(self):
        for k in range(256):
            yield from self._spill(k, self._size(self.root[k]))


def bits_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(key)
    return (h & np.uint64(WORDS - 1)).astype(np.int64), np.uint64(1) << (h >> np.uint64(58))


def bloom(frequent: DataFrame, names: list[str]) -> np.ndarray:
    """Bits of the frequent phrases' keys; at most ``WORDS`` rows come to the driver."""
    def run(batches):
        held = np.zeros(WORDS, np.uint64)
        for batch in batches:
            ids = [batch.column(x).to_numpy(zero_copy_only=False).view(np.uint64) for x in range(len(names))]
            np.bitwise_or.at(held, *bits_of(phrase_key(ids)))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at].view(np.int64))], ["word", "bits"])

    out = np.zeros(WORDS, np.uint64)
    for row in (frequent.select(*names).mapInArrow(run, "word long, bits long").groupBy("word")
                .agg(F.bit_or("bits").alias("bits")).toLocalIterator()):
        out[row["word"]] = np.uint64(row["bits"] & (1 << 64) - 1)
    return out


def lang_ids(column: pa.Array, seed: int) -> np.ndarray:
    code = column.dictionary_encode()
    h = [int.from_bytes(hashlib.blake2b(f"{seed}:{x}".encode(), digest_size=8).digest(), "little") for x in code.dictionary.to_pylist()]
    return np.array(h or [0], np.uint64)[code.indices.to_numpy(zero_copy_only=False)]


def count_phrases(documents: DataFrame, length: int, sieve=None, seed: int = 0, limit: int = LIMIT,
                  burst: int = BURST) -> DataFrame:
    """(w1, .., n) of phrases of ``length`` words whose parts pass ``sieve`` (a broadcast filter); for one word
    also lang and word."""
    ids = [f"w{k + 1}" for k in range(length)]
    schema = ", ".join(f"{x} long" for x in ids) + ", n long" + (", lang string, word string" if length == 1 else "")

    def out(run, texts=None):
        size = len(run[0])
        columns = [pa.array(x.view(np.int64)) for x in run[1:]]
        if length == 1:
            columns += texts or [pa.nulls(size, pa.string())] * 2
        for a in range(0, size, 1 << 16):
            yield pa.RecordBatch.from_arrays([c.slice(a, 1 << 16) for c in columns], [*ids, "n"] + ["lang", "word"] * (length == 1))

    def run(batches):
        trie, known, held = Trie(limit, burst), np.zeros(0, np.uint64), sieve.value if sieve else None
        for batch in batches:
            data, off = flat(batch.column(0))
            langs = lang_ids(batch.column(1), seed)
            for a, b in chunks(off):
                text, o = LOWER[data[off[a]:off[b]]], off[a:b + 1] - off[a]
                solid = ~(GAP[text] | STOP[text])
                start, end, row = spans(solid, o)
                piece = np.cumsum(STOP[text])[start] if len(start) else start
                w = mix(span_hash(prefix_hash(text), start, end) + langs[a:b][row])
                join = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])  # a word and the next one
                parts = [w]
                if length > 1:
                    good = join
                    if held is not None and length == 2:
                        word, bit = bits_of(phrase_key([w]))
                        ok = (held[word] & bit) != 0
                        good = good & ok[1:] & ok[:-1]
                    at = np.flatnonzero(good)
                    if length == 3:
                        if held is not None:
                            word, bit = bits_of(phrase_key([w[at], w[at + 1]]))
                            at = at[(held[word] & bit) != 0]
                        has = np.zeros(len(w) + 1, bool)
                        has[at] = True
                        at = at[has[at + 1]]
                    parts = [w[at + k] for k in range(length)]
                counted = merged([(phrase_key(parts), *parts, np.ones(len(parts[0]), np.int64))])
                if length == 1:  # the words themselves, once a task
                    found, first = np.unique(w, return_index=True)
                    place = np.searchsorted(known, found)
                    fresh = np.append(known, np.uint64(0))[place] != found
                    fresh[place == len(known)] = True
                    known = np.sort(np.concatenate((known, found[fresh])), kind="stable") if len(known) < limit else found
                    first = first[fresh]
                    raw = text.tobytes()
                    names = pa.array([raw[x:y] for x, y in zip(start[first].tolist(), end[first].tolist())], pa.binary()).cast(pa.string())
                    yield from out((w[first], w[first], np.zeros(len(first), np.int64)),
                                   [batch.column(1).slice(a, b - a).take(pa.array(row[first])), names])
                for spilled in trie.add(counted):
                    yield from out(spilled)
        for spilled in trie.rest():
            yield from out(spilled)

    rows = documents.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return rows.mapInArrow(run, schema)


def mine(documents: DataFrame, min_count: int = 10, overlap: int = 50, top: int = 2000, seed: int = 0, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best ``top`` phrases of two and three words.

    Candidates come ``min_count`` times or more. Candidates inside a longer one that has ``overlap`` percent of
    their count are dropped."""
    spark = documents.sparkSession
    prepare(spark)
    often = F.col("n") >= min_count

    words = count_phrases(documents, 1, None, seed, **sizes).repartition("w1").groupBy("w1").agg(
        F.sum("n").alias("n"), F.max("lang").alias("lang"), F.max("word").alias("word"),
        ((F.min("word") != F.max("word")) | (F.min("lang") != F.max("lang"))).alias("shared"))
    words = saved(words.select("w1", "n", "lang", F.when(F.col("shared"), F.raise_error(F.lit(
        "two words share an id: choose another seed"))).otherwise(F.col("word")).alias("word")))
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    one = words.where(often)
    held = [spark.sparkContext.broadcast(bloom(one, ["w1"]))]
    two = saved(count_phrases(documents, 2, held[0], seed, **sizes).repartition("w1", "w2")
                .groupBy("w1", "w2").agg(F.sum("n").alias("n")).where(often))
    held.append(spark.sparkContext.broadcast(bloom(two, ["w1", "w2"])))
    three = saved(count_phrases(documents, 3, held[1], seed, **sizes).repartition("w1", "w2", "w3")
                  .groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n")).where(often))

    part = lambda table, names, tag: table.select(
        *[F.col(x).alias(y) for x, y in zip(("w1", "w2"), names)], F.col("n").alias(tag))
    cut = lambda l, r: F.struct(F.expr(
        f"(cast(a as decimal(19,0)) * a * 1000000) div (cast({l} as decimal(19,0)) * {r})").alias("score"),
        F.col(l).alias("l"), F.col(r).alias("r"))
    inside = three.select("w1", "w2", "n").union(three.select("w2", "w3", "n")).groupBy("w1", "w2").agg(F.max("n").alias("longer"))
    pairs = (two.join(part(one, ["w1"], "n1"), "w1").join(part(one, ["w2"], "n2"), "w2").join(inside, ["w1", "w2"], "left")
             .where(F.col("longer").isNull() | (100 * F.col("longer") < overlap * F.col("n")))
             .select("w1", "w2", F.lit(None).cast("long").alias("w3"), F.col("n").alias("a"), "n1", "n2")
             .select("*", cut("n1", "n2").alias("c")))
    triples = (three.withColumnRenamed("n", "a").join(part(one, ["w1"], "n1"), "w1").join(part(one, ["w3"], "n3"), "w3")
               .join(part(two, ["w1", "w2"], "n12"), ["w1", "w2"]).join(part(two, ["w2", "w3"], "n23"), ["w2", "w3"])
               .select("w1", "w2", "w3", "a", cut("n1", "n23").alias("c1"), cut("n12", "n3").alias("c2")))
    triples = triples.withColumn("c", F.when(F.col("c2.score") < F.col("c1.score"), F.col("c2")).otherwise(F.col("c1")))
    columns = ["w1", "w2", "w3", "a", "c.l", "c.r", "c.score"]
    found = pairs.select(*columns).unionByName(triples.select(*columns))
    named = lambda k: one.select(F.col("w1").alias(f"w{k}"), F.col("word").alias(f"t{k}"), *["lang"][:k == 1])
    found = found.join(named(1), "w1").join(named(2), "w2").join(named(3), "w3", "left")
    found = found.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", "l", "r", "score")
    # places by ranges of the candidates, so that no lang's candidates meet in one task
    place = F.struct((-F.col("score")).alias("s"), (-F.col("a")).alias("a"), "phrase")
    found = running_totals(found.select("*", place.alias("place"), F.lit(1).cast("long").alias("one")), ["lang"], "place", {"rank": "one"})
    found = found.where(F.col("rank") < top).withColumn("rank", F.col("rank") + 1)
    return found.join(total.withColumnRenamed("total", "n"), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, any_value(w[i:i + k - 1]) AS w, count(*) AS a
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY lang, k, g),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT c.lang, c.g, c.k, c.a, j, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
    JOIN f x ON x.lang = c.lang AND x.k = j AND x.g = array_to_string(c.w[:j], ' ')
    JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.g = array_to_string(c.w[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inside AS (SELECT lang, g, max(a) AS a FROM (SELECT lang, array_to_string(w[:2], ' ') AS g, a FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM c WHERE k = 3) GROUP BY lang, g),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON b.k = 2 AND i.lang = b.lang AND i.g = b.g
    WHERE i.a IS NULL OR 100 * i.a < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r,
  n::BIGINT AS n, score::BIGINT AS score FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000
"""
