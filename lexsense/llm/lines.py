"""Line-first quality rules (operator 5), in DataFrame functions only.

Every line with a word is judged by itself: ``symbols`` (punctuation rule: more than a tenth of its
characters are symbols, or it is mostly shouted words), ``navigation`` (three or more bars) and
``boilerplate`` (licence and site notices). Failing lines are removed; a document that loses more than
``max_loss`` of the characters of its lines is rejected, as is one that fails the base rules
(fewer than 50 words, or more than half of the words in repeated three-word windows).

Defined results: null and empty texts have no words and fail the base rules; rows are judged one by
one, so repeated rows give repeated results; extra columns are ignored. Windows of three words are
compared by 64-bit hashes within one text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Wording of notices.
NOTICE = (r"(?i)(all rights reserved|licensed under|released under|copyright|cookie policy|privacy policy|"
          r"terms of (use|service)|enable javascript|subscribe to our)")


def without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def fails(line: Column) -> Column:
    """Whether a line breaks a rule."""
    n = F.length(line)
    symbols = (n - without(line, SYMBOL)) * 10 > n
    shouted = F.regexp_count(line, F.lit("!!")) * 3 > F.size(F.split(F.trim(line), GAP))
    return symbols | shouted | line.rlike(r"\|[^|]*\|[^|]*\|") | line.rlike(NOTICE)


def clean_lines(documents: DataFrame, max_loss: float = 0.5) -> DataFrame:
    """doc_id, the counts of the base rules, n_lines, n_failed, clean_text, kept of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        F.filter(F.split(text, GAP), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.select(
        "*", F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.filter("lines", lambda x: ~fails(x)).alias("good"))
    n = F.col("n_words").cast("int")
    pair = F.zip_with("h", F.slice("h", F.lit(2), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    triple = F.zip_with(pair, F.slice("h", F.lit(3), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    rows = rows.select("*", F.when(n >= 3, F.slice(triple, F.lit(1), F.greatest(n - 2, F.lit(1))))
                       .otherwise(F.array().cast("array<bigint>")).alias("windows"))
    # (hash, place) in order, only where some window comes twice
    order = F.when(F.size(F.array_distinct("windows")) < F.size("windows"),
                   F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    rows = rows.select("*", order.alias("s"))
    size = F.size("s")
    beside = F.arrays_zip(
        F.col("s").alias("e"), F.slice("s", F.lit(2), F.greatest(size, F.lit(1))).alias("next"),
        F.concat(F.array(F.lit(None).cast("struct<x:bigint,i:int>")), F.slice("s", F.lit(1), F.greatest(size - 1, F.lit(0)))).alias("last"))
    twice = F.filter(beside, lambda z: F.coalesce(z["e"]["x"] == z["next"]["x"], F.lit(False))
                     | F.coalesce(z["e"]["x"] == z["last"]["x"], F.lit(False)))
    rows = rows.select("*", F.sort_array(F.transform(twice, lambda z: z["e"]["i"])).alias("at"))
    gaps = F.zip_with("at", F.slice("at", F.lit(2), F.greatest(F.size("at"), F.lit(1))),
                      lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.when(F.size("at") > 0, F.aggregate(gaps, F.lit(0), lambda s, x: s + x)).otherwise(0)
    total = F.aggregate("lines", F.lit(0), lambda s, x: s + F.length(x))
    left = F.aggregate("good", F.lit(0), lambda s, x: s + F.length(x))
    rows = rows.select(
        "doc_id", "n_words", without(F.col("text"), GAP).cast("long").alias("word_chars"),
        (F.length("text") - without(F.col("text"), SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_failed"),
        total.alias("_total"), left.alias("_left"), F.array_join("good", "\n").alias("clean_text"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = (F.col("_total") - F.col("_left")) > F.lit(max_loss) * F.col("_total")
    return rows.select(*[c for c in rows.columns if c[0] != "_"], base.alias("base_failed"), (~base & ~lost).alias("kept"))


def op5_quality_rules(spark, sf_dir):
    return clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_failed")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
    SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
g AS (SELECT *, list_filter(l, lambda x: NOT (
      (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 10 > length(x)
      OR len(regexp_extract_all(x, '!!')) * 3 > len(regexp_split_to_array(trim(x, ' '), '[\x20\x09-\x0D]+'))
      OR regexp_matches(x, '\|[^|]*\|[^|]*\|')
      OR regexp_matches(x, '(?i)(all rights reserved|licensed under|released under|copyright|cookie policy|privacy policy|terms of (use|service)|enable javascript|subscribe to our)'))) AS good
  FROM d),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, (len(l) - len(good))::BIGINT AS n_failed,
    coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS total,
    coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS rest
  FROM g LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND total - rest <= 0.5 * total AS kept,
  n_lines, n_failed
FROM f
"""
