"""Deterministic views over the driver's tables that have the shapes of the reference inputs.

Each function mirrors one view of FIXTURES.md part 2 (the DuckDB text of the same views is in
``lexsense.oracle``). They only derive columns from the given tables, so every job that reads
them grows with the data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import py_split
from .session import table


TURNS = 1 << 32  # row numbers: conversation * TURNS + turn


def _s(c) -> Column:
    return c.cast("string")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """v_pairs: gold gloss and a model answer per row (DG scoring input): the answer to an even turn is
    the whole next turn, empty where there is none. One conversation in ten has each gloss once more,
    answered by its upper-cased copy."""
    a = table(spark, sf, "conversations").alias("a")
    b = table(spark, sf, "conversations").alias("b")
    cid, turn = F.col("a.conv_id"), F.col("a.turn")

    def rows(at, answer):
        return [(cid * TURNS + at).alias("row_id"), F.concat(F.lit("m"), _s(cid % 4)).alias("model"),
                F.concat(F.lit("d"), _s(cid % 5)).alias("dataset"), F.col("a.text").alias("gloss"), answer.alias("answer")]

    asked = a.where(turn % 2 == 0)
    answered = asked.join(b, (F.col("b.conv_id") == cid) & (F.col("b.turn") == turn + 1), "left")
    return answered.select(*rows(turn, F.coalesce("b.text", F.lit("")))).unionByName(
        asked.where(cid % 10 == 0).select(*rows(turn + 1, F.upper("a.text"))))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """v_lines: aligned sense / example lines per (dataset, split): the whole document is the gloss
    (a numeric or too-short one for two documents in fifty) and, with every " the " turned into the
    placeholder, the example context."""
    d = table(spark, sf, "documents")
    did = F.col("doc_id")
    return d.select(
        did.alias("line_no"),
        F.col("source").alias("dataset"),
        F.when(did % 10 == 0, "test").when(did % 10 == 1, "valid").otherwise("train").alias("split"),
        F.concat(F.col("lang"), F.lit("%"), _s(did)).alias("sense"),
        F.when(did % 50 == 0, "12345678").when(did % 50 == 1, "abc")
        .otherwise(F.col("text")).alias("gloss"),
        F.replace(F.col("text"), F.lit(" the "), F.lit(" <TRG> ")).alias("context"),
    )


def uses(spark: SparkSession, sf: str) -> DataFrame:
    """v_uses: usages with a target span "s:e" (every 7th lacks its end): each document's second word.
    Identifiers are unique within a target only."""
    d = table(spark, sf, "documents")
    did = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    at = F.instr(text, " ")
    end = at + F.length(F.split_part(text, F.lit(" "), F.lit(2)))
    return d.select(
        _half(did).alias("identifier"),
        (1 + _half(did) % 2).alias("grouping"),
        _usage_target(did).alias("target"),
        text.alias("example"),
        F.when(did % 7 == 0, _s(at))
        .otherwise(F.concat(_s(at), F.lit(":"), _s(end))).alias("indexes_target_token"),
    )


def _half(c) -> Column:
    return F.floor(c / 2)


def _usage_target(did) -> Column:
    return F.concat(F.coalesce("lang", F.lit("und")), F.when(did % 2 == 0, "_nn").otherwise("_vb"))


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """v_clusters: gold cluster per usage (target, identifier), -1 = noise."""
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return lab.select(
        _usage_target(F.col("doc_id")).alias("target"),
        _half(F.col("doc_id")).alias("identifier"),
        F.when(F.col("toxic") == 1, F.lit(-1)).otherwise(F.col("quality")).alias("cluster"),
    )


def wic_lines(spark: SparkSession, sf: str) -> DataFrame:
    """v_wic_lines: raw WiC lines (target, pos, "i-j", example1, example2)."""
    a = table(spark, sf, "conversations").alias("a")
    b = table(spark, sf, "conversations").alias("b")
    turn = F.col("a.turn")
    at = lambda side, k: _s(k % F.greatest(F.size(py_split(f"{side}.text")), F.lit(1)))  # noqa: E731  of the text's own tokens
    return a.join(b, (F.col("b.conv_id") == F.col("a.conv_id")) & (F.col("b.turn") == turn + 1)).select(
        (F.col("a.conv_id") * TURNS + turn).alias("line_no"),
        F.col("a.role").alias("target"),
        F.lit("N").alias("pos"),
        F.concat(at("a", turn), F.lit("-"), at("b", turn + 1)).alias("indexes"),
        F.col("a.text").alias("example1"),
        F.col("b.text").alias("example2"),
    )


def judgments(spark: SparkSession, sf: str) -> DataFrame:
    """v_judgments: annotator judgments of usage pairs; identifiers repeat over targets."""
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("t"), _s(F.col("event_id") % 3)).alias("target"),
        F.col("user_id").alias("identifier1"),
        F.col("event_type").alias("identifier2"),
        F.col("value").alias("judgment"),
    )


def vector_target(vec_id) -> Column:
    """Eight targets for every 512 vectors, so that targets grow in number with the table."""
    return F.concat(F.lit("t"), _s(F.floor(vec_id / 512) * 8 + vec_id % 8))


def usages(spark: SparkSession, sf: str) -> DataFrame:
    """v_usages: three usages, of both periods, for every vector, which is their gloss's; with gold clusters."""
    e = table(spark, sf, "embeddings").select("*", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("k"))
    vid = F.col("vec_id")
    line = 3 * vid + F.col("k")
    return e.select(
        line.alias("line_no"),
        vector_target(vid).alias("target"),
        (1 + (F.floor(vid / 8) + F.col("k")) % 2).alias("grouping"),
        F.concat(F.lit("u"), _s(line)).alias("identifier"),
        F.when(line % 37 == 0, F.lit(-1)).otherwise(F.col("label")).alias("cluster"),
        F.concat(F.lit("g"), _s(vid)).alias("gloss"),
        "embedding",
    )


def gloss_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(gloss, embedding) of v_usages, one row a gloss."""
    return table(spark, sf, "embeddings").select(F.concat(F.lit("g"), _s(F.col("vec_id"))).alias("gloss"), "embedding")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """v_gold: graded change per lemma."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("t"), _s(k)).alias("lemma"),
        ((k * 37 % 11) / 10.0).cast("double").alias("change_graded"),
    )


def _few(text, first: int, n: int) -> Column:
    """``n`` words (by single spaces) of a text from its word ``first`` on."""
    return F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), " ", first + n + 1), first + 1, n), " ")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """v_answers: what two models (in two folders) answered for every usage at two context lengths; 64 usages a target."""
    did = F.col("doc_id")
    runs = F.explode(F.array(*[F.struct(F.lit(x).alias("suffix"), F.lit(f).alias("model_folder"), F.lit(m).alias("ft_model_name"),
                                        _few(F.col("text"), k, n).alias("answer"))
                               for x, f, m, k, n in ANSWERS]))
    return table(spark, sf, "documents").select("*", runs.alias("r")).select(
        "r.suffix", "r.model_folder", "r.ft_model_name", F.concat(F.lit("t"), _s(F.floor(did / 64))).alias("target"),
        did.alias("line_no"), (1 + did % 2).alias("grouping"),
        F.when(did % 37 == 0, F.lit(-1)).otherwise(F.col("n_chars") % 4).alias("cluster"), "r.answer")


# (suffix, folder, model, first word, words) of each run of v_answers
ANSWERS = (("25", "t5-answers", "gen-A", 0, 1), ("25", "lora-answers", "gen-B", 1, 2), ("", "t5-answers", "gen-A", 2, 1),
           ("", "lora-answers", "gen-B", 3, 2))


def wic_answers(spark: SparkSession, sf: str) -> DataFrame:
    """v_wic_answers: answer lines of two models; lines 2i and 2i + 1 are a pair."""
    did = F.col("doc_id")
    runs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.concat(_few(F.col("text"), k, 2), F.lit(" . ,; ")).alias("answer"))
                               for m, k in (("gen-A", 0), ("gen-B", 3))]))
    return table(spark, sf, "documents").select("*", runs.alias("r")).select(
        "r.model", F.when(F.floor(did / 2) % 2 == 0, "dev").otherwise("test").alias("part"), did.alias("line_no"), "r.answer")


def wic_gold(spark: SparkSession, sf: str) -> DataFrame:
    """v_wic_gold: the gold line of every pair."""
    did = F.col("doc_id")
    return table(spark, sf, "documents").where(did % 2 == 0).select(
        F.floor(did / 2).alias("pair_id"), F.when(F.col("n_chars") % 2 == 0, " T").otherwise("F ").alias("gold"))


def text_vectors(spark: SparkSession, sf: str, texts: DataFrame, column: str) -> DataFrame:
    """(column, embedding): a vector for each distinct text, by its md5 modulo the number of vectors."""
    e = table(spark, sf, "embeddings")
    n = F.greatest(e.agg(F.count("*")).scalar(), F.lit(1))
    t = texts.select(column).distinct().withColumn(
        "vec_id", F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long") % n)
    return t.join(e.select("vec_id", "embedding"), "vec_id").select(column, "embedding")


def wic(spark: SparkSession, sf: str) -> DataFrame:
    """v_wic: one row per WiC pair with both gloss vectors and the gold label."""
    a = table(spark, sf, "embeddings").alias("a")
    b = table(spark, sf, "embeddings").alias("b")
    vid = F.col("a.vec_id")
    pid = F.floor(vid / 2)
    return a.join(b, F.col("b.vec_id") == vid + 1).where(vid % 2 == 0).select(
        pid.alias("pair_id"),
        F.concat(F.lit("m"), _s(pid % 4)).alias("model"),
        F.when(F.floor(vid / 8) % 2 == 0, "dev").otherwise("test").alias("part"),
        ((F.col("a.label") < 5) == (F.col("b.label") < 5)).cast("int").alias("label"),
        F.col("a.embedding").alias("e1"),
        F.col("b.embedding").alias("e2"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """v_runs: per-row scores of a fine-tuning sweep, run id packs the settings."""
    li = table(spark, sf, "lineitem")
    ln = F.col("l_linenumber")
    return li.select(
        F.concat(F.lit("fam"), _s(F.col("l_suppkey") % 2), F.lit("-"), _s(4 * ln), F.lit("-"), _s(8 * ln),
                 F.lit("-0.1-0.001-1e-4")).alias("run_id"),
        F.when(F.col("l_returnflag") == "A", "oxford_test")
        .when(F.col("l_returnflag") == "N", "wordnet_test")
        .otherwise("en-codwoe_test").alias("dataset"),
        F.col("l_discount").alias("nltk_bleu"),
        F.col("l_tax").alias("rougeL"),
        (F.col("l_quantity") / 50).alias("bertscore"),
    )


def results(spark: SparkSession, sf: str) -> DataFrame:
    """v_results: WSI/LSC result records of a sweep."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        F.when(k % 5 == 0, F.lit("")).otherwise(_s(25 * (k % 5))).alias("suffix"),
        (1 + k % 4).alias("filter_"),
        F.col("p_brand").alias("ft_model_name"),
        F.col("p_type").alias("model"),
        (F.col("p_size") / 50.0).alias("ARI"),
        (F.col("p_retailprice") / 2000).alias("PUR"),
        ((k % 101) / 100.0).alias("RI"),
        ((k % 89) / 88.0).alias("APD"),
        ((k % 97) / 96.0).alias("APDP"),
        k.alias("row_key"),
    )


def token_vectors(spark: SparkSession, sf: str, tokens: DataFrame) -> DataFrame:
    """Vector per distinct token: by the token's md5 modulo the number of vectors. One token in eleven has none."""
    h = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long")
    return text_vectors(spark, sf, tokens.where((F.length("token") > 0) & (h % 11 != 0)), "token")


def toy_token_ids(text) -> Column:
    """Token ids by the fixture rule (code point of the first char + 7 x length) mod 500."""
    return F.transform(py_split(text), lambda w: (F.ascii(w) + 7 * F.length(w)).cast("long") % 500)
