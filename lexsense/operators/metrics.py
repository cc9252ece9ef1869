"""Text metrics of the definition-generation task (M1-M7), one value per prediction row.

Everything is keyed by ``row_id``. ``prepare`` hash-partitions the compact input rows on
``row_id`` once; the n-gram, alignment and join steps below all group or join on ``row_id``
(plus more keys), which that partitioning already satisfies, so the whole scoring job has a
single exchange of the input plus one for the token-vector lookup of M7.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalise, tokens
from .ngrams import gram_counts

# The metric names of the score files.
METRICS = ("rougeL", "nltk_bleu", "nist", "sacrebleu", "meteor", "bertscore", "exact_match")

# Fixed values of the metric definitions (library defaults the reference relies on).
METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA = 0.9, 3.0, 0.5
NIST_BETA = math.log(0.5) / math.log(1.5) ** 2
BLEU_MAX_N = 4
NIST_MAX_N = 5


def prepare(pairs: DataFrame, gold: str = "gloss", pred: str = "answer",
            partitions: int | None = None) -> DataFrame:
    """(row_id, g, p, g_tokens, p_tokens, lg, lp), hash-partitioned on row_id.

    Only (row_id, g_tokens, p_tokens) cross the exchange; the normalised texts are the tokens
    joined by one space and the lengths their sizes, both derived after it. Every metric branch
    therefore reads an identical exchange, which Spark shuffles once and reuses."""
    # the explicit not-null filter equals what joins on row_id would infer and push below the
    # exchange in some branches only, so all branches keep an identical (reusable) exchange
    df = pairs.where(F.col("row_id").isNotNull()).select(
        "row_id", tokens(normalise(gold)).alias("g_tokens"), tokens(normalise(pred)).alias("p_tokens"))
    # An explicit count keeps AQE from coalescing this exchange: the work after it (grams,
    # alignments, LCS) is compute-heavy per row, so it wants all the partitions it can get.
    n = partitions or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(n, "row_id")
    return df.select("row_id", F.array_join("g_tokens", " ").alias("g"), F.array_join("p_tokens", " ").alias("p"),
                     "g_tokens", "p_tokens", F.size("g_tokens").alias("lg"), F.size("p_tokens").alias("lp"))


# ---------------------------------------------------------------- BLEU, NIST, sacreBLEU


def ngram_stats(prep: DataFrame) -> DataFrame:
    """Per row: clipped matches m1..m5, prediction totals tp1..tp5 and NIST information sums s1..s5.

    NIST weighs a matched gram g by log2(cg(prefix g) / cg(g)). Instead of joining every gram to
    its prefix, each gram count row contributes twice to one more aggregation keyed by
    (row_id, level, key): its own counts under (n, gram), and its clipped match under
    (n - 1, prefix). Then sum over matched g of min * log2 cg(prefix) = sum over prefixes q of
    log2 cg(q) * (clipped matches of q's children). All steps group by row_id first, so the
    row_id partitioning of ``prep`` serves them all: no join and no further exchange."""
    # grams that the prediction lacks add to no sum: neither do they match, nor does any gram that starts with them
    counts = gram_counts(prep, NIST_MAX_N).where("cp > 0")
    matched = (F.col("cg") > 0) & (F.col("cp") > 0)
    child = F.when(matched & (F.col("n") > 1), F.least("cg", "cp")).otherwise(F.lit(0)).cast("long")
    own = F.struct(F.col("n").alias("lvl"), F.col("gram").alias("key"), F.col("cg").alias("cg"),
                   F.col("cp").alias("cp"), F.lit(0).cast("long").alias("kids"))
    kid = F.struct((F.col("n") - 1).alias("lvl"), F.col("prefix").alias("key"), F.lit(0).cast("long").alias("cg"),
                   F.lit(0).cast("long").alias("cp"), child.alias("kids"))
    roles = F.when(child > 0, F.array(own, kid)).otherwise(F.array(own))
    contrib = counts.select("row_id", F.explode(roles).alias("r")).select("row_id", "r.*")
    keyed = contrib.groupBy("row_id", "lvl", "key").agg(
        F.sum("cg").alias("cg"), F.sum("cp").alias("cp"), F.sum("kids").alias("kids"))
    # per-order sums in one aggregation, written as SQL text (one parse instead of many calls)
    own = "case when cg > 0 and cp > 0 then least(cg, cp) * log2(cg) else 0d end"
    via = "case when kids > 0 then kids * log2(cg) else 0d end"
    aggs = []
    for k in range(1, NIST_MAX_N + 1):
        aggs += [F.expr(f"sum(case when lvl = {k} then least(cg, cp) else 0 end) as m{k}"),
                 F.expr(f"sum(case when lvl = {k} then cp else 0 end) as tp{k}"),
                 F.expr(f"sum(case when lvl = {k} then {own} else 0d end) as _own{k}"),
                 F.expr(f"sum(case when lvl = {k} then {via} else 0d end) as _via{k}")]
    per_row = keyed.groupBy("row_id").agg(*aggs)
    # s_k: info of matched order-k grams; the unigram prefix count (gold length) is added later
    s_cols = [F.expr("-_own1 as s1")] + [F.expr(f"_via{k - 1} - _own{k} as s{k}") for k in range(2, NIST_MAX_N + 1)]
    return per_row.select("row_id", *[f"m{k}" for k in range(1, NIST_MAX_N + 1)],
                          *[f"tp{k}" for k in range(1, NIST_MAX_N + 1)], *s_cols)


def _z(c: str) -> str:
    return f"coalesce({c}, 0)"


def bleu_sql(lg: str = "lg", lp: str = "lp") -> str:
    """M2: NLTK sentence BLEU-4, smoothing method 2, weights re-spread when len(p) < 4."""
    k = f"least({BLEU_MAX_N}, {lp})"
    logs = [f"ln({_z('m1')} / {lp})"] + [
        f"case when {n} <= {k} then ln(({_z(f'm{n}')} + 1) / ({_z(f'tp{n}')} + 1)) else 0d end"
        for n in range(2, BLEU_MAX_N + 1)]
    bp = f"case when {lp} > {lg} then 1d else exp(1 - {lg} / {lp}) end"
    return (f"case when {lp} = 0 or {_z('m1')} = 0 then 0d "
            f"else {bp} * exp(({' + '.join(logs)}) / {k}) end")


def sacrebleu_sql(lg: str = "lg", lp: str = "lp") -> str:
    """M4: sacreBLEU sentence score (exp smoothing, no effective order), 0-100."""
    logs, zeros = [], []
    for n in range(1, BLEU_MAX_N + 1):
        m, t = _z(f"m{n}"), _z(f"tp{n}")
        zeros.append(f"case when {m} = 0 then 1 else 0 end")
        logs.append(f"case when {m} > 0 then ln(100d * {m} / {t}) else ln(100d / (pow(2d, {' + '.join(zeros)}) * {t})) end")
    any_match = " + ".join(_z(f"m{n}") for n in range(1, BLEU_MAX_N + 1)) + " > 0"
    bp = f"case when {lp} < {lg} then exp(1 - {lg} / {lp}) else 1d end"
    return (f"case when {lp} < {BLEU_MAX_N} or not ({any_match}) then 0d "
            f"else {bp} * exp(({' + '.join(logs)}) / {BLEU_MAX_N}) end")


def nist_sql(lg: str = "lg", lp: str = "lp") -> str:
    """M3: NLTK sentence NIST with n = min(5, len(p)); errors (empty sides) give 0."""
    parts = [f"({_z('s1')} + {_z('m1')} * log2({lg})) / {lp}"] + [
        f"case when {i} <= {lp} then {_z(f's{i}')} / ({lp} - {i - 1}) else 0d end" for i in range(2, NIST_MAX_N + 1)]
    pen = f"case when {lp} / {lg} < 1 then exp({NIST_BETA!r} * pow(ln({lp} / {lg}), 2)) else 1d end"
    return f"case when {lp} = 0 or {lg} = 0 then 0d else ({' + '.join(parts)}) * {pen} end"


def bleu_column(lg="lg", lp="lp") -> Column:
    return F.expr(bleu_sql(lg, lp))


def sacrebleu_column(lg="lg", lp="lp") -> Column:
    return F.expr(sacrebleu_sql(lg, lp))


def nist_column(lg="lg", lp="lp") -> Column:
    return F.expr(nist_sql(lg, lp))


# ---------------------------------------------------------------- METEOR


def _token_rows(prep: DataFrame) -> DataFrame:
    """(row_id, side, pos, word): one row per token of either side (pos 0-based)."""
    from .ngrams import _sides
    return _sides(prep).select("row_id", "side", F.posexplode("toks").alias("pos", "word"))


def _align(toks: DataFrame, key: str) -> DataFrame:
    """Match the k-th-from-last p token with the k-th-from-last g token of equal ``key``.

    Both sides are ranked from the end per (row, side, key); a match is a (row, key, rank) that
    both sides have, found with one aggregation (keyed by row_id first, so no exchange)."""
    w = Window.partitionBy("row_id", "side", key).orderBy(F.col("pos").desc())
    r = toks.withColumn("rk", F.row_number().over(w))
    m = r.groupBy("row_id", key, "rk").agg(
        F.max(F.when(F.col("side") == "p", F.col("pos"))).alias("p_pos"),
        F.max(F.when(F.col("side") == "g", F.col("pos"))).alias("g_pos"))
    return m.where(F.col("p_pos").isNotNull() & F.col("g_pos").isNotNull()).select("row_id", "p_pos", "g_pos")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _first_come(ps: pd.Series, gs: pd.Series) -> pd.Series:
    """One-to-one pairs (p_pos, g_pos) of a row, whose synsets hold the positions ``ps[k]`` and ``gs[k]``.

    Prediction tokens choose in order, the last first, each the last free gold token of its synsets. Every
    synset keeps its gold positions as a stack, so the work follows the number of memberships, not of pairs."""
    out = []
    for p_sets, g_sets in zip(ps, gs):
        stacks, sets_of, taken, found = [sorted(g) for g in g_sets], {}, set(), []
        for k, positions in enumerate(p_sets):
            for x in positions:
                sets_of.setdefault(x, []).append(k)
        for x in sorted(sets_of, reverse=True):
            best = -1
            for k in sets_of[x]:
                while stacks[k] and stacks[k][-1] in taken:
                    stacks[k].pop()
                if stacks[k]:
                    best = max(best, stacks[k][-1])
            if best >= 0:
                taken.add(best)
                found.append([int(x), int(best)])
        out.append(found)
    return pd.Series(out)


def _synonym_matches(rest: DataFrame, key: str, synonyms: DataFrame) -> DataFrame:
    """(row_id, p_pos, g_pos): tokens left of the earlier stages whose words share a synset, one to one.

    Candidates are many to many; they travel as positions per (row, synset), never as pairs, and synsets
    that only one side of a row has are dropped before the row's lists meet."""
    member = rest.join(synonyms.select(F.col("word").alias(key), "synset").distinct(), key)
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.col("pos"))).alias(s)
    sets = member.groupBy("row_id", "synset").agg(side("p"), side("g")).where((F.size("p") > 0) & (F.size("g") > 0))
    rows = sets.groupBy("row_id").agg(F.collect_list(F.struct("p", "g")).alias("_s"))
    pairs = rows.select("row_id", F.explode(_first_come(F.col("_s")["p"], F.col("_s")["g"])).alias("_m"))
    return pairs.select("row_id", F.col("_m")[0].alias("p_pos"), F.col("_m")[1].alias("g_pos"))


def _unmatched(toks: DataFrame, matches: DataFrame) -> DataFrame:
    """Tokens of either side that no match holds."""
    sides = [toks.where(F.col("side") == s).join(
        matches.select("row_id", F.col(f"{s}_pos").alias("pos")), ["row_id", "pos"], "left_anti") for s in ("p", "g")]
    return sides[0].unionByName(sides[1])


def meteor(prep: DataFrame, stems: DataFrame | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """M5: METEOR (alpha .9, beta 3, gamma .5) with the exact stage and, on the tokens it leaves, the stem
    stage given a (word, stem) table and the synonym stage given a (word, synset) table. After the stem stage
    synonyms are looked up by stem, as the usual implementation does."""
    toks = _token_rows(prep)
    matches, key = _align(toks, "word"), "word"
    if stems is not None:
        rest = _unmatched(toks, matches).join(stems.select("word", "stem"), "word", "left")
        rest = rest.withColumn("stem", F.coalesce("stem", "word"))
        matches, key = matches.unionByName(_align(rest, "stem")), "stem"
    if synonyms is not None:
        rest = _unmatched(rest if stems is not None else toks, matches)
        matches = matches.unionByName(_synonym_matches(rest, key, synonyms))
    w = Window.partitionBy("row_id").orderBy("p_pos")
    chunked = matches.withColumn(
        "starts",
        F.when((F.lag("p_pos").over(w) == F.col("p_pos") - 1) & (F.lag("g_pos").over(w) == F.col("g_pos") - 1), 0)
        .otherwise(1))
    per_row = chunked.groupBy("row_id").agg(F.count("*").alias("mm"), F.sum("starts").alias("chunks"))
    j = prep.select("row_id", "lg", "lp").join(per_row, "row_id", "left")
    m = F.coalesce(F.col("mm"), F.lit(0)).cast("double")
    prec, rec = m / F.col("lp"), m / F.col("lg")
    fmean = prec * rec / (METEOR_ALPHA * prec + (1 - METEOR_ALPHA) * rec)
    pen = METEOR_GAMMA * F.pow(F.col("chunks") / m, METEOR_BETA)
    score = F.when((m == 0) | (F.col("lp") == 0) | (F.col("lg") == 0), F.lit(0.0)).otherwise((1 - pen) * fmean)
    return j.select("row_id", score.alias("meteor"))


# ---------------------------------------------------------------- ROUGE-L


def rouge_tokens(c) -> Column:
    """ROUGE tokenizer: lower, non [a-z0-9] runs -> space, split, drop empties."""
    s = F.trim(F.regexp_replace(F.lower(c if isinstance(c, Column) else F.col(c)), "[^a-z0-9]+", " "))
    return tokens(s)


def lcs_length(a, b) -> int:
    """Longest common subsequence of two sequences of hashable tokens, by bits (Hyyro 2004).

    Bit j of ``v`` is 0 where the best subsequence grows at token j of ``b``; a token of ``a`` updates all of
    ``b`` with four operations on one big integer, so a pair costs len(a) * len(b) / 64 machine words."""
    if len(a) == 0 or len(b) == 0:
        return 0
    at: dict = {}
    for j, t in enumerate(b):
        at[t] = at.get(t, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for t in a:
        u = v & at.get(t, 0)
        if u:
            v = (v + u | v - u) & full
    return len(b) - v.bit_count()


@F.pandas_udf(T.DoubleType())
def _rouge_l_udf(g: pd.Series, p: pd.Series) -> pd.Series:
    out = np.zeros(len(g), dtype=np.float64)
    if len(g) == 0:
        return pd.Series(out)
    sizes = np.array([g.map(len).to_numpy(), p.map(len).to_numpy()])
    ids, _ = pd.factorize(np.concatenate([*g, *p, np.array(["x"], object)]))  # words as numbers, once a batch
    ends = np.cumsum(sizes.ravel())
    for i in np.flatnonzero(sizes.min(axis=0)):
        lg, lp = sizes[:, i].tolist()
        gold, pred = (ids[end - n:end].tolist() for end, n in ((ends[i], lg), (ends[len(g) + i], lp)))
        lcs = lcs_length(pred, gold)
        if lcs:
            out[i] = 2 * (lcs / lp) * (lcs / lg) / (lcs / lp + lcs / lg)
    return pd.Series(out)


def rouge_l_column(g="g", p="p") -> Column:
    """M1: ROUGE-L F-measure (no stemmer). The LCS is a per-row helper on bits (Arrow batches)."""
    return _rouge_l_udf(rouge_tokens(g), rouge_tokens(p))


# ---------------------------------------------------------------- soft token match (M7)


def _unit_rows(vectors, dim: int) -> np.ndarray:
    """Unit vectors in rows; a missing (null) or zero vector is a row of zeros, whose cosines are 0."""
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        if v is not None:
            out[k] = v
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


@F.pandas_udf(T.DoubleType())
def _soft_f1_udf(vectors: pd.Series, gold: pd.Series, pred: pd.Series) -> pd.Series:
    """Per row: the vectors of the distinct tokens and how often gold and prediction have them -> soft F1."""
    out = np.zeros(len(vectors), dtype=np.float64)
    for i, (v, wg, wp) in enumerate(zip(vectors, gold, pred)):
        dim = next((len(x) for x in v if x is not None), 0)
        wg, wp = np.asarray(wg), np.asarray(wp)
        if not wg.any() or not wp.any() or not dim:
            continue
        V = _unit_rows(v, dim)
        G, P, wg, wp = V[wg > 0], V[wp > 0], wg[wg > 0], wp[wp > 0]
        best_p = np.empty(len(P))
        best_g = np.full(len(G), -np.inf)
        for s in range(0, len(P), 1024):  # blocks keep the similarity tile bounded
            sim = P[s:s + 1024] @ G.T
            best_p[s:s + 1024] = sim.max(axis=1)
            best_g = np.maximum(best_g, sim.max(axis=0))
        prec, rec = np.average(best_p, weights=wp), np.average(best_g, weights=wg)
        out[i] = 0.0 if prec + rec == 0 else 2 * prec * rec / (prec + rec)
    return pd.Series(out)


def soft_match(prep: DataFrame, vectors: DataFrame) -> DataFrame:
    """M7: P = mean over prediction tokens of the best cosine to a gold token, R the other way, F1. A token
    without a vector stays in the means, with cosine 0 to every token.

    Token occurrences are pre-aggregated to (row, token, counts of both sides) inside the row_id partitions, so a
    token that both sides have moves its vector once. They are looked up in the (token, embedding) table (AQE
    broadcasts it when its measured size is small and splits skewed tokens otherwise) and regrouped per row -- one
    row's distinct tokens, as one list of vectors -- for a blocked numpy max."""
    count = lambda s: F.count(F.when(F.col("side") == s, 1)).alias(s)
    toks = _token_rows(prep).groupBy("row_id", "word").agg(count("g"), count("p"))
    j = toks.join(vectors.select(F.col("token").alias("word"), "embedding"), "word", "left")
    # one list of (counts, vector) per row, so vectors and their counts stay aligned by construction
    per = j.groupBy("row_id").agg(F.collect_list(F.struct("g", "p", "embedding")).alias("_t"))
    out = per.select("row_id", _soft_f1_udf(F.col("_t")["embedding"], F.col("_t")["g"], F.col("_t")["p"]).alias("bertscore"))
    return prep.select("row_id").join(out, "row_id", "left").select(
        "row_id", F.coalesce("bertscore", F.lit(0.0)).alias("bertscore"))


# ---------------------------------------------------------------- registry and job


def exact_match_column(g="g", p="p") -> Column:
    """M6: 1.0 when the normalised texts are equal."""
    return (F.col(g) == F.col(p)).cast("double")


def _ngram_metric(name: str):
    def run(prep: DataFrame, **kw) -> DataFrame:
        cols = {"nltk_bleu": bleu_column, "nist": nist_column, "sacrebleu": sacrebleu_column}
        j = prep.select("row_id", "lg", "lp").join(ngram_stats(prep), "row_id", "left")
        return j.select("row_id", cols[name]("cast(lg as double)", "cast(lp as double)").alias(name))
    return run


# Metric name -> function (prepared pairs, options) -> (row_id, value), chosen by name as
# the reference's evaluator registry is; ``score_rows`` computes several at once and shares work.
REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "rougeL": lambda prep, **kw: prep.select("row_id", rouge_l_column().alias("rougeL")),
    "nltk_bleu": _ngram_metric("nltk_bleu"),
    "nist": _ngram_metric("nist"),
    "sacrebleu": _ngram_metric("sacrebleu"),
    "meteor": lambda prep, stems=None, synonyms=None, **kw: meteor(prep, stems, synonyms),
    "bertscore": lambda prep, vectors=None, **kw: soft_match(prep, vectors),
    "exact_match": lambda prep, **kw: prep.select("row_id", exact_match_column().alias("exact_match")),
}


def metric_table(prep: DataFrame, name: str, **options) -> DataFrame:
    """One metric by name: (row_id, <name>)."""
    if name not in REGISTRY:
        raise KeyError(f"unknown metric {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](prep, **options)


NGRAM_METRICS = ("nltk_bleu", "nist", "sacrebleu")


def score_rows(prep: DataFrame, metrics=METRICS, vectors: DataFrame | None = None,
               stems: DataFrame | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """(row_id, g, p, <metric>...) for the chosen metrics over prepared pairs.

    Every branch reads the same (row_id, g_tokens, p_tokens) exchange (texts and lengths are
    derived after it), so Spark reuses one shuffle of the input for all of them."""
    metrics = [m for m in METRICS if m in metrics]
    if "bertscore" in metrics and vectors is None:
        raise ValueError("bertscore needs a (token, embedding) table")
    out = prep.select("row_id", "g", "p", "lg", "lp")
    if any(m in metrics for m in NGRAM_METRICS):
        have = out.columns
        lg, lp = "cast(lg as double)", "cast(lp as double)"
        cols = {"nltk_bleu": bleu_column(lg, lp), "nist": nist_column(lg, lp),
                "sacrebleu": sacrebleu_column(lg, lp)}
        out = out.join(ngram_stats(prep), "row_id", "left").select(
            *have, *[cols[m].alias(m) for m in NGRAM_METRICS if m in metrics])
    if "meteor" in metrics:
        out = out.join(meteor(prep, stems, synonyms), "row_id", "left")
    if "bertscore" in metrics:
        out = out.join(soft_match(prep, vectors), "row_id", "left")
    # narrow columns last: a Python UDF node does not report its input partitioning, so placing
    # it after the row_id joins keeps every join free of a further exchange
    narrow = {}
    if "rougeL" in metrics:
        narrow["rougeL"] = rouge_l_column()
    if "exact_match" in metrics:
        narrow["exact_match"] = exact_match_column()
    out = out.select("*", *[c.alias(k) for k, c in narrow.items()])
    return out.select("row_id", "g", "p", *metrics)


def score_definitions(pairs: DataFrame, metrics=METRICS, vectors: DataFrame | None = None,
                      stems: DataFrame | None = None, keep=("model", "dataset")) -> DataFrame:
    """Every prediction row with its normalised gold / answer and one column per metric.

    ``pairs`` holds row_id, gloss, answer and the ``keep`` columns (answers already zipped to
    their inputs by ``line_no``, see ``sources.zip_lines``). ``vectors`` is a (token, embedding)
    table or a function building one from the prepared pairs.
    """
    prep = prepare(pairs)
    if callable(vectors):  # a table built from the prepared tokens shares their exchange
        vectors = vectors(prep)
    scored = score_rows(prep, metrics, vectors, stems)
    keep = [k for k in keep if k in pairs.columns]
    if not keep:
        return scored.withColumnRenamed("g", "gloss").withColumnRenamed("p", "answer")
    side = pairs.select("row_id", *keep)
    return side.join(scored, "row_id").select(
        "row_id", *keep, F.col("g").alias("gloss"), F.col("p").alias("answer"),
        *[m for m in METRICS if m in scored.columns])
