"""Preparation jobs E1-E7: raw dictionaries and usage corpora -> clean records and prompts.

Every function takes and returns DataFrames; positional files carry an explicit ``line_no``
(see ``lexsense.sources.text_lines``) so "zip by position" is a keyed join.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..session import written
from .prefix import running_totals


# ---------------------------------------------------------------- E1 / E2 definitions


def build_definitions(senses: DataFrame, examples: DataFrame, keys=("dataset", "split")) -> DataFrame:
    """(dataset, split, target, gloss, example) from aligned sense and example files.

    senses: keys + line_no, gloss; examples: keys + line_no, sense, context. The example file
    drives the rows; its gloss is the sense file's gloss on the same physical line (J2), so a
    dropped bad line never shifts later rows.
    """
    keys = list(keys)
    s = senses.select(*keys, "line_no", F.col("gloss"))
    j = examples.join(s, [*keys, "line_no"], "left")
    target = X.headword("sense")
    rec = j.select(*keys, target.alias("target"), "context", "gloss")
    rec = rec.select(*keys, "target",
                     X.fill_placeholder("context", "target").alias("example"),
                     X.py_strip("gloss").alias("gloss"))
    rec = rec.where(X.keep_record("target", "gloss"))
    rec = rec.select(*keys, "target", X.capitalise_first("gloss").alias("gloss"),
                     X.capitalise_first("example").alias("example"))
    return rec.dropDuplicates()


def last_by_line(df: DataFrame, key: str, order: str = "line_no") -> DataFrame:
    """Last row per ``key`` in line order (a dict built row by row): max_by on the order column."""
    others = [c for c in df.columns if c not in (key, order)]
    agg = F.max_by(F.struct(*others), F.col(order)).alias("_last")
    return df.groupBy(key).agg(agg).select(key, "_last.*")


def look_up_members(dictionary: DataFrame, members: DataFrame, split_col: str = "split") -> DataFrame:
    """(split, gloss, target, example): every member's gloss looked up in the dictionary, whose last row
    (in line order) of a gloss counts. A member whose gloss is missing fails the job, as in the reference;
    ``missing_members`` lists them beforehand. Null glosses are missing."""
    look = last_by_line(dictionary.select("line_no", "gloss", F.col("word").alias("target"), "example"), "gloss")
    found = members.select(split_col, "gloss").join(look.withColumn("_found", F.lit(True)), "gloss", "left")
    check = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("gloss not in the dictionary: "), F.coalesce("gloss", F.lit("null")))))
    return found.where(F.coalesce(check.cast("boolean"), F.lit(True))).select(split_col, "gloss", "target", "example")


def build_definitions_lookup(dictionary: DataFrame, members: DataFrame, split_col: str = "split") -> DataFrame:
    """Split members (by gloss) looked up in the complete dictionary (``look_up_members``).

    Rows are de-duplicated before capitalising, as the reference does for this source (D1)."""
    rec = look_up_members(dictionary, members, split_col).select(split_col, "target", "gloss", "example").dropDuplicates()
    return rec.select(split_col, "target", X.capitalise_first("gloss").alias("gloss"),
                      X.capitalise_first("example").alias("example"))


def missing_members(dictionary: DataFrame, members: DataFrame) -> DataFrame:
    """Members whose gloss is not in the dictionary (the reference raises on the first one)."""
    return members.join(dictionary.select("gloss"), "gloss", "left_anti")


# ---------------------------------------------------------------- E3 WiC usages


def build_wic_usages(lines: DataFrame) -> DataFrame:
    """One raw WiC line -> two quoted usages (side 1 then side 2), ``usage_no = 2 line_no + side``."""
    idx = F.split("indexes", "-")
    sides = F.array(
        F.struct(F.col("example1").alias("text"), F.element_at(idx, 1).cast("int").alias("i")),
        F.struct(F.col("example2").alias("text"), F.element_at(idx, 2).cast("int").alias("i")),
    )
    ex = lines.select("line_no", "target", F.posexplode(sides).alias("side", "u"))
    start, end = S.token_span(F.col("u.text"), F.col("u.i"))
    ex = ex.select("line_no", "side", "target", F.col("u.text").alias("text"),
                   start.alias("start"), end.alias("end"))
    return ex.select(
        (F.col("line_no") * 2 + F.col("side")).alias("usage_no"), "target",
        S.quote_span("text", "start", "end").alias("example"), "start", "end")


# ---------------------------------------------------------------- E4 / E5 usages and judgments

WIDTHS = (None, 25, 50, 75, 100)


def build_usages(uses: DataFrame, clusters: DataFrame, widths=WIDTHS, on=("target", "identifier")) -> DataFrame:
    """Usages without noise (J4), joined with their cluster (J5), target span quoted and cut
    to each context width in one pass (``suffix`` '' = whole text). Identifiers need only be unique
    within a target."""
    on = list(on)
    noise = clusters.where(F.col("cluster") == -1).select(*on)
    u = uses.join(noise, on, "left_anti").join(clusters, on, "inner")
    start, end = S.parse_span("indexes_target_token", "example")
    u = u.select("grouping", "identifier", "example", "cluster", "indexes_target_token",
                 X.strip_pos("target").alias("target"), start.alias("start"), end.alias("end"))
    # all widths in one projection: only the cut strings are multiplied, not the whole example
    cut = F.explode(F.array(*[F.struct(F.lit("" if x is None else str(x)).alias("suffix"), S.quote_window(
        "example", "start", "end", F.lit(x).cast("int")).alias("example")) for x in widths]))
    return u.select("target", "grouping", "identifier", "cluster", "indexes_target_token", cut.alias("w")).select(
        "w.suffix", "target", "grouping", "identifier", "cluster", "indexes_target_token", "w.example")


def mean_judgments(judgments: DataFrame) -> DataFrame:
    """A1: mean judgment per target and ordered id pair."""
    return judgments.groupBy("target", F.col("identifier1").cast("string").alias("identifier1"),
                             F.col("identifier2").cast("string").alias("identifier2")).agg(F.avg("judgment").alias("judgment"))


def build_judgments(judgments: DataFrame, kept_ids: DataFrame) -> DataFrame:
    """E5: mean judgment per target and ordered id pair (A1), kept only when both ids are kept usages of
    that target (J6)."""
    a = mean_judgments(judgments)
    ids = kept_ids.select("target", F.col("identifier").cast("string").alias("identifier")).distinct()
    for side in ("identifier1", "identifier2"):
        a = a.join(ids.withColumnRenamed("identifier", side), ["target", side], "left_semi")
    return a.select("target", "identifier1", "identifier2", "judgment")


# ---------------------------------------------------------------- E6 training mix and packing


def seeded_order(seed: int, *keys) -> Column:
    """A repeatable shuffle key (60 bits of the md5 of seed and row key), independent of partitioning."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *keys)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def build_training_mix(defs: DataFrame, exclude=("slang", "wiki"), split: str = "train", seed: int = 42,
                       markers=("<|", "|>")) -> DataFrame:
    """Training texts from every dataset's ``split`` except the excluded ones (partition
    pruning on ``dataset``/``split``), rendered as one dialog text each, in seeded shuffle order."""
    d = defs.where((F.col("split") == split) & ~F.col("dataset").isin(*exclude))
    d = d.select("dataset", "target", "gloss", "example",
                 S.render_turns(S.dialog("target", "example", "gloss"), *markers).alias("text"))
    return d.withColumn("shuffle_key", seeded_order(seed, "dataset", "target", "gloss", "example"))


def shuffled_positions(mix: DataFrame, key: str = "shuffle_key", out: str = "position") -> DataFrame:
    """Place of every row in the seeded order, from 0. Only the keys are ordered and counted; equal keys, which
    need equal records, get neighbouring places."""
    counts = mix.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    first = running_totals(counts, [], key, {"_before": "_n"}).select(key, "_before")
    within = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0))) - 1
    return mix.join(first, key).withColumn(out, F.col("_before") + within).drop("_before")


RANGE_BITS = 14  # leading bits of a seeded key that number its range
RANGES = 1 << RANGE_BITS


def pack_training_mix(defs: DataFrame, n: int = 512, exclude=("slang", "wiki"), split: str = "train", seed: int = 42,
                      end_mark: str = "</s>") -> DataFrame:
    """E6 in one job: the training mix (S6, D3, P12, P14) in its seeded order (W7), packed into blocks of ``n``
    tokens (W6). Blocks name the places of their first and last text.

    Only the key and the text go on from the mix. The seeded keys are spread evenly, so their first bits cut the
    order into ``RANGES`` ranges without a sample. A range's places and offsets are counted where it is sorted, and
    the ranges written once; the sums of the ranges before it, one small row each, make them places and offsets of the
    whole, and the texts move once more only, as pieces of blocks."""
    mix = build_training_mix(defs, exclude, split, seed).select("shuffle_key", "text")
    parts = int(mix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mix = mix.withColumn("_range", F.expr(f"shiftright(shuffle_key, {60 - RANGE_BITS})")).repartition(parts, "_range")
    cnt = (F.size(X.py_split("text")) + 1).cast("long").alias("cnt")
    here = Window.partitionBy("_range").orderBy("shuffle_key", "text").rowsBetween(Window.unboundedPreceding, -1)
    local = mix.select("_range", "shuffle_key", "text", cnt).select(
        "_range", "text", "cnt", F.count(F.lit(1)).over(here).alias("_place"), F.coalesce(F.sum("cnt").over(here), F.lit(0)).alias("_offset"))
    local = written(local)
    sums = local.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("cnt").alias("_cnt"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows at most
    base = sums.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_n", "_cnt")])
    placed = local.join(F.broadcast(base), "_range").select(
        (F.col("_place") + F.col("_b_n")).alias("position"), (F.col("_offset") + F.col("_b_cnt")).alias("offset"), "cnt",
        F.concat(X.py_split("text"), F.array(F.lit(end_mark))).alias("toks"))
    return _blocks(placed, n, "position")


def render_conversations(turns: DataFrame, markers=("<|", "|>")) -> DataFrame:
    """Turns table -> one text per conversation (turns in order, role marker line first)."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(ordered.alias("t")).select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: F.concat(
            F.lit(markers[0]), x["role"], F.lit(markers[1]), F.lit("\n"), x["text"])), "\n").alias("text"))


def pack(docs: DataFrame, n: int = 512, end_mark: str = "</s>", order: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Texts (whitespace tokens + end mark) laid end to end in ``order`` (unique) and cut into blocks of
    ``n`` tokens; the last block may be shorter. One row per block with its text.

    Offsets are running totals of (key, count) rows only (``running_totals``: ranges of equal row counts, however
    sparse the keys are); the tokens join late. Each text emits one slice per block it touches (rows ~
    texts + blocks, not tokens); a block then concatenates at most ``n`` tokens of slices in text order."""
    toks = docs.select(order, F.concat(X.py_split(text), F.array(F.lit(end_mark))).alias("toks"))
    sizes = running_totals(toks.select(order, F.size("toks").cast("long").alias("cnt")), [], order, {"offset": "cnt"})
    return _blocks(toks.join(sizes, order), n, order)


def _blocks(off: DataFrame, n: int, order: str) -> DataFrame:
    """The blocks of texts (order, offset, cnt, toks) laid end to end."""
    first = F.floor(F.col("offset") / n)
    last = F.floor((F.col("offset") + F.col("cnt") - 1) / n)
    ex = off.select(order, "offset", "cnt", "toks", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("offset"), F.col("block") * n)
    hi = F.least(F.col("offset") + F.col("cnt"), (F.col("block") + 1) * n)
    # a piece travels as text: an array of tokens takes two to three times its room
    pieces = ex.select("block", order, (hi - lo).cast("long").alias("n"), F.array_join(
        F.slice("toks", (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int")), " ").alias("piece"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(order, "piece"))), lambda x: x["piece"])
    return pieces.groupBy("block").agg(
        F.sum("n").alias("n_tokens"),
        F.min(order).alias("first_doc"), F.max(order).alias("last_doc"),
        F.array_join(ordered, " ").alias("text"))


# ---------------------------------------------------------------- E7 generation input and answers


REPEATS = 1 << 20  # bytes of texts whose repeats a file's writer keeps as one (parquet: what a column's dictionary may hold)
MAX_WRITERS = 1 << 17  # tasks of one stage that a driver keeps track of


def _by_size(defs: DataFrame, max_len: int) -> DataFrame:
    """The texts dealt to tasks of ``REPEATS`` bytes, the longest first in each.

    Every window's row holds its whole text, so the rows of a text grow with the square of its length. Parquet writes
    equal values of a column once while the different ones of a file fit its dictionary, which those of a large task
    don't. Texts too short for a second window count little. Dealt by hash, a task gets total / n bytes with a deviation
    of sqrt(squares / n); n is such that the bytes and twice the deviation make ``REPEATS``."""
    size = F.least(F.octet_length(F.concat_ws("", "target", "example")) + 256, F.lit(REPEATS))  # with the words of a prompt
    weight = F.when(F.length("example") > max_len, size).otherwise(size / 64)
    total, squares = (x or 0 for x in defs.agg(F.sum(weight), F.sum(weight * weight)).first())
    n = math.ceil(((math.sqrt(squares + total * REPEATS) + math.sqrt(squares)) / REPEATS) ** 2)
    n = min(max(n, 1), MAX_WRITERS)
    return defs.repartition(n, "line_no", "example").sortWithinPartitions(F.octet_length("example").desc())


def build_generation_input(defs: DataFrame, tokenise, batch: int = 32, max_len: int = 100, pad: int = 0) -> DataFrame:
    """Prompt dialog (generation prompt, no gloss) rendered, seq2seq question, fixed-length
    token ids and mask, and batch number in file order (W5). ``tokenise`` maps a text column to its ids; a text of
    more than ``max_len`` ids gives several rows, numbered by ``window``, each with the next ids."""
    ids, mask = S.fixed_length("_ids", max_len, pad)
    # the ids of a text are found, and its prompts rendered, once: windows are cut from a column, not from an expression
    texts = _by_size(defs.select("line_no", "target", "example"), max_len).select("line_no", "target", "example", tokenise("example").alias("_all"),
                        S.render_turns(S.dialog("target", "example")).alias("prompt"), S.question("target", "example").alias("question"))
    rows = texts.select("line_no", "target", "example", "prompt", "question",
                        F.posexplode(S.windows("_all", max_len)).alias("window", "_ids"))
    return rows.select(
        "line_no", F.col("window").cast("long").alias("window"), "target", "example", "prompt", "question",
        ids.alias("input_ids"), mask.alias("attention_mask"),
        F.floor(F.col("line_no") / batch).alias("batch"))


def clean_answers(df: DataFrame, family: str, col: str = "answer") -> DataFrame:
    """P15 (family 'last_line') or P16 (family 'after_inst') answer clean-up."""
    f = X.clean_answer_last_line if family == "last_line" else X.clean_answer_after_inst
    return df.withColumn(col, f(col))
