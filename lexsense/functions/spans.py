"""Character-span expressions (P5-P8) and prompt builders."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, py_split

# The prompt texts of the definition-generation task.
SYSTEM_MESSAGE = "You are a lexicographer familiar with providing concise definitions of word meanings."
USER_TEMPLATE = 'Please provide a concise definition for the meaning of the word "{}" in the following sentence: {}'
QUESTION_TEMPLATE = "{example} What is the definition of {target}?"

_BIG = 2147483647


def parse_span(indexes, example) -> tuple[Column, Column]:
    """P5: "s:e" -> (start, end); on any failure start = first part, end = length(example)."""
    parts = F.split(_c(indexes), ":")
    s_try = F.try_element_at(parts, F.lit(1)).try_cast("int")
    e_try = F.try_element_at(parts, F.lit(2)).try_cast("int")
    ok = (F.size(parts) == 2) & s_try.isNotNull() & e_try.isNotNull()
    start = F.when(ok, s_try).otherwise(F.element_at(parts, 1).cast("int")).cast("long")
    end = F.when(ok, e_try).otherwise(F.length(_c(example))).cast("long")
    return start, end


def quote_span(text, start, end) -> Column:
    """Insert '"' before 0-based ``start`` and before 0-based ``end`` (Python slicing)."""
    t = _c(text)
    s = F.least(F.greatest(_c(start), F.lit(0)), F.length(t))
    e = F.least(F.greatest(_c(end), F.lit(0)), F.length(t))
    mid = F.when(e > s, F.substring(t, s + 1, e - s)).otherwise(F.lit(""))
    return F.concat(F.substring(t, 1, s), F.lit('"'), mid, F.lit('"'), F.substring(t, e + 1, _BIG))


def quote_window(text, start, end, width) -> Column:
    """Quoted text cut to ``quoted[max(0, s-L) : e+L]``; null width keeps the whole text."""
    q = quote_span(text, start, end)
    w = _c(width)
    lo = F.greatest(_c(start) - w, F.lit(0))
    hi = _c(end) + w
    cut = F.when(hi > lo, F.substring(q, lo + 1, hi - lo)).otherwise(F.lit(""))
    return F.when(w.isNull(), q).otherwise(cut)


def token_span(text, index) -> tuple[Column, Column]:
    """Whitespace token ``index`` of ``text`` -> (start, end) measured on the single-space join. An
    index past the last token gives an empty span at the end."""
    toks = py_split(text)
    i = _c(index)
    before = (F.length(F.array_join(F.slice(toks, 1, i), " ")) + F.when(i > 0, 1).otherwise(0)).cast("long")
    return before, before + F.coalesce(F.length(F.try_element_at(toks, i + 1)), F.lit(0)).cast("long")


def dialog(target, example, gloss=None) -> Column:
    """System + user turns (+ assistant gloss when training) as array<struct<role, content>>."""
    sys_turn = F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content"))
    user = F.struct(F.lit("user").alias("role"),
                    F.format_string(USER_TEMPLATE.replace("{}", "%s"), _c(target), _c(example)).alias("content"))
    turns = [sys_turn, user]
    if gloss is not None:
        turns.append(F.struct(F.lit("assistant").alias("role"), _c(gloss).alias("content")))
    return F.array(*turns)


def question(target, example) -> Column:
    """Plain seq2seq prompt."""
    return F.concat(_c(example), F.lit(" What is the definition of "), _c(target), F.lit("?"))


def render_turns(turns, open_mark: str = "<|", close_mark: str = "|>") -> Column:
    """Render array<struct<role, content>> to one text: a role marker line before each turn."""
    return F.array_join(F.transform(_c(turns), lambda t: F.concat(
        F.lit(open_mark), t["role"], F.lit(close_mark), F.lit("\n"), t["content"])), "\n")


def windows(ids, n: int) -> Column:
    """Consecutive windows of ``n`` ids, one (empty) window for no ids."""
    size = F.size(_c(ids))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(size / n).cast("int") - 1, F.lit(0)))
    return F.transform(starts, lambda k: F.slice(_c(ids), k * n + 1, F.lit(n)))


def fixed_length(ids, n: int, pad: int = 0) -> tuple[Column, Column]:
    """Truncate to ``n``, left-pad with ``pad``; returns (ids, attention mask)."""
    cut = F.slice(_c(ids), 1, n)
    k = F.size(cut)
    padded = F.concat(F.array_repeat(F.lit(pad).cast("long"), F.lit(n) - k), cut.cast("array<long>"))
    mask = F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(n) - k), F.array_repeat(F.lit(1).cast("long"), k))
    return padded, mask
