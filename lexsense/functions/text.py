"""Column expressions for the text steps (P-steps, F-filters).

All are built-in Spark functions, so they stay inside whole-stage codegen.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set in Java regex: Unicode White_Space (the (?U) flag) plus \x1C-\x1F.
_WS = r"[\s\x{1C}-\x{1F}]"
# string.punctuation (fixed values: the 32 ASCII punctuation characters).
_PUNCT_CHARS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c) -> Column:
    """Python ``" ".join(s.split())``: runs of any whitespace -> one space, ends stripped."""
    return F.trim(F.regexp_replace(_c(c), f"(?U){_WS}+", " "))


# Every character Python's str.isspace() accepts (derived by rule, not listed by hand).
_PY_SPACES = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def py_strip(c) -> Column:
    """Python ``str.strip()``: all whitespace off both ends (Spark ``trim`` only drops spaces).
    A character-set trim, so long texts are not scanned by a regex."""
    return F.btrim(_c(c), F.lit(_PY_SPACES))


def normalise(c) -> Column:
    """Lower case, delete ASCII punctuation, collapse whitespace."""
    return collapse_ws(F.translate(F.lower(_c(c)), _PUNCT_CHARS, ""))


def tokens(c) -> Column:
    """Whitespace tokens of a normalised column; '' gives an empty array (Python ``split()``)."""
    c = _c(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def py_split(c) -> Column:
    """Python ``str.split()`` on raw text: any whitespace, no empty tokens (one regex pass)."""
    return F.filter(F.split(_c(c), f"(?U){_WS}+"), lambda t: t != "")


def capitalise_first(c) -> Column:
    """Upper-case the first character only, rest untouched."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def headword(c) -> Column:
    """Sense key ``word%key`` -> text before the first ``%``."""
    return F.substring_index(_c(c), "%", 1)


def fill_placeholder(context, target, mark: str = "<TRG>") -> Column:
    """Every placeholder replaced by the target, then stripped."""
    return py_strip(F.replace(_c(context), F.lit(mark), _c(target)))


def is_numeric(c) -> Column:
    """Python ``str.isnumeric()`` on a non-empty string (Unicode N category)."""
    return _c(c).rlike(r"^\p{N}+$")


def keep_record(target, gloss) -> Column:
    """drop all-numeric or short (< 5) glosses and empty or numeric targets (after strip)."""
    g = py_strip(_c(gloss))
    t = _c(target)
    return (~is_numeric(g)) & (F.length(g) >= 5) & (t != "") & (~is_numeric(t))


def answered(gloss) -> Column:
    """the model answered (non-empty, not a refusal that repeats the prompt)."""
    g = _c(gloss)
    return (g != "") & (~g.startswith("Please provide"))


def strip_pos(c) -> Column:
    """Drop ``_nn`` then ``_vb`` anywhere in the string."""
    return F.replace(F.replace(_c(c), F.lit("_nn"), F.lit("")), F.lit("_vb"), F.lit(""))


def drop_short_tokens(c, k) -> Column:
    """P10: keep whitespace tokens longer than ``k`` characters, joined by one space."""
    kk = k if isinstance(k, Column) else F.lit(k)
    return F.array_join(F.filter(py_split(c), lambda t: F.length(t) > kk), " ")


def drop_punct_tokens(c, punct: str = ";.,()") -> Column:
    """Drop whitespace tokens that are a substring of ``punct`` (Python ``t in ';.,()'``)."""
    return F.array_join(F.filter(py_split(c), lambda t: F.instr(F.lit(punct), t) == 0), " ")


def label_true(c) -> Column:
    """Gold line ``T`` (after strip) -> 1 else 0."""
    return (py_strip(_c(c)) == "T").cast("int")


def py_strip_chars(c, chars: str) -> Column:
    """Python ``str.strip(chars)``."""
    return F.btrim(_c(c), F.lit(chars))


def clean_answer_last_line(c) -> Column:
    """Last line after splitting on newline, ``strip(" .,;:")``, newlines -> space."""
    last = F.element_at(F.split(_c(c), "\n"), -1)
    return F.replace(py_strip_chars(last, " .,;:"), F.lit("\n"), F.lit(" "))


def clean_answer_after_inst(c, mark: str = "[/INST]") -> Column:
    """Part after the last ``[/INST]``, stripped; '' if it holds ``SYS>>``; newlines -> space."""
    parts = F.split(_c(c), F.lit(mark.replace("[", r"\[").replace("]", r"\]").replace("/", "/")))
    tail = py_strip_chars(F.element_at(parts, -1), " .,;:")
    return F.replace(F.when(tail.contains("SYS>>"), F.lit("")).otherwise(tail), F.lit("\n"), F.lit(" "))
