"""Language identification by cross-parsing entropy (operator 7).

Each learned language has a suffix automaton of labelled text. A text is parsed into phrases, each
the longest match that the automaton knows from there on (the parse starts anew at every word, so
that all words of a chunk are parsed in lockstep by numpy). The fewer phrases a letter takes, the
lower the text's cross entropy under that language; the language with the fewest wins.

Defined results: null text, or text without a letter: ``und`` with score 0; equal phrase counts:
the language with more labelled documents; no labelled row at all: ``und`` for all. Rows are scored one by
one, so repeated rows give repeated results. Extra columns are ignored.
"""
from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexsense.llm import flat

RUN = 48  # letters after which a longer run without a break is parsed anew


def suffix_automaton(text: list[int], width: int) -> np.ndarray:
    """Transition table (states x width) of the automaton of all substrings of ``text``.

    A missing transition from a state holds ``~t`` with t the root's transition: where the next
    phrase stands after that symbol.
    """
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in text:
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                link[q] = link[cur] = clone
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
        last = cur
    root = np.zeros(width, np.int32)
    for c, q in step[0].items():
        root[c] = q
    table = np.tile(~root, (len(step), 1))
    for s, to in enumerate(step):
        for c, q in to.items():
            table[s, c] = q
    return table


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Model:
    """Automata of all learned languages over one alphabet. Classes: 0 no letter, 1 unknown letter."""

    def __init__(self, texts: dict[str, str], letters: int):
        self.languages = list(texts)  # in order of preference at equal counts
        runs = {k: "".join(c if c.isalpha() else " " for c in texts[k].lower()) for k in self.languages}
        runs = {k: " " + " ".join(v.split())[:letters] for k, v in runs.items()}
        self.alphabet = sorted({c for v in runs.values() for c in v if c != " "})
        code = {c: i + 2 for i, c in enumerate(self.alphabet)} | {" ": 0}
        self.width = len(self.alphabet) + 2
        self.tables = [suffix_automaton([code[c] for c in runs[k]], self.width).ravel() for k in self.languages]

    def classes(self) -> np.ndarray:
        lut = _letters().astype(np.uint16)
        lut[[ord(c) for c in self.alphabet]] = np.arange(2, self.width)
        return lut

    def phrases(self, texts: list[str], lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text under each language, and its letters."""
        texts = [t.lower() for t in texts]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        text = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = lut[text]
        solid = cls > 0
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        off = np.concatenate(([0], np.cumsum(size)))
        inner = off[off < len(text)]
        start[inner] = solid[inner]
        start = np.flatnonzero(start)
        run_id = np.cumsum(np.bincount(start, minlength=len(cls)))[solid] - 1 if len(start) else start
        run = np.bincount(run_id, minlength=len(start)) if len(start) else start
        if len(run) and run.max() > RUN:
            parts = -(-run // RUN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            run = np.minimum(np.repeat(run, parts) - nth * RUN, RUN)
            start = np.repeat(start, parts) + nth * RUN
        row = np.searchsorted(off, start, "right") - 1
        order = np.argsort(-run.astype(np.int16), kind="stable")
        start, run, row = start[order], run[order], row[order]
        upto = np.searchsorted(-run, -np.arange(1, RUN + 1), "right")
        out = np.zeros((len(texts), len(self.languages)))
        for k, table in enumerate(self.tables):
            first = table[0]  # the state after a break
            state = np.full(len(start), max(first, 0), np.int32)
            cut = np.ones(len(start), np.int32)
            for t, m in enumerate(upto):
                if not m:
                    break
                to = table[state[:m].astype(np.int64) * self.width + cls[start[:m] + t]]
                miss = to >> 31
                state[:m] = to ^ miss
                cut[:m] -= miss
            out[:, k] = np.bincount(row, weights=cut, minlength=len(texts))
        return out, np.bincount(row, weights=run, minlength=len(texts))

    def judge(self, data: np.ndarray, off: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, ...]:
        """Language, score, letters, and phrases per letter of each row."""
        raw = data.tobytes()
        names = np.array([*self.languages, "und"], object)
        count, n = self.phrases([raw[a:b].decode() for a, b in zip(off[:-1], off[1:], strict=True)], lut)
        if not self.languages:
            count = np.zeros((len(off) - 1, 1))
        win = count.argmin(1)
        low = count[np.arange(len(win)), win]
        second = np.partition(count, 1, axis=1)[:, 1] if count.shape[1] > 1 else np.maximum(n, low)
        known = (n > 0) & bool(self.languages)
        return (np.where(known, names[np.where(known, win, -1)], "und"),
                np.where(known, 1 - low / np.maximum(second, 1), 0.0), n.astype(np.int64),
                np.where(known, low / np.maximum(n, 1), 0.0))


def even(texts: list[str], letters: int) -> str:
    """``letters`` letters and breaks taken evenly from all texts: what short ones leave goes to the others."""
    runs = [" ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) for t in texts]
    out, left = {}, letters
    for nth, i in enumerate(sorted(range(len(runs)), key=lambda i: len(runs[i]))):
        out[i] = runs[i][:max(left // (len(runs) - nth) - 1, 0)]
        left -= len(out[i]) + 1
    return " ".join(out[i] for i in range(len(runs)) if out[i])


def train(documents: DataFrame, rows: int = 64, letters: int = 30_000, row_chars: int = 4_000,
          total: int = 64 * 30_000) -> Model:
    """Automata of every ``lang`` outside the held-out quarter, from a bounded sample: ``rows`` different
    texts of each, chosen by a hash (all, if there are fewer), of each text the first ``row_chars``
    characters at most, and ``letters`` of each language taken evenly from its texts. With more than
    ``total`` / ``letters`` languages the letters of each become fewer, but every language is learned."""
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                            & ~flat.held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64(F.lit(7), "text").alias("h"))
    counts = known.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("h").alias("texts")).collect()
    counts.sort(key=lambda r: (-r["count"], r["lang"]))  # one row a language
    if not counts:
        return Model({}, letters)
    letters = max(rows, min(letters, total // len(counts)))
    u = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = documents.sparkSession.createDataFrame([(r["lang"], r["texts"]) for r in counts], "lang string, texts long")
    nth = F.row_number().over(W.partitionBy("lang").orderBy("u", "h"))  # about 1.5 * rows of each language
    sample = (known.join(F.broadcast(shares), "lang").where(u * F.col("texts") < 1.5 * rows)
              .groupBy("lang", "h").agg(F.first(F.substring("text", 1, min(row_chars, 2 * letters))).alias("text"))
              .withColumn("u", u).withColumn("nth", nth).where(F.col("nth") <= rows))
    texts: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["nth"])):
        texts[r["lang"]].append(r["text"])
    return Model({k: even(v, letters) for k, v in texts.items() if v}, letters)


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows (doc_id, lang_pred, score, n_letters, phrases per letter of the winner) of all documents.

    ``score`` is 1 minus the ratio of the winner's phrases to the runner-up's.
    """
    spark = documents.sparkSession
    flat.prepare(spark)
    model = model or train(documents)
    shared = spark.sparkContext.broadcast(model)  # bounded by train()

    def parse(batches):
        lut = shared.value.classes()
        for batch in batches:
            data, off = flat.flat(batch.column(1))
            parts = [shared.value.judge(data[off[a]:off[b]], off[a:b + 1] - off[a], lut) for a, b in flat.chunks(off, flat.CHUNK // 2)]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.float64())
            columns = [pa.array(np.concatenate(x), k) for x, k in zip(zip(*parts, strict=True), kinds, strict=True)] \
                if parts else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "n_letters", "rate"])

    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(parse, "doc_id long, lang_pred string, score double, n_letters long, rate double"))


def known_language(documents: DataFrame, least: float = 0.02) -> DataFrame:
    """The rows, all columns, whose text has a language: not ``und``, and a score of ``least`` or more."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents))

    def good():
        lut = shared.value.classes()

        def judge(data, off):
            name, score, _, _ = shared.value.judge(data, off, lut)
            return (name != "und") & (score >= least)
        return judge

    return flat.passing(documents, good)


def op7_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs).select("doc_id", flat.held_out(F.col("doc_id")).alias("held_out"),
                                 "lang_pred", "score", "n_letters", "rate")
