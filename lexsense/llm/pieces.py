"""Subword encoding by forward filtering and backward sampling over the piece lattice (operator 6).

A text is cut only between two bytes that no piece of the model holds side by side: before a space behind a
visible character, and inside stretches of more than ``WHOLE`` bytes wherever that holds. No piece can lie
across such a cut, so the lattice of the text is the product of those of its stretches, however long. It
holds all pieces, weighted by a Zipf law over the vocabulary's order. Forward filtering sums the
weights of all segmentations up to each byte, backward sampling draws one of them: exactly in proportion
to the product of its pieces' weights. Draws come from a hash of seed, row key and place, so a row's
segmentation is the same in every run, partition and order. Bytes are edges, too (byte fallback), hence
every text can be encoded, and decoding gives back its bytes.

Defined results: null and empty texts have no pieces; rows are encoded one by one, those with equal key
and text get equal pieces; a null key counts as 0. Extra columns are ignored.
"""
from __future__ import annotations

import functools
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsense.llm import flat

WHOLE = 16  # stretches up to it are cut before spaces only
SHORT = 32  # bytes up to which stretches are filtered side by side; longer ones one by one, in logarithms
BLOCK = 1 << 15  # places of a long stretch at a time
SLOTS = 1 << 21
NONE, PART = -1, -2  # not in the table; the end of a piece, but no piece


class Vocabulary:
    """Pieces as bytes (the space mark is a space), their weights, and a hash table of them."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.piece = [b""] * n
        rank = 0
        weight = np.zeros(n)
        table: dict[bytes, int] = {}
        self.byte = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.piece[i] = bytes([value])
                self.byte[value] = i
                weight[i] = 0.1 / n
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                rank += 1
                self.piece[i] = model.id_to_piece(i).replace("▁", " ").encode()
                weight[i] = 1 / (rank + 10)
                table.setdefault(self.piece[i], i)
        self.weight = weight / weight.sum()
        self.length = np.array([len(p) for p in self.piece])
        self.bytes = np.frombuffer(b"".join(self.piece), np.uint8)
        self.start = np.cumsum(self.length) - self.length
        self.longest = max(map(len, table), default=1)
        entries = {p[k:]: PART for p in table for k in range(1, len(p))} | table  # ends of pieces, too
        store = np.frombuffer(b"".join(entries), np.uint8)
        end = np.cumsum([len(p) for p in entries])
        key = flat.span_hash(flat.prefix_hash(store), np.r_[0, end[:-1]], end)
        ids = np.fromiter(entries.values(), np.int64, len(entries))
        self.key, self.id = np.zeros(SLOTS, np.uint64), np.full(SLOTS, NONE, np.int32)
        self.joint = np.zeros((256, 256), bool)  # whether a piece holds the two bytes side by side
        for p in table:
            self.joint[list(p[:-1]), list(p[1:])] = True
        self.probes = 1
        for k, i in zip(key.tolist(), ids.tolist(), strict=True):
            at, step = k % SLOTS, 1
            while self.id[at] != NONE:
                at, step = (at + 1) % SLOTS, step + 1
            self.key[at], self.id[at], self.probes = k, i, max(self.probes, step)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece of each hash, PART if it is only the end of pieces, or NONE."""
        at = (key % np.uint64(SLOTS)).astype(np.int64)
        out = np.where(self.key[at] == key, self.id[at], NONE)
        for step in range(1, self.probes):
            rest = np.flatnonzero((out == NONE) & (self.id[(at + step - 1) % SLOTS] != NONE))
            if not len(rest):
                break
            slot = (at[rest] + step) % SLOTS
            out[rest] = np.where(self.key[slot] == key[rest], self.id[slot], NONE)
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.bytes[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def edges(self, data: np.ndarray, prefix: np.ndarray, begin: int, n: int, weight: np.ndarray) -> tuple[np.ndarray, ...]:
        """The lattice of one stretch: for each end the range of its edges; their lengths, pieces and shares
        of the weight of all segmentations up to their end, as running sums."""
        end, size, piece = [], [], []
        live = np.arange(1, n + 1)  # places before which the last m bytes may still end a piece
        for m in range(1, min(n, self.longest) + 1):
            live = live[live >= m]
            if not len(live):
                break
            start = begin + live - m
            p = self.find(flat.span_hash(prefix, start, start + m))
            more = p != NONE
            if m == 1:
                p = np.where(p < 0, self.byte[data[start]], p)
            on = np.flatnonzero(p >= 0)
            end.append(live[on])
            size.append(np.full(len(on), m, np.int32))
            piece.append(p[on].astype(np.int32))
            live = live[more]
        end = np.concatenate(end)
        order = np.argsort(end, kind="stable")
        end, size, piece = end[order], np.concatenate(size)[order], np.concatenate(piece)[order]
        at = np.searchsorted(end, np.arange(n + 2))
        share, total = np.ones(len(end)), [0.0]
        for a in range(1, n + 1, BLOCK):  # forward filtering
            b = min(a + BLOCK, n + 1)
            m, w = size[at[a]:at[b]].tolist(), np.log(weight[piece[at[a]:at[b]]]).tolist()
            bound = (at[a:b + 1] - at[a]).tolist()
            out: list[float] = []
            for t, i, j in zip(range(a, b), bound[:-1], bound[1:], strict=True):
                if j - i == 1:
                    total.append(total[t - m[i]] + w[i])
                    out.append(1.0)
                    continue
                value = [total[t - m[k]] + w[k] for k in range(i, j)]
                top = max(value)
                run = list(itertools.accumulate([math.exp(x - top) for x in value]))
                total.append(top + math.log(run[-1]))
                out.extend([x / run[-1] for x in run])
            share[at[a]:at[b]] = out
        return at, size, piece, share

    def walk(self, edges: tuple[np.ndarray, ...], n: int, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling from the end of a stretch: starts and pieces."""
        at, size, piece, share = edges
        where, got, t = [], [], n
        while t:
            i, j = at[t], at[t + 1]
            k = min(i + int(np.searchsorted(share[i:j], draw[t], "right")), j - 1)
            t -= int(size[k])
            where.append(t)
            got.append(piece[k])
        return np.array(where, np.int64), np.array(got, np.int64)

    def encode(self, data: np.ndarray, off: np.ndarray, keys: np.ndarray, power: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Sampled pieces of all rows in a row, and the offsets of the rows."""
        rows = len(off) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
        free = np.r_[True, ~self.joint[data[:-1], data[1:]]]
        free[off[off < len(data)]] = True
        cut = free & (data == 0x20)
        cut[off[off < len(data)]] = True
        size = np.diff(np.append(np.flatnonzero(cut), len(data)))
        start = np.flatnonzero(cut | (free & np.repeat(size > WHOLE, size)))
        size = np.diff(np.append(start, len(data)))
        row = np.searchsorted(off, start, "right") - 1
        prefix = flat.prefix_hash(data)
        _, first, back = np.unique(flat.span_hash(prefix, start, start + size), return_index=True, return_inverse=True)
        seed = flat.mix(keys.astype(np.int64).view(np.uint64) * np.uint64(flat.BASE) + np.uint64(1))
        weight = self.weight ** power
        out_at, out_id = [], []
        low = 0
        # a stretch's least product of weights stays a normal number
        short = int(min(SHORT, 290 // -np.log10(min(weight[weight > 0].min(), 0.1))))
        for high in sorted({min(8, short), min(16, short), short}):
            unique = np.flatnonzero((size[first] > low) & (size[first] <= high))
            low = high
            for u in np.array_split(unique, len(unique) // 4096 + 1):
                if not len(u):
                    continue
                begin, n = start[first[u]], size[first[u]]
                width = min(self.longest, high)
                total = np.zeros((len(u), high + 1))
                total[:, 0] = 1
                reach = np.zeros((len(u), high + 1, width))  # running sums over piece lengths
                piece = np.full((len(u), high + 1, width), -1, np.int32)
                for t in range(1, high + 1):  # forward filtering
                    on = np.flatnonzero(n >= t)  # while the last m bytes end some piece
                    for m in range(1, min(t, width) + 1):
                        p = self.find(flat.span_hash(prefix, begin[on] + t - m, begin[on] + t))
                        more = p != NONE
                        if m == 1:
                            p = np.where(p < 0, self.byte[data[begin[on] + t - 1]], p)
                        hit = np.flatnonzero(p >= 0)
                        at, p = on[hit], p[hit]
                        piece[at, t, m - 1] = p
                        total[at, t] += total[at, t - m] * weight[p]
                        reach[on, t, m - 1:] = total[on, t][:, None]
                        on = on[more]
                        if not len(on):
                            break
                own = np.full(len(first), -1)
                own[u] = np.arange(len(u))
                which = np.flatnonzero(own[back] >= 0)  # backward sampling, for each place in the texts
                who, t, base = own[back[which]], size[which].copy(), start[which]
                source = seed[row[which]]
                local = (base - off[row[which]]).astype(np.uint64)
                while len(who):
                    h = flat.mix(source + flat.mix(local + t.astype(np.uint64)))
                    draw = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53) * total[who, t]
                    m = np.minimum((reach[who, t] <= draw[:, None]).sum(1), width - 1) + 1
                    t = t - m
                    out_at.append(base + t)
                    out_id.append(piece[who, t + m, m - 1])
                    more = t > 0
                    who, t, base, source, local = who[more], t[more], base[more], source[more], local[more]
        own = np.full(len(first), -1)
        own[size[first] > short] = 0
        which = np.flatnonzero(own[back] >= 0)
        which = which[np.argsort(back[which], kind="stable")]
        known = -1
        for w in which.tolist():
            base, n = int(start[w]), int(size[w])
            if back[w] != known:
                known = back[w]
                edges = self.edges(data, prefix, base, n, weight)
            h = flat.mix(seed[row[w]] + flat.mix(np.uint64(base - off[row[w]]) + np.arange(n + 1, dtype=np.uint64)))
            where, got = self.walk(edges, n, (h >> np.uint64(11)).astype(np.float64) / float(1 << 53))
            out_at.append(base + where)
            out_id.append(got)
        at, ids = np.concatenate(out_at), np.concatenate(out_id).astype(np.int64)
        by_place = np.full(len(data), -1, np.int64)
        by_place[at] = ids
        place = np.flatnonzero(by_place >= 0)
        return by_place[place], np.searchsorted(place, off)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(documents: DataFrame, path: str | None = None, key: str = "doc_id", seed: int = 6, power: float = 0.3,
           ids: bool = True) -> DataFrame:
    """(key, n_bytes, n_pieces, ids_crc32, lossless and, if asked for, ids) of every row. ``lossless``: the
    decoded bytes are those of the text. ``power`` sharpens (above 1) or flattens the weights."""
    import public_tokenizers
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    flat.prepare(documents.sparkSession)

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            data, off = flat.flat(batch.column(1))
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False) + seed * 1_000_003
            size, count, crc, same, lists = [], [], [], [], []
            for a, b in flat.chunks(off, flat.CHUNK // 2):
                text, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
                got, at = v.encode(text, o, keys[a:b], power)
                back = v.decode(got)
                where = np.concatenate(([0], np.cumsum(v.length[got])))[at]
                for i in range(b - a):
                    own = got[at[i]:at[i + 1]].astype("<u4")
                    size.append(int(o[i + 1] - o[i]))
                    count.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
                    same.append(bool(np.array_equal(back[where[i]:where[i + 1]], text[o[i]:o[i + 1]])))
                    if ids:
                        lists.append(own.astype(np.int32))
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64()),
                       pa.array(same, pa.bool_())] + ([pa.array(lists, pa.list_(pa.int32()))] if ids else [])
            yield pa.RecordBatch.from_arrays(columns, [key, "n_bytes", "n_pieces", "ids_crc32", "lossless"] + ["ids"] * ids)

    schema = f"{key} long, n_bytes long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * ids
    return documents.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text) from the column ``ids`` of ``encode``; null ids give null."""
    import public_tokenizers
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            text = [None if x is None else v.decode(np.asarray(x, np.int64)).tobytes().decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} long, text string")


def op6_sentencepiece(spark, sf_dir):
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
