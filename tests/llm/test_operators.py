"""Training-data operators against brute force, and their defined results for odd rows."""
from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexsense.llm import language, lines, neardup, packing, pieces, quality, substrings, suffixes, toxicity, vectors
from lexsense.llm.graph import components
from lexsense.session import ensure_checkpoint_dir, ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, ranges int, component string"
GAP = re.compile(r"[ \t-\r]+")


@pytest.fixture(scope="module")
def session(spark):
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def frame(session, texts, schema=SCHEMA):
    """(id, text) rows with columns whose names clash with inner ones."""
    return session.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "c") for i, t in texts], schema)


@pytest.fixture(scope="module")
def corpus():
    """Shared passages, near copies, copies, odd rows and repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 6))) for _ in range(300)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = make(70), make(200)
    out = [(i, " ".join(make(rng.randint(1, 150)))) for i in range(40)]
    out += [(100 + i, " ".join(make(30) + passage[i:] + make(20))) for i in range(8)]
    for i in range(12):
        edited = list(base)
        for _ in range(i // 2):
            edited[rng.randrange(200)] = rng.choice(vocabulary)
        out.append((200 + i, "  ".join(edited)))
    out += [(300 + i, " ".join(base)) for i in range(5)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "a"), (404, "a b"), (405, "A  B"), (406, "x" * 500), (407, "x" * 700)]
    out += [(408, "ä b c ퟿"), (409, "\n".join(["one line of it"] * 9)), (1, out[1][1]), (500, "a " * 120)]
    rng.shuffle(out)
    return out


def windows_brute(rows, letters, length):
    """{(id, text): places removed}: windows that also start under a smaller id."""
    first: dict = {}
    for i, t in rows:
        x = letters(t or "")
        for k in range(len(x) - length + 1):
            w = tuple(x[k:k + length])
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in rows:
        x = letters(t or "")
        gone = set()
        for k in range(len(x) - length + 1):
            if first[tuple(x[k:k + length])] < i:
                gone.update(range(k, k + length))
        out[i, t] = (x, gone)
    return out


def words(text):
    return [w for w in GAP.split(text) if w]


def test_substring_dedup(session, corpus):
    want = windows_brute(corpus, words, 50)
    got = substrings.deduplicate(frame(session, corpus), text=False).collect()
    assert len(got) == len(corpus)
    expect = sorted((i, len(x), len(g), hashlib.sha256(" ".join(w for k, w in enumerate(x) if k not in g).encode()).hexdigest())
                    for (i, t), (x, g) in ((k, want[k]) for k in corpus))
    assert sorted(map(tuple, got)) == expect
    assert any(r["n_removed"] for r in got)


def test_suffix_array_dedup(session, corpus):
    want = windows_brute(corpus, lambda t: list(t.encode()), 50)
    got = suffixes.deduplicate(frame(session, corpus)).collect()
    expect = []
    for k in corpus:
        x, g = want[k]
        spans = sum(1 for p in g if p - 1 not in g)
        expect.append((k[0], len(x), len(g), spans, hashlib.sha256(bytes(b for p, b in enumerate(x) if p not in g)).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(expect)
    assert sum(r["n_removed"] for r in got) > 3000


def test_difference_cover_alone(session, corpus):
    """Every window open from the start: the sorted groups find all repeated windows by themselves."""
    from lexsense.llm import repeats as R
    rows = [(i, t) for i, t in corpus if i >= 95]
    docs = R.keyed(frame(session, rows))
    open_ = docs.select("doc_id", "t", "text", F.array(F.struct(F.lit(0).alias("a"), (F.octet_length("text") - 50).alias("b"), F.lit(0).alias("o"))).alias("paths"))
    got = {}
    for r in suffixes.sorted_groups(open_.where(F.octet_length("text") >= 50)).select("doc_id", "a").distinct().collect():
        got.setdefault(r["doc_id"], set()).update(range(r["a"], r["a"] + 50))
    for (i, t), (_, g) in windows_brute(rows, lambda t: list(t.encode()), 50).items():
        assert got.get(i, set()) == g


def test_sorted_groups_shuffle_once(session):
    """No table of samples or names beside the lists, and only the places that an open suffix needs: two rows each."""
    from lexsense.llm import repeats as R
    rng = random.Random(5)
    core = "".join(rng.choice("abcdefg ") for _ in range(400))
    rows = [(i, f"{i}é{core[i * 7:]}") for i in range(6)] + [(3, "again " + core)]
    docs = R.keyed(frame(session, rows))
    paths = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(0).alias("o")) for a, b in ((3, 6), (5, 9), (40, 43), (100, 100))))
    open_ = docs.select("doc_id", "t", "text", paths.alias("paths"))
    schema = "doc_id long, t int, a int, " + ", ".join(f"{c} long" for c in suffixes.LETTERS) + ", rest int"
    assert open_.mapInArrow(suffixes._lists, schema).count() == len(rows) * 2 * 12
    found = suffixes.sorted_groups(open_)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1 and "Join" not in plan
    starts = [*range(3, 10), *range(40, 44), 100]
    x = {(i, k): t.encode() for k, (i, t) in enumerate(rows)}
    low = {}
    for (i, _), t in sorted(x.items()):
        for a in starts:
            low.setdefault(t[a:a + 50], i)
    want = {(i, a, low[t[a:a + 50]]) for (i, _), t in x.items() for a in starts if low[t[a:a + 50]] < i}
    assert set(map(tuple, found.select("doc_id", "a", "source_doc").collect())) == want and len(want) > 5


def test_sorted_groups_with_rows_that_come_twice(session):
    from lexsense.llm import repeats as R
    rng = random.Random(6)
    t = "".join(rng.choice("abcdefg ") for _ in range(300))
    docs = R.keyed(frame(session, [(1, "x" + t), (2, t[:200]), (2, t[:200]), (3, t[100:])]))
    path = F.array(F.struct(F.lit(0).alias("a"), (F.octet_length("text") - 50).alias("b"), F.lit(0).alias("o")))
    found = suffixes.sorted_groups(docs.select("doc_id", "t", "text", path.alias("paths")))
    want = {(2, a) for a in range(151)} | {(3, a) for a in range(151)}
    assert set(map(tuple, found.select("doc_id", "a").collect())) == want


def test_anchor_of_one_document_does_not_stay_open(session):
    from lexsense.llm import repeats as R
    rows = [(1, 0, a, a, None, 0, 7, a, a) for a in range(3)] + [(1, 0, 9, 9, None, 0, 8, 1, 1), (2, 0, 9, 9, None, 0, 8, 2, 2)]
    removed, still = R.resolve(session.createDataFrame(rows, R.RUNS))
    assert removed.isEmpty()
    assert sorted((r["doc_id"], r["a"]) for r in still.collect()) == [(1, 9), (2, 9)]


def test_equal_runs_of_a_document_are_one_row(session):
    """A text of one word over and over has a reading at hundreds of places: a row each would grow with the places."""
    from lexsense.llm import repeats as R
    rows = [(i, f"x{i} " * (i % 3) + "the " * (200 + 7 * i) + "".join(f"e{i}{j} " for j in range(i % 2 * 30)) + "the " * 120) for i in range(9)]
    docs = R.keyed(frame(session, rows))
    for read, length, k in ((R.words, 50, 17), (R.octets, 50, 22)):
        per_doc = R.candidates(docs, read, length, k)
        found = R.repeated_runs(R.with_rows(docs, per_doc), read, length, k)
        n, places = found.agg(F.count("*"), F.sum(1 + F.coalesce(F.size("again"), F.lit(0)))).first()
        assert n < 9 * 120 and places > 1500
        assert found.groupBy("doc_id", "h", "s").count().where("count > 1").isEmpty()
    want = windows_brute(rows, words, 50)
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substrings.deduplicate(frame(session, rows), text=False).collect()}
    for (i, _), (x, g) in want.items():
        assert got[i] == (len(g), hashlib.sha256(" ".join(w for k, w in enumerate(x) if k not in g).encode()).hexdigest())
    want = windows_brute(rows, lambda t: list(t.encode()), 50)
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffixes.deduplicate(frame(session, rows)).collect()}
    for (i, _), (x, g) in want.items():
        assert got[i] == (len(g), hashlib.sha256(bytes(b for k, b in enumerate(x) if k not in g)).hexdigest())


def test_candidate_anchors_are_shuffled_once(session, corpus):
    from lexsense.llm import repeats as R
    plan = R.candidates(R.keyed(frame(session, corpus)), R.octets, 50, 22)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(h") == 1 and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_near_duplicates(session, corpus, shingle, percent):
    sets = {}
    for i, t in corpus:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = neardup.near_duplicates(frame(session, corpus), shingle, percent).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(sets[i]), find(i), find(i) == i) for i, _ in corpus)


def test_chunk_with_fewer_words_than_a_shingle(session):
    """A chunk of 1 to 4 words in all: the whole sequences are the shingles."""
    for texts in (["one two"], ["one two three"], ["one"], ["one two", ""], [None]):
        rows = [(i, t) for i, t in enumerate(texts)]
        got = neardup.near_duplicates(frame(session, rows).coalesce(1), 5, 80).collect()
        assert sorted(map(tuple, got)) == [(i, int(bool(t)), i, True) for i, t in rows]
    both = frame(session, [(0, "one two"), (1, "one two three"), (2, "One TWO")]).repartition(3, "doc_id")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(both, 5, 80).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_hot_group_is_cut_into_blocks(session, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "SMALL", 8)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1:])) for i, k in enumerate(range(0, 120, 2))]
    got = neardup.near_duplicates(frame(session, rows), 3, 85).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_components(session):
    path = list(range(64))
    random.Random(1).shuffle(path)
    edges = session.createDataFrame(list(zip(path, path[1:])) + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {i: 0 for i in range(64)} | {100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0
    path = session.createDataFrame([(i, i + 1) for i in range(700)] + [(5000, 5000 + i) for i in range(300)], "a long, b long")
    got = dict(map(tuple, components(path).collect()))
    assert got == {i: 0 for i in range(701)} | {5000 + i: 5000 for i in range(300)}


def test_vectors(session):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(9, 12))
    rows = [(i, (centers[i % 9] + rng.normal(size=12) * 0.12).tolist(), i % 2) for i in range(180)]
    rows += [(200 + i, rows[3][1], 1) for i in range(4)]
    rows += [(300, None, 1), (301, [0.0] * 12, 1), (302, [float("nan")] * 12, 1), (303, [None] * 12, 1), (304, rows[0][1], None),
             (305, [], 0), (306, [1.0], 0), (307, [2.0], 0), rows[5], (308, [float("inf")] * 12, 0)]
    got = vectors.links(session.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), cell=20).collect()
    rows = {r[0]: r for r in rows}
    unit = {}
    for i, e, label in rows.values():
        e = np.array([np.nan if v is None else v for v in e or []], np.float32).astype(float)
        if label is not None and len(e) and np.isfinite(e).all() and e.any():
            unit[i] = (label, e / np.linalg.norm(e))
    near = {i: [j for j in unit if j != i and i in unit and unit[i][0] == unit[j][0] and len(unit[i][1]) == len(unit[j][1])
                and unit[i][1] @ unit[j][1] >= 0.93] for i in rows}
    comp = {i: i for i in rows}
    for _ in rows:
        comp = {i: min([comp[i], *(comp[j] for j in near[i])]) for i in rows}
    assert sorted(map(tuple, got)) == sorted((i, len(near[i]), comp[i], comp[i] == i) for i in rows)
    assert sum(map(len, near.values())) > 500


def test_quality_rules(session, corpus):
    rows = corpus + [(600, "x | y | z | w\nAll rights reserved. " + "fine words here " * 30), (601, "go!! now!! " * 40)]
    got = {(r["doc_id"], r["n_words"]): r for r in lines.clean_lines(frame(session, rows)).collect()}
    for i, t in rows:
        w = words(t or "")
        count: dict = {}
        for k in range(len(w) - 2):
            count[tuple(w[k:k + 3])] = count.get(tuple(w[k:k + 3]), 0) + 1
        repeat = len({k + d for k in range(len(w) - 2) if count[tuple(w[k:k + 3])] > 1 for d in range(3)})
        live = [x for x in (t or "").split("\n") if words(x)]
        r = got[i, len(w)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(live) - len(set(live)), repeat)
        assert r["base_failed"] == (len(w) < 50 or 100 * repeat > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert got[600, 100]["n_failed"] == 2 and not got[601, 80]["kept"]


def test_pieces_round_trip_and_seed(session, corpus):
    rows = corpus + [(700, "▁ literal ▁mark, tabs\tand  spaces " + "é" * 40)]
    got = pieces.encode(frame(session, rows)).collect()
    assert all(r["lossless"] for r in got) and len(got) == len(rows)
    again = pieces.encode(frame(session, rows[::-1]).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    back = dict(map(tuple, pieces.decode(pieces.encode(frame(session, rows))).collect()))
    assert all(back[i] == (t or "") for i, t in rows)
    same = [(i, "the segmentation of the text") for i in range(200)]
    assert len({r["ids_crc32"] for r in pieces.encode(frame(session, same)).collect()}) > 20


def test_piece_sampling_follows_the_lattice():
    """Sampled segmentations of one word come as often as the product of their weights says."""
    import public_tokenizers
    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    word = b" than"
    n = 20000
    data = np.frombuffer(word * n, np.uint8)
    ids, at = v.encode(data, np.arange(n + 1) * len(word), np.arange(n))
    seen: dict = {}
    for i in range(n):
        key = tuple(ids[at[i]:at[i + 1]].tolist())
        seen[key] = seen.get(key, 0) + 1
    by_bytes = {p: i for i, p in reversed(list(enumerate(v.piece))) if p and v.weight[i] > 0}

    def all_of(rest):
        if not rest:
            yield (), 1.0
        for m in range(1, len(rest) + 1):
            if rest[:m] in by_bytes:
                i = by_bytes[rest[:m]]
                for tail, p in all_of(rest[m:]):
                    yield (i, *tail), p * v.weight[i]

    exact = dict(all_of(word))
    total = sum(exact.values())
    for key, p in sorted(exact.items(), key=lambda x: -x[1])[:4]:
        assert abs(seen.get(key, 0) / n - p / total) < 0.02


@pytest.mark.parametrize("text", [" является", "x" + " " * 9 + "y", "https://www.example.com/internationalization/documentation/",
                                  "自然言語処理の研究では大きな文章の集まりを使います", " міжнародного співробітництва", "über" * 12])
def test_piece_lattice_is_whole(text):
    """Pieces start at each byte as often as in the lattice of the whole text with all pieces."""
    import public_tokenizers
    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    word, n, power = text.encode(), 4000, 0.3
    weight = v.weight ** power
    of_byte = set(v.byte.tolist())  # bytes are edges where no other piece is the byte
    by_bytes = {v.piece[i]: i for i in of_byte} | {p: i for i, p in reversed(list(enumerate(v.piece))) if p and v.weight[i] > 0 and i not in of_byte}
    edge = lambda a, b: weight[by_bytes[word[a:b]]] if word[a:b] in by_bytes else 0.0
    size = len(word)
    ahead, behind = [1.0] + [0.0] * size, [0.0] * size + [1.0]
    for t in range(1, size + 1):
        ahead[t] = sum(ahead[a] * edge(a, t) for a in range(max(0, t - 32), t))
    for t in range(size - 1, -1, -1):
        behind[t] = sum(behind[b] * edge(t, b) for b in range(t + 1, min(size, t + 32) + 1))
    ids, at = v.encode(np.frombuffer(word * n, np.uint8), np.arange(n + 1) * size, np.arange(n), power)
    length = v.length[ids]
    begin = (np.cumsum(length) - length) % size
    seen = np.bincount(begin, minlength=size) / n
    assert np.abs(seen - np.array(ahead[:size]) * behind[:size] / ahead[size]).max() < 0.04
    assert at[-1] == len(ids) and v.decode(ids).tobytes() == word * n


def test_long_pieces_and_spaces_are_reached(session):
    import public_tokenizers
    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    wide = [p for p in v.piece if len(p) > 16 or (len(p) > 1 and not p.strip(b" "))]
    assert len(wide) >= 34
    for p in wide:
        n = 3000
        ids, _ = v.encode(np.frombuffer(p * n, np.uint8), np.arange(n + 1) * len(p), np.arange(n), 1.0)
        assert p in {v.piece[i] for i in np.unique(ids)}


def test_piece_query_returns_the_pieces(session, tmp_path):
    frame(session, [(1, "some words")]).write.parquet(f"{tmp_path}/documents.parquet")
    row = pieces.op6_sentencepiece(session, str(tmp_path)).collect()[0]
    assert zlib.crc32(np.array(row["ids"], "<u4").tobytes()) == row["ids_crc32"]


def test_packing(session, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer
    rows = corpus + [(800, "word and <|endoftext|> more"), (801, "long text " * 3000)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(frame(session, rows)).collect()
    want = {}
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).append(ids)
    pieces_of: dict = {}
    place: dict = {}
    for r in got:
        pieces_of.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, all_ids in want.items():
        expect = [(k, len(ids[k:k + 1024]), zlib.crc32(ids[k:k + 1024].tobytes()), len(ids)) for ids in all_ids for k in range(0, len(ids), 1024)]
        assert sorted(pieces_of[i]) == sorted(expect)
    for slots in place.values():
        end = 0
        for offset, n in sorted(slots):
            assert offset == end
            end += n
        assert end <= 1024
    assert packing.pack(frame(session, [])).count() == 0


def test_packing_needs_no_tokenizer_in_the_driver(session, corpus, monkeypatch):
    import tokenizers

    def loaded(path):
        raise AssertionError("tokenizer loaded in the driver")

    monkeypatch.setattr(tokenizers, "Tokenizer", type("Tokenizer", (), {"from_file": staticmethod(loaded)}))
    assert packing.pack(frame(session, corpus[:20])).select("doc_id").distinct().count() == 20


def test_packing_keeps_the_ids(session, corpus):
    """The sequences can be built from the pieces' ids, and give back the tokenizer's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer
    rows = [(i, t) for i, t in corpus if i != 1] + [(800, "word and <|endoftext|> more"), (801, "long text " * 3000)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    back: dict = {}
    for r in sorted(packing.pack(frame(session, rows)).collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        back.setdefault(r["doc_id"], []).extend(r["ids"])
    assert back == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}


def test_plan_uses_every_piece_once():
    h = np.zeros(1024, np.int64)
    h[1:] = np.random.default_rng(3).integers(0, 40, 1023)
    rows, sequences = packing.plan(h)
    for n in range(1, 1024):
        ranks = sorted((a, b) for m, a, b, *_ in rows.tolist() if m == n)
        assert sum(b - a for a, b in ranks) == h[n] and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:]))
    assert sequences <= 1.01 * (h * np.arange(1024)).sum() / 1024


@pytest.fixture(scope="module")
def labelled(session):
    rng = random.Random(8)
    good, bad = ["water", "stone", "river", "green", "walk", "morning"], ["zorblax", "grumpet"]
    rows, labels = [], []
    for i in range(400):
        t = rng.choices(good, k=40)
        toxic, junk = int(rng.random() < 0.3), int(rng.random() < 0.3)
        if toxic:
            w = rng.choice(bad)
            t[5] = "-".join(w) if i % 5 == 0 else w
        text = " ".join(w + "%%%" if junk else w for w in t)
        rows.append((i, text))
        labels.append((i, 1 - junk, toxic))
    rows += [(500, None), (501, ""), (502, "?! 12"), (rows[0][0], rows[0][1])]
    labels += [(None, 1, 1), (7, None, None), (503, 1, 0), labels[3]]
    return frame(session, rows), session.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(scores, labels, place):
    truth = {x[0]: x[place] for x in labels if x[0] is not None and x[place] is not None}
    held = [(s, truth[i]) for i, s in scores if i in truth and zlib.crc32(str(i).encode()) % 4 == 2]
    return np.mean([(s >= 0.5) == t for s, t in held])


def test_toxicity(labelled):
    docs, labels, truth = labelled
    got = [tuple(r) for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()]
    assert len(got) == 404 and all(0 <= s <= 1 for _, s in got)
    assert accuracy(got, truth, 2) > 0.95


def test_quality_classifier(labelled):
    docs, labels, truth = labelled
    got = [tuple(r) for r in quality.score(docs, quality.train(docs, labels)).collect()]
    assert len(got) == 404 and all(0 <= s <= 1 for _, s in got)
    assert accuracy(got, truth, 1) > 0.95


def test_quality_is_fitted_away_from_the_driver(labelled):
    """The driver gets the machine, not the sample that it is fitted on."""
    import tracemalloc
    docs, labels, _ = labelled
    quality.train(docs.limit(1), labels)  # imports
    tracemalloc.start()
    try:
        model = quality.train(docs, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.v.any()
    assert most < 3 << 20  # one dense copy of the 300 labelled rows takes 5 MB


def test_factorisation_identity():
    """The linear-time score equals the sum over all pairs."""
    rng = np.random.default_rng(1)
    width = quality.BUCKETS + quality.BINS * len(quality.STATS)
    m = quality.Machine(np.sort(rng.random((len(quality.STATS), quality.BINS - 1)), 1), 0.3,
                        rng.normal(size=width).astype(np.float32), rng.normal(0, 0.1, (width, 3)).astype(np.float32))
    data = np.frombuffer(b"some words some more words here", np.uint8)
    off = np.array([0, len(data)])
    row, word, x, stats = quality.features(data, off)
    dims = [*zip(word.tolist(), x.tolist()), *((d, 1.0) for d in m.dims(stats)[0].tolist())]
    s = m.bias + sum(m.w[d] * v for d, v in dims)
    s += sum(m.v[a] @ m.v[b] * p * q for i, (a, p) in enumerate(dims) for b, q in dims[:i])
    assert abs(m.score(data, off)[0] - 1 / (1 + np.exp(-s))) < 1e-4


def test_classifiers_without_labels(labelled, session):
    docs, labels, _ = labelled
    for model in (toxicity.train(docs, labels.limit(0)), quality.train(docs, labels.limit(0))):
        module = toxicity if isinstance(model, toxicity.Model) else quality
        assert {round(r["score"], 6) for r in module.score(docs, model).collect()} == {0.5}
    empty = frame(session, [])
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_gaps_and_insertions():
    m = toxicity.Model(["idiot"])
    value = lambda t: m.values(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0, 0]
    assert value("such an idiot here") > 0.95
    assert min(value("an i-d-i-o-t"), value("an idi0ot"), value("an i d i o t")) >= toxicity.FLOOR
    assert value("a perfectly fine sentence") == 0


def kernel_brute(a, b):
    """Kernel of two words of ASCII letters, by all letter triples."""
    def vector(word):
        x, out = "^" + word + "$", {}
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                for k in range(j + 1, min(len(x), i + toxicity.SPAN)):
                    out[x[i], x[j], x[k]] = out.get((x[i], x[j], x[k]), 0) + toxicity.DECAY ** (k - i + 1)
        return out
    u, v = vector(a), vector(b)
    dot = lambda p, q: sum(x * q.get(c, 0) for c, x in p.items())
    return dot(u, v) / (dot(u, u) * dot(v, v)) ** 0.5


def test_kernel_against_all_triples():
    names = ["idiot", "banana", "bananana", "mississippi", "iiddiioott", "ass", "assess"]
    for a in names:
        m = toxicity.Model([a])
        for b in names:
            got = float(m.kernel(*toxicity.word_matrix([b]), m.phi)[0, 0])
            assert got == pytest.approx(kernel_brute(a, b), abs=1e-4), (a, b)
        assert got <= 1.0001


def test_letters_scripts_and_long_landmarks():
    value = lambda m, t: m.values(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0, :len(m.landmarks)]
    assert value(toxicity.Model(["дурак"]), "шяьфю")[0] == 0 and value(toxicity.Model(["дурак"]), "ты дурак")[0] > 0.95
    assert value(toxicity.Model(["笨蛋蠢"]), "今天天气很好笨蛋蠢我们去玩吧")[0] > 0.9
    a, b = "a" * 3 + "bcdefghijklmnopqrstuvwxyz" + "idiot", "a" * 3 + "bcdefghijklmnopqrstuvwxyz" + "honey"
    m = toxicity.Model([a, b])
    rows = [value(m, x) for x in (a, b)]
    assert len(m.landmarks) > 2 and np.abs(rows[0] - rows[1]).max() > 0.3


@pytest.mark.parametrize("word", ["idiot", "crétin", "дурак", "ass", "antidisestablishmentarian"])
def test_wide_gaps_and_landmarks_of_any_length(word):
    m = toxicity.Model([word])
    value = lambda t: m.values(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0, 0]
    for sign in ("--", " . ", " ", "...", "·", "\u200b", " - - "):
        assert value("such an " + sign.join(word) + ", really") >= toxicity.FLOOR
    assert value(f"such an ({word})") > 0.95
    assert value("a perfectly fine sentence") == 0 and value(" . - . ") == 0


def test_landmarks_are_short_and_long_words(session):
    rows = [(i, f"some plain words {'zob unquestionabletwerpishness' if i % 2 else 'fine'}", i % 2) for i in range(60)]
    got = toxicity.choose_landmarks(session.createDataFrame(rows, "doc_id long, text string, label int"))
    assert {"zob", "unquestionabletwerpishness"} <= set(got)


def test_language(session):
    texts = {"aa": "rolo mita kolu tami rolo suma", "bb": "zwerg schnapp krumm strumpf knall zwing"}
    rows = [(i, k, " ".join(random.Random(i).choices(v.split(), k=12))) for i in range(200) for k, v in [list(texts.items())[i % 2]]]
    docs = session.createDataFrame([(i, t, k) for i, k, t in rows] + [(900, None, "aa"), (901, "12 ?!", "aa"), (902, "", None)],
                                   "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert len(got) == 203 and all(got[i]["lang_pred"] == k for i, k, _ in rows)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    nothing = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_every_language_is_learned_from_all_its_texts(session):
    """More languages than 64, and letters of every sampled text, copies counted once."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abcdefghij", k=6)) + f" {chr(0x4E00 + i % 80)}" * 3, f"l{i % 80}") for i in range(800)]
    model = language.train(session.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == {f"l{i}" for i in range(80)}
    rows = [(i, chr(0x4E00 + i) * 3000, "long") for i in range(40)] + [(1000 + i, "一一 copy", "long") for i in range(300)]
    model = language.train(session.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = {r["doc_id"] for r in session.range(40).where(language.flat.held_out(F.col("id"))).withColumnRenamed("id", "doc_id").collect()}
    assert {chr(0x4E00 + i) for i in range(40) if i not in held} | {*"copy一"} == set(model.alphabet)
    assert len(language.even(["ab " * 50, "c" * 900, "d" * 900], 600)) <= 600
    assert language.even(["ab", "c" * 900, "d" * 900], 603).count("d") >= 298


def test_phrases_are_longest_matches():
    """Phrase counts against a plain search for the longest known substring."""
    m = language.Model({"x": "abab bca cab abc"}, 1000)
    known = " " + "abab bca cab abc"
    for text in ("abab", "abcabca", "bcabab zz abz", "cabcab a", "ccc"):
        want = 0
        for w in text.split():
            s = " " + w
            k = 0
            while k < len(s):
                n = next((n for n in range(len(s) - k, 0, -1) if s[k:k + n] in known), 1)
                k += n
                want += 1
        got, _ = m.phrases([text], m.classes())
        assert got[0, 0] == want


def test_saved_tables_leave_no_shuffle_files(session):
    """Shuffle files of a saved table go at its end, and the setting is as before."""
    import time

    from lexsense.llm import scratch
    blocks = session.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {x for i in range(blocks.getAllFiles().size()) if (x := blocks.getAllFiles().apply(i).getName()).startswith("shuffle_")}
    before, conf = names(), session.conf.get(scratch.CLEANUP)
    out = scratch.saved(session.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(20):
        if not (left := names() - before):
            break
        time.sleep(0.5)
    assert not left and out.count() == 7 and session.conf.get(scratch.CLEANUP) == conf
