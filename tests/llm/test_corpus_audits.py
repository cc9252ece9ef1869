"""Source divergence, collocations and url filters against brute force, and their results for odd rows."""
from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexsense.llm import collocations, divergence, hosts
from lexsense.session import ensure_checkpoint_dir, ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n long, w1 long, rank string, terms string, vector int"
PAGE = "page_id long, url string, html string, host string, rule int, kind string, trust string"


@pytest.fixture(scope="module")
def session(spark):
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def documents(session, rows):
    """(text, lang, source) rows with columns whose names clash with inner ones."""
    return session.createDataFrame([(i, *r, 1, 2, "x", "y", 3) for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "Über", "cat", "dog's", "naïve", "x-ray", "U.S", "zeta", "ÉTÉ", "a", "b", "new york city", "and so"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(120)]
    out = [(t.replace("zeta", "zeta,"), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for t in texts]
    out += [(None, "en", "s1"), ("", "fr", "s1"), ("   \n ", "fr", "s9"), ("123 !!", "it", "alone"), (out[0]), (out[0])]
    out += [("the cat " * 3000, "en", "s2"), ("word" * 4000, "de", "s1"), ("the  cat\tthe\ncat;the cat", "en", "s1")]
    return out


# ---------------------------------------------------------------- 11


def audit_brute(rows, min_df, top):
    docs = [((l or ""), (s or ""), Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(
        "[A-Z]", lambda m: m[0].lower(), t or "")))) for t, l, s in rows]
    df, count = Counter(), defaultdict(Counter)
    for l, s, c in docs:
        df.update((l, t) for t in c)
        count[l, s].update(c)
    out = []
    for lang in {l for l, _, _ in docs}:
        kept = [t for (l, t), n in df.items() if l == lang and n >= min_df]
        group = {s: c for (l, s), c in count.items() if l == lang}
        whole = sum(group.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in group.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in group:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in group if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if group[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("block_terms, cells", [(4_000_000, 2_000_000), (3, 10)])
def test_divergence(session, rows, monkeypatch, block_terms, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    got = divergence.audit(documents(session, rows), min_df=4, top=3, block_terms=block_terms)
    got = got.select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == audit_brute(rows, 4, 3)


def test_divergence_sums_are_moved_by_parts(session, rows, monkeypatch):
    """A task gives a row for each part of a group's vocabulary, not one for each term."""
    seen = []
    add = divergence.added
    monkeypatch.setattr(divergence, "added", lambda x: seen.append(x) or add(x))
    monkeypatch.setattr(divergence, "PART", 8)
    got = divergence.audit(documents(session, rows), min_df=4, top=3, block_terms=50)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == audit_brute(rows, 4, 3)
    n, cells, most = seen[0].agg(F.count("*"), F.sum(F.size("ids")), F.max(F.array_max("ids"))).first()
    assert n < cells / 2 and most < 8


def test_divergence_without_terms(session):
    empty = documents(session, [])
    assert divergence.audit(empty).count() == 0
    got = divergence.audit(documents(session, [("one", "en", "a"), (None, "en", "b"), ("two", "de", "a")])).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_share_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        total = rng.randint(1, 9 * 10**15)
        count = rng.randint(1, total)
        assert int(divergence.share(np.int64(count), np.int64(total))) == 1 + 10**9 * count // total


# ---------------------------------------------------------------- 12


def phrases_brute(rows, min_count, overlap, top):
    f = defaultdict(Counter)
    for t, lang, _ in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\n\x0B\x0C\r]", t):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in often.items():
            if len(p) == 2 and any(100 * b >= overlap * a for q, b in often.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("limit, burst", [(2_000_000, 1 << 14), (40, 8)])
def test_collocations(session, rows, limit, burst):
    got = collocations.mine(documents(session, rows), min_count=4, top=25, limit=limit, burst=burst).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == phrases_brute(rows, 4, 50, 25)


def test_collocations_empty_and_long(session):
    assert collocations.mine(documents(session, [])).count() == 0
    assert collocations.mine(documents(session, [(None, None, None), ("a b", "en", "s")])).count() == 0
    long = [("ab " * 50_000 + "x" * 300_000, None, "s")]
    got = [tuple(r) for r in collocations.mine(documents(session, long)).select(*COLUMNS).collect()]
    assert got == phrases_brute(long, 10, 50, 2000)


def test_trie_keeps_every_count():
    rng = np.random.default_rng(2)
    trie, want, got = collocations.Trie(limit=3000, burst=64), Counter(), Counter()
    bursts = 0
    for _ in range(40):
        ids = rng.integers(0, 1 << 12, 500).astype(np.uint64) << np.uint64(50)
        want.update(ids.tolist())
        run = collocations.merged([(collocations.phrase_key([ids]), ids, np.ones(500, np.int64))])
        for out in trie.add(run):
            bursts += 1
            assert (out[0][1:] >= out[0][:-1]).all()  # runs are in key order
            got.update(dict(zip(out[1].tolist(), out[2].tolist())))
        assert trie.size <= 3000
    assert bursts and any(isinstance(x, list) for x in trie.root)
    for out in trie.rest():
        got.update(dict(zip(out[1].tolist(), out[2].tolist())))
    assert got == want and trie.size == 0


# ---------------------------------------------------------------- 13


def urls_brute(pages, rules, rounds, block_share):
    small = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    part = lambda u: (small(m[1]), m[2]) if (m := re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)) else ("", "")

    def judge(host, path):
        fit = [(len(r), len(r.split("/")[0]), v == "block", r, v) for v, r in rules
               if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]):])]
        return max(fit)[3:] if fit else (None, None)

    links, own = Counter(), defaultdict(list)
    for _, u, h in pages:
        host, path = part(u)
        own[host].append(judge(host, path)[1])
        found = {small(x) for x in re.findall(r"""[\s"'](?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\x00-\x20]+)""", h or "", re.I)}
        links.update((host, x) for x in found if host and x != host)
    names = {x for x in own if x} | {b for _, b in links}
    for x in names:
        up = ".".join(x.split(".")[-2:])
        if up != x:
            links[x, up] += 1
            links[up, x] += 1
    score = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        edges = [(a, b, w) if kind == "trust" else (b, a, w) for (a, b), w in links.items()]
        total = Counter()
        for a, _, w in edges:
            total[a] += w
        seed = {x: hosts.UNIT * own[x].count(verdict) // len(own[x]) if x in own else hosts.UNIT * (judge(x, "/")[1] == verdict) for x in names}
        s = dict(seed)
        for _ in range(rounds):
            new = Counter({x: v * 15 // 100 for x, v in seed.items()})
            for a, b, w in edges:
                new[b] += s.get(a, 0) * w * 85 // (total[a] * 100)
            s = new
        score[kind] = s
    out = []
    for i, u, _ in pages:
        host, path = part(u)
        rule, verdict = judge(host, path)
        t, d = score["trust"].get(host, 0), score["distrust"].get(host, 0)
        out.append((i, host, path, rule, verdict or ("block" if d and d * 100 >= (t + d) * block_share else "allow"), t, d))
    return sorted(out, key=repr)


def test_url_filter(session):
    rng = random.Random(4)
    names = ["a.org", "B.Org", "www.c.com", "c.com", "m.c.com", "d.net", "bad.net", "x.bad.net", "example.org", "en.example.org", "e.io"]
    pages = []
    for i in range(150):
        to = "".join(f'<a href="{rng.choice(["http://", "//", "HTTPS://"])}{rng.choice(names)}/p">' for _ in range(rng.randint(0, 4)))
        pages.append((i, f"http://{rng.choice(names)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}?q=1#x", to + "<img src='/own.png'>"))
    pages += [(1000, None, "<a href=http://d.net>"), (1001, "no scheme", None), (1002, "http://", ""), (1003, "http://e.io", None),
              (1004, "x://y://z/p#f", "x"), (0, *pages[0][1:]), (1005, "http://sub.d.net:80/" + "p" * 9000, "<a href = '//linked.only.org/'>")]
    rules = (*hosts.RULES, ("block", "bad.net"), ("allow", "x.bad.net/en/"), ("block", "e.io"))
    frame = session.createDataFrame([(*p, "h", 1, "k", "t") for p in pages], PAGE)
    got = hosts.judge_urls(frame, rules, rounds=6).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust").collect()
    want = urls_brute(pages, rules, 6, 50)
    assert sorted(map(tuple, got), key=repr) == want
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}


def test_url_filter_empty(session):
    assert hosts.judge_urls(session.createDataFrame([], PAGE)).count() == 0
