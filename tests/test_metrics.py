"""Text metrics: hand cases (computed from the metric definitions) and brute-force properties."""
import math
import random
from collections import Counter

import numpy as np
import pytest

from lexsense.operators import metrics as M

G = "the act of moving fast on the feet"
HAND = [  # gold, prediction, rougeL, bleu, nist, sacrebleu, meteor (exact stage), exact
    (G, "the act of moving on foot", 0.714286, 0.457823, 1.787113, 38.498150, 0.571795, 0),
    (G, "fast the act", 0.363636, 0.130959, 0.054837, 0, 0.200000, 0),
    (G, "feet", 0.222222, 0.000912, 0.0, 0, 0.068493, 0),
    (G, G, 1, 1, 3.035714, 100, 0.999023, 1),
    (G, "xyz qrs", 0, 0, 0, 0, 0, 0),
    (G, "", 0, 0, 0, 0, 0, 0),
    ("a small dog", "a small dog", 1, 1, 1.584963, 0, 0.981481, 1),
    ("a b a b c", "a b b a c a b", 0.666667, 0.341529, 1.253758, 21.736044, 0.715385, 0),
]
NAMES = ["rougeL", "nltk_bleu", "nist", "sacrebleu", "meteor", "exact_match"]


def _score(spark, rows, metrics=NAMES, partitions=None):
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(rows)], "row_id long, gloss string, answer string")
    prep = M.prepare(df, partitions=partitions)
    out = M.score_rows(prep, metrics).orderBy("row_id").collect()
    return [[r[m] for m in metrics] for r in out]


def test_hand_cases(spark):
    got = _score(spark, [(g, p) for g, p, *_ in HAND])
    for (g, p, *want), row in zip(HAND, got):
        assert row == pytest.approx(want, abs=1e-6), (g, p, row)


# ---- brute force from the definitions (independent Python, per row)

def ngrams(t, n):
    return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))


def bleu_ref(g, p):
    if not p:
        return 0.0
    m = [sum((ngrams(p, n) & ngrams(g, n)).values()) for n in range(1, 5)]
    t = [max(1, len(p) - n + 1) for n in range(1, 5)]
    if m[0] == 0:
        return 0.0
    k = min(4, len(p))
    prec = [m[0] / t[0]] + [(m[i] + 1) / (t[i] + 1) for i in range(1, 4)]
    bp = 1.0 if len(p) > len(g) else math.exp(1 - len(g) / len(p))
    return bp * math.exp(sum(math.log(x) for x in prec[:k]) / k)


def lcs_ref(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


def meteor_ref(g, p):
    hyp, ref = list(enumerate(p)), list(enumerate(g))
    matches = []
    for i in range(len(hyp))[::-1]:
        for j in range(len(ref))[::-1]:
            if hyp[i][1] == ref[j][1]:
                matches.append((hyp[i][0], ref[j][0]))
                hyp.pop(i)
                ref.pop(j)
                break
    m = len(matches)
    if m == 0 or not p or not g:
        return 0.0
    matches.sort()
    chunks = 1 + sum(1 for a, b in zip(matches, matches[1:]) if not (b[0] == a[0] + 1 and b[1] == a[1] + 1))
    P, R = m / len(p), m / len(g)
    return (1 - 0.5 * (chunks / m) ** 3) * P * R / (0.9 * P + 0.1 * R)


def test_random_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = list("abcdefg")
    rows = []
    for _ in range(60):
        g = [rnd.choice(vocab) for _ in range(rnd.randint(0, 12))]
        p = [rnd.choice(vocab) for _ in range(rnd.randint(0, 12))]
        rows.append((" ".join(g), " ".join(p)))
    got = _score(spark, rows, ["nltk_bleu", "meteor", "rougeL"])
    for (g, p), (b, me, rl) in zip(rows, got):
        gt, pt = g.split(), p.split()
        assert b == pytest.approx(bleu_ref(gt, pt), abs=1e-9)
        assert me == pytest.approx(meteor_ref(gt, pt), abs=1e-9)
        lcs = lcs_ref(pt, gt)
        f = 0.0 if lcs == 0 else 2 * (lcs / len(pt)) * (lcs / len(gt)) / (lcs / len(pt) + lcs / len(gt))
        assert rl == pytest.approx(f, abs=1e-9)


def test_lcs_helper_matches_dp():
    rnd = random.Random(3)
    for _ in range(200):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 15))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 15))]
        assert M.lcs_length(a, b) == lcs_ref(a, b)


def test_scores_do_not_depend_on_partitioning(spark):
    rows = [(g, p) for g, p, *_ in HAND] * 3
    a = _score(spark, rows, partitions=1)
    b = _score(spark, rows, partitions=7)
    assert a == b


def test_meteor_stem_stage(spark):
    df = spark.createDataFrame([(0, "the dogs were running home", "a dog runs home")], "row_id long, gloss string, answer string")
    prep = M.prepare(df)
    stems = spark.createDataFrame([("dogs", "dog"), ("running", "run"), ("runs", "run")], "word string, stem string")
    exact = M.meteor(prep).first().meteor
    staged = M.meteor(prep, stems).first().meteor
    # exact: only "home" matches; with stems dog/dogs and runs/running match too
    P, R = 3 / 4, 3 / 5
    assert staged == pytest.approx((1 - 0.5 * (2 / 3) ** 3) * P * R / (0.9 * P + 0.1 * R))
    assert exact == pytest.approx((1 - 0.5 * 1.0) * (1 / 4) * (1 / 5) / (0.9 / 4 + 0.1 / 5))


def test_registry_matches_joint_scoring(spark):
    df = spark.createDataFrame([(i, g, p) for i, (g, p, *_) in enumerate(HAND)], "row_id long, gloss string, answer string")
    prep = M.prepare(df)
    joint = {r.row_id: r for r in M.score_rows(prep, NAMES).collect()}
    for name in NAMES:
        single = {r.row_id: r[name] for r in M.metric_table(prep, name).collect()}
        assert single == pytest.approx({k: v[name] for k, v in joint.items()})
    with pytest.raises(KeyError):
        M.metric_table(prep, "bleurt")


# ---- M1 by bits, M5 synonym stage

def test_lcs_by_bits_equals_the_plain_table():
    rnd = random.Random(8)
    for size in (0, 1, 2, 63, 64, 65, 130, 200):
        for _ in range(12):
            words = rnd.choices("abcdefgh"[:rnd.randint(1, 8)], k=300)
            a, b = rnd.choices(words, k=rnd.randint(0, size)), rnd.choices(words, k=size)
            assert M.lcs_length(a, b) == lcs_ref(a, b)


def stages_ref(g, p, stems, synsets):
    """All three stages by the plain double loops over tokens, the last first."""
    left_p, left_g, found = list(enumerate(p)), list(enumerate(g)), []

    def stage(same):
        for x in list(left_p)[::-1]:
            for y in list(left_g)[::-1]:
                if same(x[1], y[1]):
                    found.append((x[0], y[0]))
                    left_p.remove(x)
                    left_g.remove(y)
                    break

    stage(lambda a, b: a == b)
    if stems is not None:
        left_p[:] = [(i, stems.get(w, w)) for i, w in left_p]
        left_g[:] = [(i, stems.get(w, w)) for i, w in left_g]
        stage(lambda a, b: a == b)
    stage(lambda a, b: bool(synsets.get(a, set()) & synsets.get(b, set())))
    m = len(found)
    if not m:
        return 0.0
    found.sort()
    chunks = 1 + sum(not (a[0] + 1 == b[0] and a[1] + 1 == b[1]) for a, b in zip(found, found[1:]))
    prec, rec = m / len(p), m / len(g)
    return (1 - 0.5 * (chunks / m) ** 3) * prec * rec / (0.9 * prec + 0.1 * rec)


def _meteor(spark, rows, synsets, stems=None):
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(rows)], "row_id long, gloss string, answer string")
    table = [(w, s) for w, sets in synsets.items() for s in sets] * 2  # repeated rows count once
    syn = spark.createDataFrame(table, "word string, synset string")
    st = spark.createDataFrame(list(stems.items()), "word string, stem string") if stems is not None else None
    return [r.meteor for r in M.meteor(M.prepare(df), st, syn).orderBy("row_id").collect()]


def test_synonyms_compete_for_one_word(spark):
    # car and truck both match vehicle: the last of them gets the only one; auto is left for car
    synsets = {"car": {"1", "2"}, "auto": {"1"}, "truck": {"2"}, "vehicle": {"2"}}
    rows = [("a vehicle", "car truck"), ("a vehicle", "truck car"), ("auto vehicle", "car truck"), ("vehicle auto", "truck car"),
            ("auto vehicle", "truck car"), ("car", "car"), ("", "car"), ("vehicle", "x")]
    got = _meteor(spark, rows, synsets)
    assert got == pytest.approx([stages_ref(g.split(), p.split(), None, synsets) for g, p in rows])
    assert got[0] == got[1] > 0 and got[2] > got[4] == got[0]  # in order both match; else car takes vehicle


@pytest.mark.parametrize("stemmed", [False, True])
def test_synonym_stage_against_the_double_loop(spark, stemmed):
    rnd = random.Random(21)
    words = [f"w{k}" for k in range(14)]
    synsets = {w: {str(rnd.randint(0, 6)) for _ in range(rnd.randint(0, 3))} for w in words}
    stems = {w: f"w{k // 2}" for k, w in enumerate(words)} if stemmed else None
    rows = [(" ".join(rnd.choices(words, k=rnd.randint(0, 25))), " ".join(rnd.choices(words, k=rnd.randint(0, 25)))) for _ in range(60)]
    got = _meteor(spark, rows, synsets, stems)
    assert got == pytest.approx([stages_ref(g.split(), p.split(), stems, synsets) for g, p in rows])


def test_grams_and_vectors_of_a_row_go_on_once(spark):
    """Grams that the prediction lacks end after the count, and a word of both sides looks its vector up once."""
    pairs = spark.createDataFrame([(1, "a b c d", "a b x d"), (2, "a a b", "a b b"), (3, "p q", "r s")], "row_id long, gloss string, answer string")
    prep = M.prepare(pairs)
    plan = M.ngram_stats(prep)._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in x and "cp" in x and "> 0" in x for x in plan.splitlines()), plan
    vectors = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate("abcdx")], "token string, embedding array<double>")
    soft = M.soft_match(prep, vectors)
    plan = soft._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in x and "word" in x and "side" in x.split("[")[1] for x in plan.splitlines()), plan
    got = {r.row_id: r.bertscore for r in soft.collect()}
    unit = {w: np.array([i, 1.0]) / np.hypot(i, 1.0) for i, w in enumerate("abcdx")}
    for row, g, p in ((1, "abcd", "abxd"), (2, "aab", "abb")):
        sim = np.array([[unit[x] @ unit[y] for y in g] for x in p])
        prec, rec = sim.max(axis=1).mean(), sim.max(axis=0).mean()
        assert got[row] == pytest.approx(2 * prec * rec / (prec + rec))
    assert got[3] == 0.0
