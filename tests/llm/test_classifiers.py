import math
import random
from collections import Counter
from itertools import groupby

import numpy as np

from graphloom.llm import quality, toxicity
from graphloom.llm.hashed_text import Texts, style_features, word_features

SF = "/root/testdata/sf0.1"
ODD = [(1, None, "x", 9), (2, "", "y", 9), (3, "!!!", "", 9), (None, "some words here", None, 9), (4, "long words " * 40_000, "", 9), (4, "again", "", 9)]
DDL = "doc_id long, text string, p_toxic string, __grade int"


def unseen(spark):
    """Documents, labels to learn from, and labels held out."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")


def test_toxicity_held_out(spark):
    docs, learn, test = unseen(spark)
    rows = toxicity.flag(docs, learn).join(test, "doc_id").select("toxic", "quality", "is_toxic", "p_low_quality").collect()
    caught = np.mean([r.is_toxic for r in rows if r.toxic])
    wrong = np.mean([r.is_toxic for r in rows if not r.toxic])
    print("toxicity", caught, wrong)
    assert caught > 0.95 and wrong < 0.01
    poor = [r.p_low_quality for r in rows if not r.quality]
    assert np.mean(poor) > np.mean([r.p_low_quality for r in rows if r.quality]) + 0.3


def hashed_features(text):
    """The buckets of a text's words and prefixes, one character at a time."""
    text, found = (text or "").lower(), set()
    for word, run in groupby(text, key=str.isalnum):
        if not word:
            continue
        run = "".join(run)
        for size, salt in [(len(run), 0), *((k, k) for k in (3, 4, 5, 6) if k < len(run))]:
            h = sum(ord(c) * pow(0x9E3779B97F4A7C15, at, 1 << 64) for at, c in enumerate(run[:size])) % (1 << 64)
            h = (h + salt) * 0xBF58476D1CE4E5B9 % (1 << 64)
            found.add(((h ^ h >> 29) * 0x94D049BB133111EB % (1 << 64)) >> 44)
    return found


def plain_fit(rows, before, y, order, rate=0.2, l1=4.0, l2=0.5):
    """FTRL-proximal, a coordinate at a time, in the given order of rows."""
    z, n, dense = {}, {}, [0.0] * len(before[0])
    bias = math.log(sum(y) / (len(y) - sum(y)))
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1 + math.sqrt(n[i])) / rate + l2)
    for k in order:
        w = {i: weight(i) for i in rows[k]}
        g = 1 / (1 + math.exp(-(sum(w.values()) + sum(a * b for a, b in zip(before[k], dense)) + bias))) - y[k]
        for i in rows[k]:
            z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / rate * w[i]
            n[i] = n.get(i, 0.0) + g * g
        dense = [d - 0.05 * (g * x + 0.01 * d) for d, x in zip(dense, before[k])]
        bias -= 0.01 * g
    return {i: weight(i) for i in z}, dense, bias


def test_chain_matches_a_plain_one():
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["vile", "nasty", "kind"] if k % 3 == 0 else ["green", "kind", "Table-top", "Ñandú"], k=rng.randrange(4, 30))) for k in range(120)]
    y = np.array([[k % 2, k % 3 == 0] for k in range(120)], float)
    rows = toxicity._rows(*word_features(Texts.of(texts), toxicity.BITS), len(texts))
    sets = [hashed_features(t) for t in texts]
    assert [set(rows.row(k).tolist()) for k in range(120)] == sets
    shuffled = np.random.default_rng(7)
    order = [int(k) for _ in range(4) for k in shuffled.permutation(120)]
    chain = toxicity.fit_chain(rows, y)
    before, models = [[] for _ in texts], []
    fold = np.random.default_rng(11).permutation(120) % 3
    for c in range(2):
        models.append(plain_fit(sets, before, y[:, c], order))
        if c == 0:
            unseen = [0.0] * 120
            for f in range(3):
                inside = [k for k in range(120) if fold[k] != f]
                again = np.random.default_rng(7)
                w, _, bias = plain_fit([sets[k] for k in inside], [[]] * len(inside), y[inside, 0], [int(k) for _ in range(4) for k in again.permutation(len(inside))])
                for k in range(120):
                    if fold[k] == f:
                        unseen[k] = 1 / (1 + math.exp(-(sum(w.get(i, 0.0) for i in sets[k]) + bias)))
            before = [[u] for u in unseen]
    found = chain.probabilities(rows)
    for k in range(120):
        first = 1 / (1 + math.exp(-(sum(models[0][0].get(i, 0.0) for i in sets[k]) + models[0][2])))
        second = 1 / (1 + math.exp(-(sum(models[1][0].get(i, 0.0) for i in sets[k]) + models[1][1][0] * first + models[1][2])))
        assert np.allclose(found[k], [first, second], atol=1e-9)


def test_an_earlier_category_moves_the_decision(spark):
    docs, learn, _ = unseen(spark)
    chain = toxicity.train(docs, toxicity.categorised(learn), toxicity.CATEGORIES)
    assert abs(chain.models[1].dense[0]) > 1e-3
    rows = toxicity._rows(*word_features(Texts.of(["some plain words"]), toxicity.BITS), 1)
    low, high = (chain.models[1].predict(rows, np.array([[p]]))[0] for p in (0.0, 1.0))
    assert low != high


def test_quality_held_out(spark):
    docs, learn, test = unseen(spark)
    rows = quality.rate(docs, learn).join(test, "doc_id").select("quality", "toxic", "selected", "expected_grade").collect()
    good = lambda r: r.quality and not r.toxic
    kept = np.mean([r.selected for r in rows if good(r)])
    wrong = np.mean([r.selected for r in rows if not r.quality and not r.toxic])
    mean = [np.mean([r.expected_grade for r in rows if f(r)]) for f in (lambda r: not r.quality, lambda r: r.quality and r.toxic, good)]
    print("quality", kept, wrong, mean)
    assert kept > 0.98 and wrong < 0.1 and mean == sorted(mean)


def test_likelihood_is_maximal_and_scores_follow_the_formula():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["good", "fine"] if k % 3 else ["bad", "worse"], k=6) + rng.choices("abc", k=3)) for k in range(90)]
    grade = np.array([(k % 3) if rng.random() < 0.8 else rng.randrange(3) for k in range(90)])
    owner, ids, values = style_features(Texts.of(texts), quality.BITS)
    model = quality.fit(owner, ids, values, grade, [0.0, 1.0, 2.5], steps=1500, rate=0.02, l2=1e-3)
    used = sorted(set(ids.tolist()))
    counts = Counter(grade.tolist())

    def loss(w, cuts):
        total = 0.0
        for k in range(90):
            s = sum(w[i] * v for i, v in zip(ids[owner == k].tolist(), values[owner == k]))
            below = [0.0, *(1 / (1 + math.exp(s - c)) for c in cuts), 1.0]
            total -= 90 / (3 * counts[grade[k]]) * math.log(below[grade[k] + 1] - below[grade[k]])
        return total / 90 + 1e-3 / 2 * sum(w[i] ** 2 for i in used)

    w, cuts = dict(enumerate(model.weights)), list(model.thresholds)
    best = loss(w, cuts)
    for i in used[:6]:
        for step in (0.05, -0.05):
            assert loss(w | {i: w[i] + step}, cuts) > best - 1e-4
    for k in (0, 1):
        for step in (0.05, -0.05):
            assert loss(w, [c + step * (n == k) for n, c in enumerate(cuts)]) > best - 1e-4
    expected, some, tail = model.score(texts)
    for k in range(90):
        s = sum(w[i] * v for i, v in zip(ids[owner == k].tolist(), values[owner == k]))
        above = [1 / (1 + math.exp(c - s)) for c in cuts]
        assert np.allclose([expected[k], some[k], tail[k]], [above[0] * 1.0 + above[1] * 1.5, *above], atol=1e-9)


def test_ratings_of_any_value(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(["up"], k=1 + k % 40) + rng.choices(["down"], k=40 - k % 40)), k % 40 / 2) for k in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    ratings = spark.createDataFrame([(k, g) for k, _, g in rows] + [(None, 1.0), (7, None), (8, float("nan"))], "doc_id long, quality double")
    model = quality.train(docs, ratings)
    assert len(model.grades) == 20 and model.grades == sorted(model.grades) and (np.diff(model.thresholds) > 0).all()
    few = quality.train(docs, ratings.where("quality in (2.5, 3, 10)"))
    assert few.grades == [2.5, 3.0, 10.0]


def test_ordinal_grades_keep_their_order():
    rng = random.Random(4)
    texts, grade = [], []
    for _ in range(600):
        g = rng.randrange(4)
        texts.append(" ".join(rng.choices(["fine", "good"], k=3 + 4 * g) + rng.choices(["awful", "bad"], k=3 + 4 * (3 - g)) + rng.choices("abcdef", k=5)))
        grade.append(g)
    model = quality.fit(*style_features(Texts.of(texts), quality.BITS), np.array(grade), [1, 2, 4, 7])
    assert (np.diff(model.thresholds) > 0).all()
    expected, some, tail = model.score(texts)
    assert (some >= tail).all()
    means = [expected[np.array(grade) == g].mean() for g in range(4)]
    assert means == sorted(means) and means[0] < 1.6 and means[3] > 5.5
    assert tail[np.array(grade) == 3].mean() > 0.7 > 0.3 > tail[np.array(grade) == 1].mean()


def test_word_features_are_distinct_words_and_prefixes():
    owner, ids = word_features(Texts.of(["Loser losers, LOSER", "", "losers"]), 20)
    per_text = [set(ids[owner == k]) for k in range(3)]
    assert len(per_text[0]) == len(ids[owner == 0]) == 5 and not per_text[1] and len(per_text[2]) == 4 and per_text[2] < per_text[0]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DDL)
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 1), (4, 1, 1), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    for found, probability in ((toxicity.flag(docs, labels), "p_toxic"), (quality.rate(docs, labels), "p_top")):
        got = found.collect()
        assert len(got) == len(ODD)
        assert all(r[probability] == 0 for r in got if r.doc_id in (1, 2))
    none = labels.limit(0)
    assert toxicity.flag(docs, none).where("is_toxic").count() == 0
    assert quality.rate(docs, none).where("selected").count() == 4
    assert toxicity.flag(docs.limit(0), labels).count() == quality.rate(docs.limit(0), labels).count() == 0
    assert toxicity.keep_clean(docs, none).count() == len(ODD)
