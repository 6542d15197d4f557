import functools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import decontaminate as d

SF = "/root/testdata/sf0.01"


def covered(index, terms):
    """Every item's score, by adding up all postings."""
    total = {}
    for t in set(terms):
        for item, impact in zip(index.postings[t].items, index.postings[t].impacts, strict=True):
            total[item] = total.get(item, 0) + impact
    return total


def test_wand_retrieves_all_above_the_threshold():
    rng = random.Random(3)
    for n, block in ((3, 2), (200, 4), (500, 16)):
        vocabulary = [f"w{k}" for k in range(150)]
        index = d.Index([(k, " ".join(rng.choices(vocabulary, weights=range(1, 151), k=rng.randrange(1, 12)))) for k in range(n)], block=block)
        for _ in range(150):
            terms = sorted(set(rng.choices(range(len(index.term)), k=rng.randrange(1, 40))))
            for least in (0.05, 0.3, 0.6, 1.0):
                truth = {i: s for i, s in covered(index, terms).items() if s >= least - 1e-9}
                got = dict(index.retrieve(terms, least))
                assert got.keys() == truth.keys() and np.allclose([got[k] for k in truth], list(truth.values()))


def spoken(text):
    """The words of a text, a character at a time."""
    out = [""]
    for c in (text or "").lower():
        if c.isalnum():
            out[-1] += c
        elif out[-1]:
            out.append("")
    return [w for w in out if w]


def halves(text):
    """Question and answer, sentence by sentence from the end."""
    sentences, open_ = [], ""
    for at, c in enumerate(text):
        if c == "\n" or c.isspace() and at and text[at - 1] in ".?!":
            sentences.append(open_)
            open_ = ""
        else:
            open_ += c
    sentences = [spoken(s) for s in [*sentences, open_]]
    answer = []
    while sentences and len(answer) < 5:
        answer = sentences.pop() + answer
    question = [w for s in sentences for w in s]
    return (question, answer) if len(question) >= 5 else (question + answer, [])


def inside(part, passage):
    k = min(5, len(part))
    wanted = {" ".join(part[a : a + k]) for a in range(len(part) - k + 1)}
    have = {" ".join(passage[a : a + k]) for a in range(len(passage) - k + 1)}
    return len(wanted & have) / len(wanted) if part else 1.0


def plain(docs, items):
    """{(doc, item): score}, by comparing every window of every document with every item, from the formula of BM25."""
    items = [(i, t, spoken(t)) for i, t in items if spoken(t)]
    df, n = Counter(x for *_, w in items for x in set(w)), len(items)
    mean, longest = sum(len(w) for *_, w in items) / n, max(len(w) for *_, w in items)
    weights = []
    for *_, w in items:
        own = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, f in Counter(w).items()}
        weights.append({x: y / sum(own.values()) for x, y in own.items()})
    out = {}
    for doc_id, text in docs:
        w = spoken(text)
        for a in range(0, max(1, len(w)), longest):
            passage = w[a : a + 2 * longest]
            have = set(passage)
            for (i, t, _), weight in zip(items, weights, strict=True):
                score = sum(y for x, y in weight.items() if x in have)
                if score >= 0.6 - 1e-9 and all(inside(part, passage) >= 0.8 for part in halves(t)):
                    out[doc_id, i] = max(score, out.get((doc_id, i), 0.0))
    return out


def test_leaks_match_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    truth = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): r.score for r in d.leaks(docs, items).collect()}
    assert got.keys() == truth.keys() and len(got) > 3 and np.allclose([got[k] for k in truth], list(truth.values()))
    assert {r.doc_id for r in d.keep_clean(docs, items).collect()} == {r.doc_id for r in docs.collect()} - {i for i, _ in truth}


def test_many_indexes_give_the_rows_of_one(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(tuple(r) for r in d.leaks(docs, items).collect())
    small = functools.partial(d.indexes, batch_chars=2000)
    monkeypatch.setattr(d, "indexes", small)
    assert len(small(items)) > 2
    assert np.allclose(np.array(sorted(tuple(r) for r in d.leaks(docs, items).collect())), np.array(one))
    whole = {r.doc_id for r in docs.collect()} - {r[0] for r in one}
    assert {r.doc_id for r in d.keep_clean(docs, items).collect()} == whole


def test_question_and_answer_are_verified_apart(spark):
    question, answer = "which of the seven old harbours lies furthest to the north of the grey island", "the harbour of the two white towers does so"
    bench = spark.createDataFrame([(1, f"{question}? {answer}."), (1, f"{question}? {answer}."), (1, "another text of this item with words. and an answer to it at last")], "item_id long, text string")
    docs = [(1, question), (2, f"{question} and then something else is told at length"), (3, answer), (4, f"well, {question}: {answer}!"), (5, f"{question} {answer} another text of this item with words and an answer to it at last")]
    docs.append((6, "word " * 200_000 + f"{question} {answer}"))
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(4, 1), (5, 1), (6, 1)]
    assert d.parts("a b c d e f. Yes! It is so then") == ("a b c d e f".split(), "yes it is so then".split()) and d.parts("Yes. It is so")[1] == []


def test_several_indexes_odd_rows_and_edits(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    items = [(k, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(12)) + "?") for k in range(6)]
    edited = items[2][1].split()
    edited[20] = "other"
    filler = " ".join(word() for _ in range(500))
    docs = [(1, f"{filler} {items[0][1]} {filler}"), (2, f"{filler} {' '.join(edited)}"), (3, filler), (4, None), (5, ""), (None, items[4][1].upper()), (6, " ".join(items[1][1].split()[:25])), (7, "?!"), (1, "yes it is")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").withColumn("score", F.lit("s"))
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (None, "null id item of some words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.leaks(frame, bench).collect()}
    assert got == {(1, 0), (2, 2), (None, 4)}
    several = d.indexes(bench, batch_chars=600)
    assert len(several) > 1 and sorted(i for x in several for i in x().ids if i is not None) == list(range(6))
    assert sorted((r.text or "") for r in d.keep_clean(frame, bench).collect()) == sorted((t or "") for i, t in docs if (i, t) in docs[2:5] + docs[6:])
    assert d.leaks(frame.limit(0), bench).count() == 0 and d.leaks(frame, bench.limit(0)).count() == 0
