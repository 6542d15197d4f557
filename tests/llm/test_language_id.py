import random
import zlib
from collections import Counter
from math import exp, log

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import language_id

SF = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    rows = docs.join(language_id.identify(docs), "doc_id").select("doc_id", "held_out", "lang", "lang_pred", "score").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.97


def test_matches_plain_naive_bayes(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat", "en"), ("le chat noir", "fr"), ("The dog", "en"), ("un chien", "fr")] * 3)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    used = [(t, lang) for k, t, lang in rows if zlib.crc32(str(k).encode()) % 5]

    def grams(text):
        """Hashed n-grams of a lower-cased text with a space at either end, one at a time."""
        points, out, top = [ord(c) for c in f" {text.lower()} "], [], (1 << 32) - 1
        for n in (1, 2, 3):
            for at in range(len(points) - n + 1):
                h = 0
                for c in points[at : at + n]:
                    h = (h ^ c) * 0x9E3779B1 & top
                    h ^= h >> 15
                out.append((n, ((h + n) * 0x85EBCA6B & top) >> 16))
        return out

    for text in ("the chat", "noir", "é"):
        total = {}
        for lang in ("en", "fr"):
            own = Counter(g for t, x in used if x == lang for g in grams(t))
            size = {n: sum(v for (m, _), v in own.items() if m == n) for n in language_id.SIZES}
            total[lang] = log(sum(x == lang for _, x in used) / len(used)) + sum(log((own[g] + 0.5) / (size[g[0]] + 0.5 * 65536)) for g in grams(text))
        best = max(total, key=total.get)
        langs, scores = model.score([text, "other"])
        assert langs[0] == best and np.isclose(scores[0], 1 / sum(exp(v - total[best]) for v in total.values()), atol=1e-4)


def test_a_rare_language_is_learnt_whole(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(["alpha", "beta", "gamma"], k=6)), "xx") for k in range(3000)]
    rows += [(5000 + k, " ".join(rng.choices(["čšž", "říz", "ůň"], k=6)), "yy") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, train_docs=50)
    used = {x: sum(zlib.crc32(str(k).encode()) % 5 != 0 for k, _, lang in rows if lang == x) for x in ("xx", "yy")}
    assert model.langs == ["xx", "yy"] and np.allclose(np.exp(model.prior), [used["xx"] / sum(used.values()), used["yy"] / sum(used.values())])
    assert model.score(["říz ůň", "gamma beta"])[0] == ["yy", "xx"]


def test_odd_rows(spark):
    rows = [(1, "the cat sat", "en"), (2, None, "en"), (3, "", None), (4, "123 !!", "fr"), (None, "le chat", "fr"), (6, "le chat noir", "fr"), (6, "le chat noir", "fr"), (7, "a" * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(7) for c in ("lang_pred", "score", "held_out", "id", "counts")})
    got = {(r.doc_id): r for r in language_id.identify(docs).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == "und" and got[2].score == 0
    assert got[None].held_out and got[6].lang_pred in ("en", "fr") and got[7].score > 0
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.where("lang is null")).collect()} == {"und"}
