import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import simhash

DDL = "doc_id long, text string, n_chars long, fp string, component string"


def plain(text):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "ÀB", "x\ty"]
    base = [" ".join(rng.choices(vocabulary, k=n)) for n in (0, 1, 3, 4, 5, 60, 200, 400)]
    texts = base + base[5:] + [b.replace("w1", "v1", 1) for b in base] + [b + " tail" for b in base] + [None, "", " \n", "A b", "a B"]
    texts += [" ".join(rng.choices(vocabulary, k=80)) for _ in range(60)]
    rows = [(i * 3 + 1, t, 0, "x", "y") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DDL)).collect()}
    fps = {i: plain(t) for i, t, *_ in rows}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {i: c for i, (_, c) in got.items()} == components(fps)


def ball(rng, n):
    """Random values, a dense ball, and what is a little further out."""
    centre = int(rng.integers(1 << 62))
    values = {int(x) for x in rng.integers(0, 1 << 63, n, dtype=np.uint64)}
    for _ in range(n):
        values.add(centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 9)), replace=False)))
    return sorted(values)


@pytest.mark.parametrize("budget", [0, 1, 3, 4, 5])
def test_tries_find_all_links(budget):
    rng = np.random.default_rng(budget)
    values = np.array(ball(rng, 150), np.uint64)
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= budget
    label = np.arange(len(values))
    while not np.array_equal(label, lower := np.array([label[row].min() for row in close])):
        label = lower
    forest = simhash.Forest(len(values))
    for by, widths in simhash.rotated(budget):
        turned = (values << np.uint64(by)) | (values >> np.uint64(64 - by)) if by else values
        order = np.argsort(turned)
        root = np.array([[0, len(values), 0, len(values), 0, 0]]).T
        found = simhash.trie_self_join(turned[order], root, np.repeat(np.arange(budget + 1), widths), budget)
        forest.unite(order, order[found.flatten()])
    assert np.array_equal(forest.flatten(), label)


def test_links_through_large_nodes(spark):
    fps = dict(enumerate(np.array(ball(np.random.default_rng(3), 300), np.uint64).view(np.int64).tolist()))
    frame = spark.createDataFrame([(v,) for v in fps.values()], "fp long")
    expected = components({i: v & (1 << 64) - 1 for i, v in fps.items()})
    for nodes, most in ((8, 8), (1 << 20, 8), (64, 100_000)):
        found = simhash.connected_components(simhash.links(frame, node_rows=nodes, most_rows=most)).collect()
        of = {r.node: r.component for r in found}
        first: dict[int, int] = {}
        assert {i: first.setdefault(of.get(v, v), i) for i, v in fps.items()} == expected
    split = simhash.cells(frame, node_rows=8, most_rows=8)
    assert split.where("a <> b").count() and split.select("depth").distinct().count() > 2


def test_the_trie_does_the_join_of_the_table(spark, monkeypatch):
    rows = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("fp").distinct()
    cells = simhash.cells(rows).repartition(1).sortWithinPartitions(*simhash.CELL, "r").toArrow().combine_chunks().to_batches()
    expanded, expand = [], simhash._expand
    monkeypatch.setattr(simhash, "_expand", lambda values, pairs, allowed: expanded.append(pairs.shape[1]) or expand(values, pairs, allowed))
    edges = sum(b.num_rows for b in simhash._in_cells(iter(cells), 4, 1 << 17))
    assert edges and sum(expanded) > rows.count()


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d e", 0, "", ""), (5, "a b c d e", 0, "", ""), (5, "a b c d e", 0, "", ""), (None, "zz yy", 0, "", ""), ((1 << 63) - 1, "other words here", 0, "", "")]
    got = sorted(simhash.near_duplicates(spark.createDataFrame(rows, DDL)).collect(), key=str)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 5), (5, 5), (5, 5), ((1 << 63) - 1,) * 2]
    assert simhash.near_duplicates(spark.createDataFrame([], DDL)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(2)
    long = " ".join(rng.choices([f"w{i}" for i in range(3000)], k=150_000))
    got = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 1_000_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in simhash.near_duplicates(got).collect()}
    assert found[2].component_id == 1 and found[1].fingerprint == f"{plain(long):016x}" and found[3].component_id == 3


def test_keep_one(spark):
    text = "one two three four five"
    rows = [(7, text, "b"), (7, text, "a"), (None, text, "c"), (None, "alone alone", "z"), (None, "alone alone", "y"), (9, "else where", "k"), (8, None, "n"), (4, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ string").withColumn("__u", F.lit(1)).withColumn("__w", F.lit(2)).withColumn("__fp", F.lit(3))
    for _ in range(2):
        kept = simhash.keep_one(docs.repartition(3))
        assert kept.columns == docs.columns
        assert sorted((tuple(r)[:3] for r in kept.collect()), key=str) == sorted([(7, text, "a"), (None, "alone alone", "y"), (9, "else where", "k"), (4, "", "e")], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0
