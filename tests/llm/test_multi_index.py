import numpy as np

from graphloom.llm import multi_index

SF = "/root/testdata/sf0.1/embeddings.parquet"


def exact(ids, x, k=10):
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [n for n in np.lexsort((ids, d)) if ids[n] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[n]), float(d[n])) for n in order]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_recall_on_the_table(spark):
    rows = spark.read.parquet(SF)
    local = rows.orderBy("vec_id").toPandas()
    truth = exact(local.vec_id.to_numpy(), np.stack(local.embedding).astype(float))
    got = found(multi_index.search(rows, rows.where("vec_id % 100 = 0")))
    hits = [len({i for i, _ in got[q]} & {i for i, _ in t}) / len(t) for q, t in truth.items()]
    print("recall", np.mean(hits))
    assert got.keys() == truth.keys() and np.mean(hits) >= 0.9
    assert all(len(v) == 10 for v in got.values())


def test_whole_scan_is_exact_with_ties_and_blocks(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(300, 7)), np.tile(rng.normal(size=(1, 7)), (250, 1))]).astype(np.float32)
    rows = [(k, [float(c) for c in v], "label") for k, v in enumerate(x)]
    bad = [(1000, None, ""), (1100, [0.0] * 7, ""), (1200, [1.0, None] + [0.0] * 5, ""), (1300, [float("nan")] * 7, ""), (1400, [float("inf")] * 7, ""), (1500, [1.0] * 3, ""), (None, [1.0] * 7, "")]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank string")
    got = found(multi_index.search(frame, frame.where("vec_id % 100 = 0"), centroids=5, scan_share=1.0, block_rows=20))
    truth = exact(np.arange(550), x.astype(float))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in truth.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in truth[q]], atol=1e-12) for q in truth)


def test_few_rows_repeats_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert found(multi_index.search(frame, frame.where("vec_id = 0"))) == {0: [(2, 1.0), (1, 2**0.5)]}
    assert multi_index.search(frame.limit(0), frame.limit(0)).count() == 0


def test_queries_of_another_length_take_no_part(spark):
    rows = [(k, [float(k), 1.0, 2.0, 3.0]) for k in range(1, 30)] + [(100, [1.0, 2.0]), (200, [3.0, 4.0]), (300, [5.5, 1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(multi_index.search(frame, frame.where("vec_id % 100 = 0")))
    assert got.keys() == {300} and [i for i, _ in got[300]][:2] == [5, 6]


def test_an_id_repeated_more_often_than_k(spark):
    rows = [(0, [0.0, 1.0])] + [(7, [0.01 * j, 1.0]) for j in range(1, 60)] + [(k, [float(k), 1.0]) for k in range(10, 40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(multi_index.search(frame, frame.where("vec_id = 0"), scan_share=1.0))
    assert [i for i, _ in got[0]] == [7, *range(10, 19)]


def test_walk_is_ordered_and_complete():
    rng = np.random.default_rng(0)
    a, b, n = rng.random(6), rng.random(5), rng.integers(0, 3, (6, 5))
    cells = multi_index.walk(a, b, n, 10**9)
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and set(cells) == set(zip(*map(list, np.nonzero(n)), strict=True))
