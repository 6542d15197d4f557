import re

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import decontaminate, pieces, simhash
from tests.llm.test_secrets import PATTERNS, plain

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "t")
        assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    clean, single, unleaked, redacted = kept
    assert len(toxic - clean.keys()) >= 0.8 * len(toxic) and len(texts.keys() - clean.keys() - toxic) < 0.1 * len(texts)
    fp = {i: simhash.fingerprint(r.text.encode()) for i, r in clean.items()}
    label = {i: i for i in fp}
    for a in sorted(fp):
        for b in sorted(fp):
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    assert single.keys() == {min(i for i in label if label[i] == x) for x in set(label.values())}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = {i: " ".join(decontaminate.words(r.text)) for i, r in single.items()}
    leaked = {i for i, w in words.items() if any(" ".join(decontaminate.words(t)) in w for _, t in items)}
    assert unleaked.keys() == single.keys() - leaked
    for i, r in redacted.items():
        before = unleaked[i].text
        assert (r.text == before) == (not plain(before)) and r.n_chars == (len(r.text) if r.text != before else unleaked[i].n_chars)
        assert not any(m for p in (PATTERNS["github"], PATTERNS["pem"]) for m in re.findall(p, r.text))
    coded = corpus_pipeline.encode(spark, docs, SF)
    assert all(r.lossless for r in coded.collect())
    back = {r.doc_id: r.text for r in pieces.decode(coded, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert back == {i: r.text for i, r in redacted.items()}


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_crc32", "lossless", "ids"] and rows.count() > 100


def test_odd_rows_through_all_stages(spark, tmp_path):
    item = "which of the seven old harbours lies furthest north of the grey island? the harbour of the two white towers does so."
    long = "quiet words about rivers and " + " ".join(f"stone{k % 977} river{k % 1013}" for k in range(60_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "nobody knows this row at all", None, None, None), (None, "nobody knows this row at all", None, None, None),
        (4, long, "en", "b", None), (5, f"before it. {item} and behind", "en", "b", 1), (6, "the key is password = 'hunter22' they said to us", "en", "c", 48),
        (7, "one two three four five six", "en", "c", 27), (7, "one two three four five six", "en", "c", 27), (8, "ONE two three four five six", "de", "c", 27), (9, "idiot trash idiot trash", "en", "c", 23),
    ]
    # too few labels to learn a word from: nothing is toxic
    rows += [(k, " ".join(f"filler{k * 37 % 101}x{j}" for j in range(12)), "en", "d", None) for k in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("fp", "score", "__w", "_", "is_toxic", "spans", "item_id"):
        docs = docs.withColumn(c, F.lit("kept"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(100, 130)] + [(9, 0, 1), (7, 1, 0), (6, None, 0), (None, 1, 1), (4, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialise(stage(spark, at, str(tmp_path)), "odd")
        assert at.columns == docs.columns and {r.fp for r in at.collect()} == {"kept"}
    left = sorted((r.doc_id or 0, r.text) for r in at.collect() if (r.doc_id or 0) < 7)
    assert {r.doc_id for r in at.collect() if (r.doc_id or 0) >= 7} == {7, 9, *range(100, 130)}
    # 7 and 8 are alike, 1 and 2 are both without words
    assert left == [(0, "nobody knows this row at all"), (1, None), (4, long), (6, "the key is [ASSIGN]' they said to us")]
    coded = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(coded) == at.count() and all(r.lossless for r in coded)
    assert {r.doc_id: r.n_tokens for r in coded}[1] == 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
