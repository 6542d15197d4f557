import math

import numpy as np
import public_tokenizers
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = pieces.Model(PATH)
PARTS = ["the", " ", "  ", "   ", "\n", "\t", "internationalisation", "é", "é", "日本語", "Ａ", "…", "12345", "a​b", "\x00", "🙂", "x" * 60, "réeuxment", ".", "<s>", "<0x0A>"]
texts = st.lists(st.sampled_from(PARTS), max_size=12).map("".join)


def encoded(text, seed=1, dropout=0.0, doc_id=5):
    return np.frombuffer(pieces.Encoder(MODEL, seed, dropout, 4).encode([doc_id], [text])[0], "<u4").tolist()


@settings(max_examples=600, deadline=None)
@given(texts)
def test_without_dropout_ids_are_the_library_s(text):
    assert encoded(text) == LIBRARY.encode(text)


@settings(max_examples=400, deadline=None)
@given(st.one_of(texts, st.text(max_size=30), st.just("▁ ▁a")), st.sampled_from([0.1, 0.5, 1.0]), st.integers(0, 99))
def test_any_dropout_decodes_losslessly(text, dropout, seed):
    ids = encoded(text, seed, dropout)
    assert MODEL.decode(ids) == text and ids == encoded(text, seed, dropout)


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5), st.sampled_from([0.0, 0.2, 0.6]), st.integers(0, 2**64 - 1))
def test_rounds_and_heap_agree(parts, dropout, key):
    keys = np.full(len(parts), key, np.uint64)
    together = [np.frombuffer(x, "<u4").tolist() for x in MODEL._together([p[:48] for p in parts], keys, dropout)]
    assert together == [MODEL.by_heap(p[:48], key, dropout).tolist() for p in parts]


def test_dropout_varies_with_seed_and_place():
    text = "internationalisation " * 8
    assert len({tuple(encoded(text, s, 0.3)) for s in range(10)}) > 5
    assert len(encoded(text, 1, 1.0)) > len(encoded(text, 1, 0.3)) > len(encoded(text))
    counts = [len(encoded("internationalisation", s, 0.1)) for s in range(300)]
    assert 1 < np.mean(np.array(counts) > min(counts)) * 10 < 8


def test_frames(spark):
    rows = [(1, "hello  wörld\n▁x", "a"), (2, "", "b"), (3, None, None), (None, "no id", ""), (1, "again " * 30_000, ""), (4, "z" * 30_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = pieces.encode(docs, PATH).collect()
    assert len(coded) == len(rows) and all(r.lossless and r.n_tokens == len(r.ids) for r in coded)
    back = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert pieces.encode(docs.limit(0), PATH).count() == 0


def test_every_occurrence_has_a_segmentation_of_its_own():
    text = "internationalisation " * 400
    ids = np.frombuffer(pieces.Encoder(MODEL, 1, 0.1).encode([5], [text])[0], "<u4").tolist()
    forms = {tuple(x) for x in _by_word(ids, "internationalisation", 400)}
    assert len(forms) > 8
    encoder = pieces.Encoder(MODEL, 1, 0.1)
    assert len(set(encoder.encode(list(range(400)), [" unthinkable"] * 400))) > 8
    assert encoder.encode([3], [" unthinkable"]) == pieces.Encoder(MODEL, 1, 0.1).encode([3], [" unthinkable"])


def _by_word(ids, word, n):
    words, at = [[]], 0
    for k in ids:
        if at == len(word) + 1:
            words.append([])
            at = 0
        words[-1].append(k)
        at += len(MODEL.bytes_of[k])
    return words[:n]


def test_trees_give_what_the_heap_gives(monkeypatch):
    monkeypatch.setattr(MODEL, "segment", lambda chunks, keys, dropout: [MODEL.by_heap(c, int(k), dropout).astype("<u4").tobytes() for c, k in zip(chunks, keys, strict=True)])
    words = "the international réunion of unthinkable things, 12345 日本 and again".split(" ")
    texts = [" ".join(words[(k * j) % len(words)] for j in range(60)) for k in range(80)]
    for dropout in (0.0, 0.1, 0.5):
        warm = pieces.Encoder(MODEL, 7, dropout)
        for _ in range(2):
            coded = warm.encode(list(range(80)), texts)
        heap = [pieces.Encoder(MODEL, 7, dropout).encode([k], [t])[0] for k, t in enumerate(texts)]
        monkeypatch.setattr(pieces, "_TREE", -1)
        assert coded == heap == [pieces.Encoder(MODEL, 7, dropout).encode([k], [t])[0] for k, t in enumerate(texts)]
        monkeypatch.setattr(pieces, "_TREE", 24)


M1, M2, M3, TOP = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1
VOCABULARY = {LIBRARY.id_to_piece(k): (LIBRARY.get_score(k), k) for k in range(LIBRARY.get_piece_size()) if not (LIBRARY.is_byte(k) or LIBRARY.is_control(k) or LIBRARY.is_unknown(k) or LIBRARY.is_unused(k))}


def plain(text, seed, doc_id, dropout):
    """Merge-dropout as the module states it: all pairs are looked at before every merge."""
    chunks, before = [], ""
    for c in " " + text if text else "":
        if not chunks or c == "\n" or c == " " and before != " ":
            chunks.append("")
        chunks[-1] += c
        before = c
    document = xxhash.xxh64_intdigest(text, xxhash.xxh64_intdigest(f"{seed}:{doc_id}"))
    ids = []
    for n, chunk in enumerate(chunks, 1):
        key = n * M1 + document & TOP
        key = (key ^ key >> 30) * M2 & TOP
        key = (key ^ key >> 27) * M3 & TOP
        key ^= key >> 31
        spelled = [("▁" if c == " " else None if c == "▁" else c, k, k + 1, c) for k, c in enumerate(chunk)]
        symbols = [(p if p in VOCABULARY else None, a, b, c) for p, a, b, c in spelled]
        while True:
            able = []
            for i, ((p, a, m, _), (q, _, b, _)) in enumerate(zip(symbols, symbols[1:])):
                h = ((a << 42 | m << 21 | b) * M1 & TOP ^ key) * M2 & TOP
                h = (h ^ h >> 31) * M3 & TOP
                if p and q and p + q in VOCABULARY and h >> 11 >= math.ceil(dropout * 2**53):
                    able.append((-VOCABULARY[p + q][0], i))
            if not able:
                break
            i = min(able)[1]
            symbols[i : i + 2] = [(symbols[i][0] + symbols[i + 1][0], symbols[i][1], symbols[i + 1][2], "")]
        for p, _, _, c in symbols:
            ids += [VOCABULARY[p][1]] if p else [LIBRARY.piece_to_id(f"<0x{b:02X}>") for b in c.encode()]
    return ids


@settings(max_examples=150, deadline=None)
@given(st.one_of(texts, st.text(max_size=20), st.just("▁ ▁a")), st.sampled_from([0.0, 0.1, 0.5, 0.9]), st.integers(0, 9))
def test_dropout_matches_a_plain_agenda(text, dropout, seed):
    assert encoded(text, seed, dropout) == plain(text, seed, 5, dropout)
    again = pieces.Encoder(MODEL, seed, dropout)
    for _ in range(3):  # the third time words come from the trees
        coded = again.encode([5] * 9, [text] * 9)
    assert np.frombuffer(coded[4], "<u4").tolist() == plain(text, seed, 5, dropout)
