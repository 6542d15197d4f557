import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORDS = token_files.WordCache(PATH, 2)


def plain(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\t", "don't", "é", "12", "...", "日本", " ", "<|endoftext|>", "'s", "x_y", "dog.", "so,,", "$", "(a)", "_.", "5.", "²!", "'", " ", "\r\n"]), max_size=9))
def test_words_encode_like_whole_texts(parts):
    text = "".join(parts)
    texts = ["pad it", text, None, text, "pad"]
    ids, n = WORDS.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [plain(t) for t in texts]


def test_words_are_forgotten_and_learnt_again():
    words = token_files.WordCache(PATH, 2, limit=3)
    for texts in (["one two three four"], ["one five six,"], ["seven eight nine ten"], ["one two, five.", " odd  spaces "], ["six"]):
        ids, n = words.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [plain(t) for t in texts]
    assert len(words.known) + len(words.old) < 14


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_planes_round_trip(planes):
    rng = np.random.default_rng(2)
    for ids in (np.arange(1), rng.integers(0, 50257, 65536), rng.integers(0, 1 << 32, 999, dtype=np.uint64), np.zeros(8, int)):
        ids = ids.astype("<u4")
        sizes, data = token_files.pack(ids, planes)
        assert np.array_equal(token_files.unpack(data, sizes, len(ids), planes), ids)


def test_round_trip(spark, monkeypatch):
    texts = ["a b c", "", None, "hello  world\n", "word " * 90_000, "é ü", "a b c"] * 3
    rows = [(100 - k, t, "x", k) for k, t in enumerate(texts)] + [(7, "tie", "", 0), (7, "also tie", "", 0), (None, "no id", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")
    files = token_files.write(docs, token_files.new_path(spark, "t"), lambda: token_files.encoder_of(PATH, 2), rows_per_file=6)
    assert len(files) > 2
    got = token_files.read(spark, files).collect()
    expected, at = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain(t)
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected
    assert token_files.round_trip(docs, PATH).count() == len(rows)
    assert token_files.round_trip(docs.limit(0), PATH).count() == 0
