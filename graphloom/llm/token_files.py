"""Token ids on disk: blocks of ids as compressed bit or byte planes, with a chunk index.

A file holds the documents of one range of doc_id, in order. Their ids run through fixed-size chunks; a chunk's
uint32 ids are transposed into byte planes (or bit planes), each plane is compressed with zstandard, and planes of
zeros take no room. The footer holds the chunk index and the documents' ids and lengths, so a reader can seek to any
chunk and cut documents without reading others.

    "GLTOK001" | planes of chunk 0 | planes of chunk 1 ... | footer (JSON, zstandard) | its length (8 bytes) | "GLTOK001"

Writing: one shuffle deals the documents to ranges of doc_id (``rows_per_file`` rows a file); each task sorts its
range on disk if need be, encodes it in bounded slices and streams the file. Where a file's ids start among all ids
follows from the files' totals, a short list. Texts are split at single spaces and line breaks that precede a
word: those are always token boundaries of a byte-level BPE with the usual pattern, so each distinct word is encoded
once per worker by the library and its ids are reused. Texts with runs of white space, or with any at an end, are
encoded whole.

Nulls and odd rows: a null text is empty and holds the end id alone. Rows with a null doc_id come first. Repeated
doc_ids are kept, ordered by text. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm.files import make_dir, opened
from graphloom.scratch import new_path

MAGIC = b"GLTOK001"
CHUNK_IDS = 1 << 16
_SLICE_BYTES = 4_000_000
_GATHER = 1 << 18
_RUN_OF_SPACE = re.compile(r"\s\s")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_BLANK = {"", "\n", "\n\n"}
#: Without the apostrophe, which can begin a token with letters.
_PUNCTUATION = "".join(sorted(set(string.punctuation) - {"'"}))


#: Stands for the ids of a word that is no token boundary's neighbour, so that its text is encoded whole.
_ODD = b"?"


class WordCache:
    """Encodes texts with a byte-level BPE, each distinct word once.

    A word's key is the word itself if a space precedes it, a line break and the word if a line break does, and two and the
    word if it begins a text. Words live for two generations of ``limit``: one that is met in its second is kept.
    """

    def __init__(self, path: str, end_id: int, limit: int = 350_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], "<u4").tobytes()
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words, from one call: joined by line breaks, which stay tokens of their own."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.line)
        if len(cuts) != len(words) - 1:
            return self._encode(words)
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)]

    def _remembered(self, new: set[str]) -> set[str]:
        """Take words over from the generation before; those that it lacks."""
        again = new & self.old.keys()
        self.known.update((w, self.old[w]) for w in again)
        return new - again

    def _learn(self, new: set[str]) -> None:
        """Add words; one that ends in punctuation behind a letter is learnt as two tokens' worth, so that a word is
        encoded once whatever follows it."""
        new = self._remembered(new)
        strange = {w for w in (new if _OTHER_SPACE.search(" ".join(new)) else new & _BLANK) if not (core := w.lstrip("\n")) or core[0].isspace() or core[-1].isspace() or _RUN_OF_SPACE.search(core)}
        self.known.update(dict.fromkeys(strange, _ODD))
        new -= strange
        cut = {w: core for w in new if (core := w.rstrip(_PUNCTUATION)) is not w and core[-1:].isalpha() and "<|" not in w}
        whole = {w for w in new if w not in cut} | self._remembered({c for c in cut.values() if c not in self.known})
        tails = sorted({w[len(c) :] for w, c in cut.items()} - self.tails.keys())
        self.tails.update(zip(tails, self._encode(tails), strict=True))
        line = np.array([self.line], "<u4").tobytes()
        plain = [w for w in whole if "<|" not in w]
        bare = [w.startswith("\n") for w in plain]
        coded = self._encode_words([w.lstrip("\n") if b else f" {w}" for w, b in zip(plain, bare, strict=True)])
        for w, b, ids in zip(plain, bare, coded, strict=True):
            self.known[w] = line + ids if b and w[1:2] != "\n" else ids
        odd = [w for w in whole if "<|" in w]
        self.known.update(zip(odd, self._encode([w[2:] if w.startswith("\n\n") else w if w[0] == "\n" else f" {w}" for w in odd]), strict=True))
        for w, c in cut.items():
            self.known[w] = self.known[c] + self.tails[w[len(c) :]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id last, and how many each has."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(pc.binary_join_element_wise("\n\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        coded = lists.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(), _strings(coded.dictionary)
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
            self.tails.clear()
        self._learn(set(words).difference(self.known))
        found = [self.known[w] for w in words]
        odd = np.fromiter((x is _ODD for x in found), bool, len(found))
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        whole = np.zeros(len(texts), bool)
        if odd.any():
            hits = np.searchsorted(ends, np.flatnonzero(odd[code]), "right")
            whole[hits] = True
            code = code[~np.repeat(whole, np.diff(ends, prepend=0))]
            ends = np.cumsum(np.where(whole, 0, np.diff(ends, prepend=0)))
        # behind the words stand the end id and the texts that are encoded whole
        alone = self._encode(texts.filter(pa.array(whole)).to_pylist()) if whole.any() else []
        n = len(found)
        found += [self.end, *alone]
        last = np.repeat(ends, 1 + whole)
        marks = np.full(len(last), n)
        marks[np.cumsum(1 + whole)[whole] - 2] = n + 1 + np.arange(len(alone))
        code = np.insert(code, last, marks)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(x if x is not _ODD else b"" for x in found), "<u4")
        start = np.cumsum(size) - size
        upto = np.cumsum(size[code])
        ids = np.empty(upto[-1] if len(upto) else 0, "<u4")
        for at in range(0, len(code), _GATHER):
            some = code[at : at + _GATHER]
            per = size[some]
            stop = np.cumsum(per)
            begin = upto[at] - per[0]
            ids[begin : begin + stop[-1]] = pool[np.repeat(start[some] - stop + per, per) + np.arange(stop[-1])]
        return ids, np.diff(upto[np.cumsum(np.diff(ends, prepend=0) + 1 + whole) - 1], prepend=0)


def _strings(words: pa.Array) -> list[str]:
    """The values of a column of texts, by way of one long one, which is faster."""
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\0")[0].as_py() if len(words) else ""
    found = joined.split("\0") if len(words) else []
    return found if len(found) == len(words) else words.to_pylist()


def pack(ids: np.ndarray, planes: str, level: int = 3) -> tuple[list[int], bytes]:
    """The compressed sizes of a chunk's planes, high one first, and their bytes."""
    raw = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    rows = np.packbits(np.unpackbits(raw, axis=1).T.copy(), axis=1) if planes == "bit" else raw.T.copy()
    packer = zstandard.ZstdCompressor(level=level)
    parts = [packer.compress(r.tobytes()) if r.any() else b"" for r in rows]
    return [len(p) for p in parts], b"".join(parts)


def unpack(data: bytes, sizes: list[int], n: int, planes: str) -> np.ndarray:
    """The ids of a chunk."""
    width = (n + 7) // 8 if planes == "bit" else n
    rows, at = np.zeros((len(sizes), width), np.uint8), 0
    for row, size in zip(rows, sizes, strict=True):
        if size:
            row[:] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size]), np.uint8)
        at += size
    if planes == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n).T.copy(), axis=1)
    else:
        rows = rows.T.copy()
    return rows.reshape(-1).view(">u4").astype("<u4")


class FileWriter:
    """Streams documents into one file."""

    def __init__(self, uri: str, planes: str) -> None:
        fs, path = opened(uri)
        self.sink, self.planes = fs.open_output_stream(path, compression=None), planes
        self.sink.write(MAGIC)
        self.held, self.size = [], 0
        self.chunks: list[list] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents, their ids one after another."""
        self.ids += doc_ids
        self.lengths += lengths.tolist()
        self.held.append(ids.tobytes())
        self.size += 4 * len(ids)
        if self.size >= 4 * CHUNK_IDS * 4:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.held)
        to = len(data) if last else len(data) // (4 * CHUNK_IDS) * 4 * CHUNK_IDS
        for at in range(0, to, 4 * CHUNK_IDS):
            ids = np.frombuffer(data[at : min(to, at + 4 * CHUNK_IDS)], "<u4")
            sizes, packed = pack(ids, self.planes)
            self.chunks.append([self.sink.tell(), len(ids), sizes])
            self.sink.write(packed)
        self.held, self.size = [data[to:]], len(data) - to

    def close(self) -> tuple[int, int]:
        """(ids, documents) written."""
        self._flush(True)
        footer = zstandard.compress(json.dumps({"planes": self.planes, "chunks": self.chunks, "doc_ids": self.ids, "lengths": self.lengths}).encode())
        self.sink.write(footer + struct.pack("<q", len(footer)) + MAGIC)
        self.sink.close()
        return sum(self.lengths), len(self.lengths)


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a file's documents, in order."""
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        if tail[8:] != MAGIC or f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        (length,) = struct.unpack("<q", tail[:8])
        footer = json.loads(zstandard.decompress(f.read_at(length, size - 16 - length)))
        chunks = iter(footer["chunks"])
        held = np.empty(0, "<u4")
        for doc_id, n in zip(footer["doc_ids"], footer["lengths"], strict=True):
            parts, have = [held], len(held)
            while have < n:
                at, count, sizes = next(chunks)
                parts.append(unpack(f.read_at(sum(sizes), at), sizes, count, footer["planes"]))
                have += count
            data = np.concatenate(parts) if len(parts) > 1 else held
            held = data[n:]
            yield doc_id, data[:n]


def slices(texts: pa.Array, most_bytes: int = _SLICE_BYTES) -> Iterator[slice]:
    """Runs of texts of at most so many bytes, or of one text."""
    at = size = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if k > at and size + n > most_bytes:
            yield slice(at, k)
            at, size = k, 0
        size += n
    if len(texts):
        yield slice(at, len(texts))


def write(
    docs: DataFrame, out: str, encoder: Callable[[], WordCache], id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 8192, planes: str = "byte"
) -> list[tuple[str, int, int]]:
    """Write the documents under ``out``; (file, ids, documents) in ascending order of doc_id."""
    make_dir(out)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    files = max(1, -(-named.count() // rows_per_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, writer, words = f"{out}/ids-{uuid.uuid4().hex}.tok", None, None
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            words = words or encoder()
            writer = writer or FileWriter(uri, planes)
            for part in slices(texts):
                writer.add(ids[part], *words.encode(texts[part]))
        if writer:
            n, rows = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [uri], "n": [n], "docs": [rows]})

    dealt = named.repartitionByRange(files, *order[:2]).sortWithinPartitions(*order)
    done = dealt.mapInArrow(run, "part long, path string, n long, docs long").collect()
    return [(r.path, r.n, r.docs) for r in sorted(done, key=lambda r: r.part)]


def read(spark: SparkSession, files: list[tuple[str, int, int]], with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, and its ids (null if ``with_ids`` is off)."""
    starts = np.cumsum([0, *(n for _, n, _ in files)]).tolist()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, held = [], 0
                for doc_id, ids in read_file(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32) if with_ids else None))
                    start += len(ids)
                    held += len(ids) if with_ids else 1
                    if held > 1_000_000:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                yield _batch(rows, schema)

    table = spark.createDataFrame([(p, s) for (p, _, _), s in zip(files, starts, strict=False)], "path string, start long")
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"
    return table.repartition(max(1, len(files))).mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_ENCODERS: dict[tuple[str, int], WordCache] = {}


def encoder_of(path: str, end_id: int) -> WordCache:
    """The worker's encoder of a vocabulary file."""
    key = (path, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordCache(path, end_id)
    return _ENCODERS[key]


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids to a fresh folder and read them back: a digest of each document's ids."""
    spark = docs.sparkSession
    files = write(docs, new_path(spark, "token-ids"), lambda: encoder_of(tokenizer, end_id))
    return read(spark, files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
