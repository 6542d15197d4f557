"""SentencePiece BPE with seeded merge-dropout, and its decoder.

A text gets the dummy space in front and is cut into chunks, runs of spaces or a line break with what follows; no
piece of the model spans two chunks, so chunks are segmented alone. In a chunk the agenda holds the adjacent pairs that
form a piece; the best score, leftmost on ties, is merged first. A candidate is skipped for good if the keyed hash of
(seed, document, place of the chunk in it, start, middle, end) falls below ``dropout``, so every occurrence of a word
has a segmentation of its own, the same on every run. With dropout 0 the ids are those of the library.

A worker remembers what does not depend on the hash, as a tree for each word it meets often: a node holds the ids if
none of its candidates is skipped, and a branch for each candidate that may be the first one skipped. Occurrences walk
the trees together in numpy; one that finds no branch is merged by itself. Both ways give the same ids.

Many new chunks are merged together in numpy, a round of the agenda for all of them at a time; a chunk of over
``_LONG`` code points has a heap of its own, so very long words take n log n steps.

Decoding joins the pieces' bytes and takes the dummy space off. It gives back every text exactly: code points without
a piece are spelled in bytes, and so is a literal U+2581, which the library would turn into a space.

Nulls and odd rows: a null text is encoded as an empty one, to no ids. A null doc_id counts as 0 in the hash.
A document's id and text are hashed, so repeated rows are encoded each, alike. A very long text is encoded whole, alone in its slice. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.hashed_text import slices

CHUNK = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")
SPACE = "▁"
_LONG = 48
_TREE = 24
_VISITS = 8
_NONE = np.int64(1) << 62


_M1, _M2, _M3, _ALL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1


def dropped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate merges are skipped, by a hash of the chunk's key and the places in it."""
    return _dropped(key, start.astype(np.uint64) << np.uint64(42) | middle.astype(np.uint64) << np.uint64(21) | end.astype(np.uint64), dropout)


def _dropped(key: np.ndarray, place: np.ndarray, dropout: float) -> np.ndarray:
    if dropout <= 0:
        return np.zeros(len(key), bool)
    h = place * np.uint64(_M1)
    h ^= key
    h *= np.uint64(_M2)
    h ^= h >> np.uint64(31)
    h *= np.uint64(_M3)
    h >>= np.uint64(11)
    return h < np.uint64(math.ceil(dropout * 2.0**53))


def _drops(key: int, dropout: float) -> Callable[[int], bool]:
    """``_dropped`` for one key, a place at a time."""
    below = math.ceil(dropout * 2.0**53)

    def drop(place: int) -> bool:
        h = (key ^ place * _M1 & _ALL) * _M2 & _ALL
        return ((h ^ h >> 31) * _M3 & _ALL) >> 11 < below

    return drop


class Model:
    """The pieces of a SentencePiece BPE model, and which pairs of them merge."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = [b""] * n
        whole: dict[str, int] = {}
        for k in range(n):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte_ids[int(piece[3:-1], 16)] = k
                self.bytes_of[k] = bytes([int(piece[3:-1], 16)])
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                whole[piece] = k
                self.bytes_of[k] = piece.replace(SPACE, " ").encode()
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in whole):
            raise ValueError("a piece of this model spans chunks")
        self.letters = {(" " if p == SPACE else p): k for p, k in whole.items() if len(p) == 1}
        self.letters |= {chr(c): int(self.byte_ids[c]) for c in range(128) if chr(c) not in self.letters}
        self.of_point = -1 - np.arange(0x110000)
        self.of_point[[ord(c) for c in self.letters]] = list(self.letters.values())
        # lower rank merges first
        order = sorted(whole.values(), key=lambda k: (-sp.get_score(k), k))
        scores = {k: sp.get_score(k) for k in order}
        self.rank = np.zeros(n, np.int64)
        rank, last = -1, None
        for k in order:
            rank += scores[k] != last
            last = scores[k]
            self.rank[k] = rank
        self.merged = {(whole[p[:c]], whole[p[c:]]): k for p, k in whole.items() for c in range(1, len(p)) if p[:c] in whole and p[c:] in whole}
        self._table(np.array([a << 32 | b for a, b in self.merged]), np.array(list(self.merged.values())))

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressed table from pairs to pieces, at most an eighth full."""
        self.bits = max(4, int(len(keys) * 8 - 1).bit_length())
        self.slots, self.found = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slots[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.slots[at[put]], self.found[at[put]] = keys[todo[put]], values[todo[put]]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1. Negative symbols never merge."""
        keys = np.where((a < 0) | (b < 0), np.int64(-2), a << 32 | b)
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            slot = self.slots[at[open_]]
            hit = slot == keys[open_]
            out[open_[hit]] = self.found[at[open_[hit]]]
            open_ = open_[~hit & (slot != -1)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def symbols(self, chunk: str) -> list[int]:
        """The letters' pieces; -1 - code point where there is none."""
        get = self.letters.get
        return [get(c, -1 - ord(c)) for c in chunk]

    def spelled(self, ids: list[int]) -> np.ndarray:
        out: list[int] = []
        for k in ids:
            out += [k] if k >= 0 else self.byte_ids[list(chr(-1 - k).encode())].tolist()
        return np.array(out, np.int64)

    def by_heap(self, chunk: str, key: int, dropout: float) -> np.ndarray:
        """One chunk's ids, with an agenda of its own."""
        return self.merge(chunk, _drops(key, dropout))

    def merge(self, chunk: str, drop: Callable[[int], bool]) -> np.ndarray:
        """One chunk's ids; ``drop`` is asked of every candidate, by its place, once."""
        ids = self.symbols(chunk)
        n = len(ids)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []
        merged, rank = self.merged, self.rank

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if j < n and (to := merged.get((ids[i], ids[j]))) is not None and not drop(i << 42 | j << 21 | end[j]):
                heapq.heappush(agenda, (int(rank[to]), i, j, end[j], to))

        for i in range(n - 1):
            offer(i)
        alive = [True] * n
        while agenda:
            _, i, j, stop, to = heapq.heappop(agenda)
            if not (alive[i] and j < n and alive[j] and after[i] == j and end[j] == stop):
                continue
            ids[i], end[i], alive[j] = to, stop, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return self.spelled([k for k, a in zip(ids, alive, strict=True) if a])

    def segment(self, chunks: list[str], keys: np.ndarray, dropout: float) -> list[bytes]:
        """The ids of each chunk, as little-endian uint32."""
        out: list[bytes] = [b""] * len(chunks)
        short = []
        for k, c in enumerate(chunks):
            if len(c) > _LONG:
                out[k] = self.by_heap(c, int(keys[k]), dropout).astype("<u4").tobytes()
            else:
                short.append(k)
        for at in range(0, len(short), 50_000):
            part = short[at : at + 50_000]
            for k, ids in zip(part, self._together([chunks[k] for k in part], keys[part], dropout), strict=True):
                out[k] = ids
        return out

    def _together(self, chunks: list[str], keys: np.ndarray, dropout: float) -> list[bytes]:
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbol = self.of_point[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")]
        owner = np.repeat(np.arange(len(chunks)), sizes)
        start = np.arange(len(symbol)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        end = start + 1
        # what each symbol merges to with the next one, -1 for nothing; asked again only beside a merge
        to = np.full(len(symbol), -1, np.int64)

        def offer(at: np.ndarray) -> None:
            at = at[owner[at] == owner[at + 1]]
            found = self.pair(symbol[at], symbol[at + 1])
            at, found = at[found >= 0], found[found >= 0]
            good = ~dropped(keys[owner[at]], start[at], start[at + 1], end[at + 1], dropout)
            to[at[good]] = found[good]

        offer(np.arange(len(symbol) - 1))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            able = np.flatnonzero(to >= 0)
            # the best candidate of each chunk: by rank, then from the left
            cost = self.rank[to[able]] << 32 | np.arange(len(able))
            of = owner[able]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.empty(0, np.int64)
            best = np.minimum.reduceat(cost, first) & 0xFFFFFFFF if len(first) else first
            busy = np.zeros(len(chunks), bool)
            busy[of] = True
            idle = ~busy[owner]
            done.append((owner[idle], symbol[idle]))
            left = able[best]
            symbol[left], end[left] = to[left], end[left + 1]
            to[left] = to[np.maximum(left - 1, 0)] = -1
            keep = ~idle
            keep[left + 1] = False
            place = np.cumsum(keep) - 1
            symbol, owner, start, end, to = symbol[keep], owner[keep], start[keep], end[keep], to[keep]
            at = place[left]
            beside = np.concatenate([at, at - 1])
            offer(beside[(beside >= 0) & (beside + 1 < len(symbol))])
        owner, symbol = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, np.int64),) * 2
        order = np.argsort(owner, kind="stable")
        owner, symbol = owner[order], symbol[order]
        if (symbol < 0).any():
            spelled = [self.byte_ids[list(chr(-1 - k).encode())] if k < 0 else np.array([k]) for k in symbol.tolist()]
            owner = np.repeat(owner, [len(x) for x in spelled])
            symbol = np.concatenate(spelled)
        data = symbol.astype("<u4").tobytes()
        cuts = (np.searchsorted(owner, np.arange(len(chunks) + 1)) * 4).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        """The text that the ids spell."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode()


@dataclass
class Encoder:
    """Encodes documents; remembers the trees of at most about ``limit`` nodes."""

    model: Model
    seed: int
    dropout: float
    limit: int = 250_000

    def __post_init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        # node 0 stands for none
        self.roots: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        self.ids: list[bytes] = [b""]
        self.from_: list[tuple[str, tuple[int, ...], int]] = [("", (), 0)]
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        # of every candidate: its place, and the node if it is skipped; 0 and less are visits without one
        self.place, self.child, self.used = np.zeros(8192, np.uint64), np.zeros(8192, np.int64), 0

    def _add(self, chunk: str, skipped: tuple[int, ...], base: int) -> int:
        """A node: of the chunk's candidates the first ``base`` are decided, those in ``skipped`` against."""
        places: list[int] = []

        def drop(place: int) -> bool:
            places.append(place)
            return place in skipped

        ids = self.model.merge(chunk, drop)
        node, own = len(self.ids), places[base:]
        if node == len(self.first):
            self.first, self.size = np.resize(self.first, 2 * node), np.resize(self.size, 2 * node)
        while self.used + len(own) > len(self.place):
            n = len(self.place)
            self.place, self.child = np.resize(self.place, 2 * n), np.concatenate([self.child, np.zeros(n, np.int64)])
        self.first[node], self.size[node] = self.used, len(own)
        self.place[self.used : self.used + len(own)] = own
        self.used += len(own)
        self.ids.append(ids.astype("<u4").tobytes())
        self.from_.append((chunk, skipped, base))
        return node

    def _walk(self, node: np.ndarray, keys: np.ndarray, at: np.ndarray) -> None:
        """Moves the occurrences ``at`` to the nodes whose ids they have, or to 0."""
        while len(at):
            first, size = self.first[node[at]], self.size[node[at]]
            edge = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
            hit = np.flatnonzero(_dropped(np.repeat(keys[at], size), self.place[edge], self.dropout))
            owner = np.searchsorted(np.cumsum(size), hit, side="right")
            fresh = np.ones(len(hit), bool)
            fresh[1:] = owner[1:] != owner[:-1]
            edge, at = edge[hit[fresh]], at[owner[fresh]]
            to = self.child[edge]
            for k in np.flatnonzero(to <= 0).tolist():
                e = edge[k]
                if -_VISITS + 1 < self.child[e] <= 0:
                    self.child[e] -= 1
                elif self.child[e] < 0:
                    up = int(node[at[k]])
                    chunk, skipped, base = self.from_[up]
                    self.child[e] = self._add(chunk, (*skipped, int(self.place[e])), base + int(e - self.first[up]) + 1)
                to[k] = max(self.child[e], 0)
            node[at] = to
            at = at[to > 0]

    def encode(self, doc_ids: list[int | None], texts: list[str | None]) -> list[bytes]:
        """The ids of each document, as little-endian uint32."""
        if len(self.ids) > self.limit:
            self._forget()
        if len(self.seen) > self.limit:
            self.seen.clear()
        chunked = [CHUNK.findall(f" {t}") if t else [] for t in texts]
        sizes = np.fromiter(map(len, chunked), np.int64, len(chunked))
        stops = np.cumsum(sizes)
        flat = [c for chunks in chunked for c in chunks]
        docs = np.fromiter((xxhash.xxh64_intdigest(t or "", xxhash.xxh64_intdigest(f"{self.seed}:{i or 0}")) for i, t in zip(doc_ids, texts, strict=True)), np.uint64, len(texts))
        # the key of chunk k of a document
        keys = (np.arange(len(flat)) - np.repeat(stops - sizes, sizes) + 1).astype(np.uint64) * np.uint64(_M1) + np.repeat(docs, sizes)
        keys = (keys ^ keys >> np.uint64(30)) * np.uint64(_M2)
        keys = (keys ^ keys >> np.uint64(27)) * np.uint64(_M3)
        keys ^= keys >> np.uint64(31)
        node = np.fromiter(map(self.roots.get, flat, repeat(0)), np.int64, len(flat))
        for k in np.flatnonzero(node == 0).tolist():
            c = flat[k]
            if c in self.roots:
                node[k] = self.roots[c]
            elif len(c) <= _TREE:
                self.seen[c] = visits = self.seen.get(c, 0) + 1
                if visits >= _VISITS:
                    del self.seen[c]
                    node[k] = self.roots[c] = self._add(c, (), 0)
        for k in range(0, len(flat), 20_000):
            self._walk(node, keys, k + np.flatnonzero(node[k : k + 20_000]))
        parts = list(map(self.ids.__getitem__, node.tolist()))
        alone = np.flatnonzero(node == 0)
        for k, ids in zip(alone.tolist(), self.model.segment([flat[k] for k in alone.tolist()], keys[alone], self.dropout), strict=True):
            parts[k] = ids
        return [b"".join(parts[a:b]) for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(path: str, seed: int, dropout: float) -> Encoder:
    """The worker's encoder for a model and its settings."""
    key = (path, seed, dropout)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Model(path), seed, dropout)
    return _ENCODERS[key]


def encode(docs: DataFrame, model: str, seed: int = 1, dropout: float = 0.1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, lossless, ids) of every document: its ids (null if ``with_ids`` is off), their
    CRC-32 as little-endian uint32, and whether decoding them gave the text back."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoder = encoder_of(model, seed, dropout)
            doc_ids, texts = (c.to_pylist() for c in b.columns)
            for part in slices(texts):
                coded = encoder.encode(doc_ids[part], texts[part])
                ids = [np.frombuffer(x, "<u4") for x in coded]
                same = [encoder.model.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts[part], strict=True)]
                n = [len(x) for x in ids]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32))) if with_ids else pa.nulls(len(n), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part.start, len(n)), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in coded], pa.int64()), pa.array(same, pa.bool_()), lists], schema=schema)

    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, lossless boolean, ids array<int>")


def decode(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = encoder_of(model, 0, 0.0).model
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else m.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
