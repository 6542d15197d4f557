"""Benchmark decontamination: a BM25 index of the test items, queried with every passage of every document.

The items are indexed by word, with a posting's impact being its BM25 weight as a share of what the item scores
against itself, so that a score says how much of an item's weight a passage covers. Items are cut into blocks of neighbours, and
a posting list knows its largest impact in each. A passage is a window of twice the longest item's words, at half its
length from the next, so that every item lies whole in a window. Block-max WAND retrieves all items above the
threshold; its test of a block's bound is first made for many passages at once, and only passages with a block that can
hold such an item are walked. A retrieved item is verified on the passage's words: of its question and of its answer, each by itself, the
given share of the five-word shingles must occur there. The answer is the run of last sentences that has five words or more; an item that
leaves fewer than five words before it is all question. So a text with a whole question but another answer is clean.

The index goes to the executors with the function. ``batch_chars`` bounds the items of one index; a larger benchmark is
dealt by hash of the item to several, built one after another and kept in the shared folder, each of which scans the documents. Frequencies of
words, lengths and windows are those of the whole benchmark, so results do not depend on the number of indexes. Documents are only
mapped: no shuffle.

Nulls and odd rows: null or wordless items are never found; an item or part of fewer than five words is one shingle.
Repeated items are one. Null and wordless texts contain nothing; a very long text is scanned whole, alone in its slice. Null and
repeated document ids are passed through; a document row has one result row for each item_id found in it, that of its best passage
(ties: the first), and one for each item without an id. Extra columns are ignored (``leaks``) or kept (``keep_clean``).
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.files import make_dir, opened
from graphloom.llm.hashed_text import slices
from graphloom.scratch import materialise, new_path

WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"(?<=[.?!])\s+|\n+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(of: list[str], k: int) -> set[tuple[str, ...]]:
    return {tuple(of[a : a + k]) for a in range(max(1, len(of) - k + 1))} if of else set()


@dataclass
class Postings:
    """A term's items in order, with their impacts, and the largest impact in each block of ``size`` neighbouring items."""

    items: list[int]
    impacts: list[float]
    size: int
    most: float = 0.0
    blocks: list[int] = field(default_factory=list)
    block_most: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.most = max(self.impacts)
        for item, impact in zip(self.items, self.impacts, strict=True):
            if self.blocks and self.blocks[-1] == item // self.size:
                self.block_most[-1] = max(self.block_most[-1], impact)
            else:
                self.blocks.append(item // self.size)
                self.block_most.append(impact)


def parts(text: str, least: int = 5) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer."""
    sentences = [w for s in SENTENCE_END.split(text) if (w := words(s))]
    at, n = len(sentences), 0
    while at and n < least:
        at -= 1
        n += len(sentences[at])
    question, answer = sum(sentences[:at], []), sum(sentences[at:], [])
    return (question, answer) if len(question) >= least else (question + answer, [])


@dataclass
class Stats:
    """Of all items with a word: how many there are, their mean and largest length, and in how many each word is."""

    items: int
    mean: float
    longest: int
    df: dict[str, int]

    @classmethod
    def of(cls, items: list[list[str]]) -> Stats:
        lengths = [len(w) for w in items if w]
        return cls(len(lengths), sum(lengths) / max(1, len(lengths)), max(lengths, default=1), Counter(x for w in items for x in set(w)))


@dataclass
class Found:
    item_id: int | None
    score: float
    question_overlap: float
    answer_overlap: float


class Index:
    """The inverted index of items [(item_id, text)]."""

    def __init__(
        self, items: list[tuple[int | None, str | None]], stats: Stats | None = None, k1: float = 1.2, b: float = 0.75, block: int = 4, wide: int = 64, shingle_words: int = 5
    ) -> None:
        items = [(i, t, w) for i, t in dict.fromkeys(items) if (w := words(t))]
        stats = stats or Stats.of([w for *_, w in items])
        self.ids = [i for i, *_ in items]
        self.k = shingle_words
        self.parts = [tuple(shingles(p, shingle_words) for p in parts(t, shingle_words)) for _, t, _ in items]
        self.longest, df, mean = stats.longest, stats.df, stats.mean
        self.term = {x: n for n, x in enumerate(sorted({x for *_, w in items for x in w}))}
        lists: list[tuple[list[int], list[float]]] = [([], []) for _ in self.term]
        for n, (*_, w) in enumerate(items):
            weight = {
                x: log(1 + (stats.items - df[x] + 0.5) / (df[x] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean)) for x, tf in Counter(w).items()
            }
            whole = sum(weight.values())
            for x, y in weight.items():
                lists[self.term[x]][0].append(n)
                lists[self.term[x]][1].append(y / whole)
        self.postings = [Postings(a, y, block) for a, y in lists]
        self.size, self.blocks = block, -(-len(items) // block) + 1
        # (block, largest impact) of every term, as flat arrays; a term in over ``wide`` blocks counts with its
        # largest impact in all of them, as one row for the block behind the last
        rows = [([self.blocks - 1], [p.most]) if len(p.blocks) > wide else (p.blocks, p.block_most) for p in self.postings]
        self.row_at = np.cumsum([0, *(len(x) for x, _ in rows)])
        self.row_block = np.array([x for r, _ in rows for x in r], np.int64)
        self.row_most = np.array([x for _, r in rows for x in r])

    def retrieve(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All (item, score) with a score of ``least`` or more, by block-max WAND."""
        slack = least - 1e-9
        cursors = [[self.postings[t].items[0], 0, self.postings[t]] for t in terms]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, at = 0.0, -1
            for n, c in enumerate(cursors):
                bound += c[2].most
                if bound >= slack:
                    at = n
                    break
            if at < 0:
                break
            pivot = cursors[at][0]
            while at + 1 < len(cursors) and cursors[at + 1][0] == pivot:
                at += 1
            here, bound = pivot // self.size, 0.0
            for _, _, p in cursors[: at + 1]:
                b = bisect_left(p.blocks, here)
                if b < len(p.blocks) and p.blocks[b] == here:
                    bound += p.block_most[b]
            if bound < slack:  # no item of the pivot's block can score enough
                to = (here + 1) * self.size
                if at + 1 < len(cursors):
                    to = min(to, cursors[at + 1][0])
                cursors = _moved(cursors, at + 1, to)
            elif cursors[0][0] == pivot:
                score = sum(c[2].impacts[c[1]] for c in cursors[: at + 1])
                if score >= slack:
                    found.append((pivot, score))
                cursors = _moved(cursors, at + 1, pivot + 1)
            else:
                cursors = _moved(cursors, at + 1, pivot)
        return found

    def scan(self, texts: list[str | None], least: float, overlap: float) -> list[list[Found]]:
        """The verified items of each text."""
        lists = [words(t) for t in texts]
        stride = self.longest
        get = self.term.get
        sizes = np.array([len(w) for w in lists])
        n = int(sizes.sum())
        ids = np.fromiter((get(x, -1) for w in lists for x in w), np.int64, n)
        owner = np.repeat(np.arange(len(lists)), sizes)
        windows = -(-np.maximum(sizes, 1) // stride)
        first = np.cumsum(windows) - windows
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        window = first[owner] + place // stride
        known = ids >= 0
        two = known & (place >= stride)
        terms = max(1, len(self.term))
        pairs = np.unique(np.concatenate([window[known] * terms + ids[known], (window[two] - 1) * terms + ids[two]]))
        at, term = pairs // terms, pairs % terms
        best: list[dict[tuple, Found]] = [{} for _ in lists]
        for w in self._hopeful(at, term, int(windows.sum()), least):
            lo, hi = np.searchsorted(at, [w, w + 1])
            hits = self.retrieve(term[lo:hi].tolist(), least)
            if hits:
                doc = int(np.searchsorted(first, w, "right")) - 1
                begin = (int(w) - int(first[doc])) * stride
                self._verify(lists[doc][begin : begin + 2 * stride], hits, overlap, best[doc])
        return [[b[k] for k in sorted(b)] for b in best]

    def _hopeful(self, window: np.ndarray, term: np.ndarray, windows: int, least: float) -> np.ndarray:
        """The windows with a block in which the sum of the terms' largest impacts reaches the threshold."""
        if not len(term):
            return term
        n = self.row_at[term + 1] - self.row_at[term]
        row = np.repeat(self.row_at[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key = np.repeat(window, n) * self.blocks + self.row_block[row]
        if windows * self.blocks <= 4 * len(key) + 1_000_000:
            bound = np.bincount(key, weights=self.row_most[row], minlength=windows * self.blocks).reshape(windows, self.blocks)
            return np.flatnonzero(bound[:, :-1].max(axis=1, initial=0.0) + bound[:, -1] >= least - 1e-9)
        found, place = np.unique(key, return_inverse=True)
        bound = np.bincount(place, weights=self.row_most[row])
        anywhere = np.zeros(windows)
        wide = found % self.blocks == self.blocks - 1
        anywhere[found[wide] // self.blocks] = bound[wide]
        most = anywhere.copy()
        np.maximum.at(most, found[~wide] // self.blocks, bound[~wide] + anywhere[found[~wide] // self.blocks])
        return np.flatnonzero(most >= least - 1e-9)

    def _verify(self, passage: list[str], hits: list[tuple[int, float]], overlap: float, best: dict[tuple, Found]) -> None:
        have: dict[int, set[tuple[str, ...]]] = {}

        def share(part: set[tuple[str, ...]]) -> int:
            total = 0
            for s in part:
                if len(s) not in have:
                    have[len(s)] = shingles(passage, len(s))
                total += s in have[len(s)]
            return total

        for item, score in hits:
            question, answer = self.parts[item]
            q, a = share(question) / len(question), share(answer) / len(answer) if answer else 1.0
            # items without an id are told apart by their place
            key = (False, self.ids[item]) if self.ids[item] is not None else (True, item)
            if q >= overlap and a >= overlap and (key not in best or score > best[key].score):
                best[key] = Found(self.ids[item], score, q, a)


def _moved(cursors: list, n: int, to: int) -> list:
    """The cursors, the first n of them moved on to item ``to`` or later; ended ones go."""
    for c in cursors[:n]:
        if c[0] < to:
            c[1] = bisect_left(c[2].items, to, c[1])
            c[0] = c[2].items[c[1]] if c[1] < len(c[2].items) else None
    return [c for c in cursors if c[0] is not None]


def _in_order(rows: list) -> list[tuple[int | None, str | None]]:
    return sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", batch_chars: int = 20_000_000) -> list[Callable[[], Index]]:
    """One index for each batch of items, as functions that give it. The driver holds one batch and its words at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    batches = max(1, -(-total // batch_chars))
    if batches == 1:
        index = Index(_in_order(items.collect()))
        return [lambda: index]
    dealt = materialise(items.withColumn("batch", F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), "text")), F.lit(int(batches))).cast("int")), "benchmark")

    def spelled(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            lists = [words(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in lists], pa.int64()), pa.array([sorted(set(w)) for w in lists], pa.list_(pa.string()))], ["batch", "n", "terms"])

    told = materialise(dealt.select("batch", "text").mapInArrow(spelled, "batch int, n long, terms array<string>"), "benchmark-words").where("n > 0")
    sizes = told.agg(F.count("*").alias("items"), F.sum("n").alias("n"), F.max("n").alias("longest")).first()
    uses = told.select("batch", F.explode("terms").alias("term"))
    df = materialise(uses.distinct().join(uses.groupBy("term").count(), "term"), "benchmark-frequencies")
    folder = new_path(benchmark.sparkSession, "benchmark-indexes")
    make_dir(folder)
    found = []
    for k in range(batches):
        frequencies = {r.term: r["count"] for r in df.where(F.col("batch") == k).select("term", "count").toLocalIterator()}
        stats = Stats(sizes["items"], (sizes["n"] or 0) / max(1, sizes["items"]), sizes["longest"] or 1, frequencies)
        fs, path = opened(f"{folder}/{k}")
        with fs.open_output_stream(path) as out:
            out.write(pickle.dumps(Index(_in_order(dealt.where(F.col("batch") == k).collect()), stats)))
        found.append(_Kept(f"{folder}/{k}"))
    return found


@dataclass
class _Kept:
    """An index in the shared folder; read by the first call in a process."""

    path: str
    index: Index | None = None

    def __call__(self) -> Index:
        if self.index is None:
            fs, path = opened(self.path)
            with fs.open_input_stream(path) as f:
                self.index = pickle.loads(f.read())
        return self.index

    def __getstate__(self) -> dict:
        return {"path": self.path, "index": None}


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every item found in a document."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ddl = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def through(of: Callable[[], Index]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = of()
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                rows = []
                for part in slices(texts):
                    for doc_id, found in zip(ids[part], index.scan(texts[part], least, overlap), strict=True):
                        rows += [(doc_id, f.item_id, f.score, f.question_overlap, f.answer_overlap) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return run

    found = None
    for index in indexes(benchmark):
        part = narrow.mapInArrow(through(index), ddl)
        found = part if found is None else found.unionByName(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """The documents, all columns, that contain no test item."""
    k = docs.columns.index(text_col)

    def through(of: Callable[[], Index]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = of()
            for b in batches:
                texts = b.column(k).to_pylist()
                yield b.filter(pa.array([not f for part in slices(texts) for f in index.scan(texts[part], least, overlap)], pa.bool_()))

        return run

    for index in indexes(benchmark):
        docs = docs.mapInArrow(through(index), docs.schema)
    return docs
