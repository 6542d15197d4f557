"""Hashed features of many texts at once, as numpy arrays of code points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_CHARS = 1_000_000
_BASE = 0x9E3779B97F4A7C15


@dataclass
class Texts:
    """Lower-cased texts, each with a space at either end, joined by NULs."""

    points: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        lowered = [f" {(t or '').lower()} \0" for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        return cls(points, np.cumsum(sizes) - sizes)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text of each position."""
        return np.searchsorted(self.starts, at, "right") - 1


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[slice]:
    """Runs of texts of at most ``most`` characters together, or of one text."""
    at = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > at and size + n > most:
            yield slice(at, k)
            at, size = k, 0
        size += n
    if texts:
        yield slice(at, len(texts))


def ngrams(t: Texts, n: int, bits: int) -> np.ndarray:
    """A bucket below 2**bits for the n-gram at every position; 2**bits where it would leave its text."""
    h = np.zeros(len(t.points), np.uint32)
    out = t.points == 0
    for k in range(n):
        c = np.zeros_like(h)
        c[: len(h) - k] = t.points[k:]
        out |= c == 0
        h = (h ^ c) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    h = (h + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)
    h[out] = 1 << bits
    return h


@cache
def _kinds() -> np.ndarray:
    """For each code point: 0 white space or control, 1 other, 2 letter or digit."""
    return np.array([2 if (c := chr(k)).isalnum() else 0 if c.isspace() or k == 0 else 1 for k in range(0x110000)], np.uint8)


def runs(t: Texts, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of code points of a kind from ``least`` on: 2 for words, 1 for tokens."""
    inside = (_kinds()[t.points] >= least).astype(np.int8)
    edge = np.diff(inside, prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _mixed(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)).astype(np.int64)


def hashed(t: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run: a polynomial in its code points, from running sums."""
    n = len(t.points)
    power = np.cumprod(np.full(n + 1, _BASE, np.uint64))
    inverse = np.cumprod(np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64))
    total = np.concatenate(([np.uint64(0)], np.cumsum(t.points * power[:-1], dtype=np.uint64)))
    return (total[ends] - total[starts]) * inverse[starts]


def word_features(t: Texts, bits: int, prefixes: tuple[int, ...] = (3, 4, 5, 6)) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct words and word prefixes of each text, in order."""
    starts, ends = runs(t, 2)
    owner = t.owner(starts)
    keys = [(owner << bits) | _mixed(hashed(t, starts, ends), 0, bits)]
    for k in prefixes:
        long = ends - starts > k
        keys.append((owner[long] << bits) | _mixed(hashed(t, starts[long], starts[long] + k), k, bits))
    found = np.unique(np.concatenate(keys))
    return found >> bits, found & ((1 << bits) - 1)


def style_features(t: Texts, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the tokens, their last three code points, and repetition of the token before;
    values are square roots of relative frequencies."""
    starts, ends = runs(t, 1)
    owner = t.owner(starts)
    whole = hashed(t, starts, ends)
    again = np.flatnonzero((whole[1:] == whole[:-1]) & (owner[1:] == owner[:-1])) + 1
    keys = [
        (owner << bits) | _mixed(whole, 0, bits),
        (owner << bits) | _mixed(hashed(t, np.maximum(starts, ends - 3), ends), 1, bits),
        (owner[again] << bits) | _mixed(np.zeros(len(again), np.uint64), 2, bits),
    ]
    found, n = np.unique(np.concatenate(keys), return_counts=True)
    of = found >> bits
    tokens = np.bincount(owner, minlength=len(t.starts))
    return of, found & ((1 << bits) - 1), np.sqrt(n / np.maximum(1, tokens[of]))


def sample_ids(rated: DataFrame, id_col: str, by: Column, values: list, most: int, seed: int) -> DataFrame:
    """At most ``most`` ids of each value of ``by``, chosen by hash: a bounded table of ids and their columns."""
    picked = None
    for v in values:
        part = rated.where(by == v).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(most)
        picked = part if picked is None else picked.unionByName(part)
    return picked


def mapped(frame: DataFrame, row_schema: pa.Schema, ddl: str, score) -> DataFrame:
    """Map batches whose last column is the text: the columns before it, and the arrays that ``score`` makes of
    slices of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for part in slices(texts):
                kept = [c.slice(part.start, part.stop - part.start) for c in b.columns[:-1]]
                made = score(texts[part])
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, f.type) for x, f in zip(made, list(row_schema)[len(kept) :], strict=True))], schema=row_schema)

    return frame.mapInArrow(run, ddl)
