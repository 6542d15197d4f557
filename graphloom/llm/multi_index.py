"""Approximate nearest neighbours by an inverted multi-index.

A vector's two halves are quantised separately with ``centroids`` centroids each, so that it falls in one of
centroids**2 cells. A query walks the cells in order of the summed squared distance of their two centroids, from a
heap of pairs (the multi-sequence algorithm), until the cells it took hold ``scan_share`` of the indexed vectors and at
least ``least`` of them; the vectors in those cells are then ranked by their exact distance, in double precision.

Codebooks are fitted on at most ``train_rows`` vectors chosen by hash; every vector is indexed. The cell counts are
collected, a table of at most centroids**2 rows. Neighbouring first centroids form a shard of about ``block_rows`` vectors; a shard
with more, of one centroid, is cut by hash into blocks. Every indexed vector is sent to its block, once; a query is sent, with its cells, to
the blocks of the shards that it visits. A task holds one block and streams the block's queries past it, so memory does not grow with
either, however many vectors share a cell, and no pair leaves a task: only each query's best ``k`` of a block do.

On vectors without cluster structure, such as the test tables', neighbours are spread over many cells and a recall of
0.9 takes a large share; see the README for measured recall by share.

Vectors that are null or zero, hold null or non-finite components, or are not as long as the commonest vector of the rows, take no
part, in rows and queries alike, nor do rows with a null id. Rows with the same id count as one candidate, the nearest; a query never finds its
own id. Ties go to the smaller id. Fewer candidates than k are all returned. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.scratch import materialise


def usable(rows: DataFrame, id_col: str, vector_col: str, size: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, v as doubles, and their length: the given or the commonest one."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (
        rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(~bad & F.exists("v", lambda x: x != 0))
    )
    if size is None:
        commonest = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        size = commonest["n"] if commonest else 0
    return good.where(F.size("v") == size), size


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as a matrix."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """Lloyd's algorithm from distinct points; empty centroids move to the worst-served points."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        d = (centres**2).sum(1)[None] - 2 * x @ centres.T
        near = d.argmin(1)
        size = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = sums / np.maximum(size, 1)[:, None]
        lost = np.flatnonzero(size == 0)
        if len(lost):
            centres[lost] = x[np.argsort(d.min(1) + (x**2).sum(1))[-len(lost) :]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, target: int) -> list[tuple[int, int]]:
    """The non-empty cells by summed distance of their halves, until they hold ``target`` vectors."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    heap, taken, held = [(da[0] + db[0], 0, 0)], [], 0
    while heap and held < target:
        _, i, j = heapq.heappop(heap)
        # (i, j) is pushed by (i, j - 1), and the first of a row by the row before
        if j + 1 < len(db):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
        n = counts[a[i], b[j]]
        if n:
            held += int(n)
            taken.append((int(a[i]), int(b[j])))
    return taken


class Block:
    """The vectors of a block, in order of cell."""

    def __init__(self, cells: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((ids, cells))
        self.cells, self.ids, self.vectors = cells[order], ids[order], vectors[order]
        self.norm = (self.vectors**2).sum(1)
        self.repeats = len(np.unique(ids)) < len(ids)

    def best(self, x: np.ndarray, own: int, cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest to x among the vectors in the cells, each id once, the own one left out."""
        lo, hi = np.searchsorted(self.cells, cells, "left"), np.searchsorted(self.cells, cells, "right")
        n = hi - lo
        rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        rows = rows[self.ids[rows] != own]
        if len(rows) > k:  # a shortlist by a faster formula, with slack for its rounding
            rough = self.norm[rows] - 2 * self.vectors[rows] @ x
            nearest_of = rough
            if self.repeats:
                by = np.lexsort((rough, self.ids[rows]))
                first = np.flatnonzero(np.diff(self.ids[rows][by], prepend=self.ids[rows][by[0]] - 1))
                nearest_of = rough[by][first]
            edge = np.partition(nearest_of, k - 1)[k - 1] if len(nearest_of) > k else nearest_of.max()
            rows = rows[rough <= edge + 1e-9 * (1 + abs(edge) + float(x @ x))]
        d = np.sqrt(((self.vectors[rows] - x) ** 2).sum(1))
        o = np.lexsort((self.ids[rows], d))
        _, kept = np.unique(self.ids[rows][o], return_index=True)
        o = o[np.sort(kept)][:k]
        return self.ids[rows][o], d[o]


def shards(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, list[int]]:
    """The shard of every first centroid, neighbours together up to ``block_rows`` vectors, and each shard's number of blocks."""
    of, held = np.zeros(len(sizes), np.int64), [0]
    for k, n in enumerate(sizes.tolist()):
        if held[-1] and held[-1] + n > block_rows:
            held.append(0)
        of[k] = len(held) - 1
        held[-1] += n
    return of, [max(1, -(-n // block_rows)) for n in held]


def search(
    rows: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    centroids: int = 256,
    train_rows: int = 16_384,
    scan_share: float = 0.25,
    least: int = 1000,
    block_rows: int = 8192,
) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank, vec_id, score (Euclidean distance)."""
    spark = rows.sparkSession
    base, size = usable(rows, id_col, vector_col)
    asked, _ = usable(queries, id_col, vector_col, size)
    sample = base.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(train_rows).select("v").toArrow().column("v").combine_chunks()
    out = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], out)
    x = matrix(sample)
    half = max(1, x.shape[1] // 2)
    one, two = kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids) if x.shape[1] > 1 else np.zeros((1, 0))

    width = len(two)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(nearest(v[:, :half], one) * width + nearest(v[:, half:], two), pa.int32()), *b.columns], ["cell", "vec_id", "v"])

    index = materialise(base.mapInArrow(assign, "cell int, vec_id long, v array<double>"), "multi-index")
    counts = np.zeros(len(one) * width, np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r.cell] = r["count"]
    counts = counts.reshape(len(one), width)
    target = max(least, int(np.ceil(scan_share * counts.sum())))
    shard, blocks = shards(counts.sum(axis=1), block_rows)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                visits = []
                part = b.slice(at, 256)
                for me, v in zip(part.column(0).to_pylist(), matrix(part.column(1)), strict=True):
                    cells = np.array(walk(((one - v[:half]) ** 2).sum(1), ((two - v[half:]) ** 2).sum(1), counts, target))
                    to = shard[cells[:, 0]]
                    code = cells[:, 0] * width + cells[:, 1]
                    visits += [(n, blocks[n], np.sort(code[to == n]), me, v) for n in np.unique(to).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in visits], t) for n, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.float64())))], ["shard", "blocks", "cells", "id", "v"])

    visits = asked.mapInArrow(visit, "shard int, blocks int, cells array<int>, id long, v array<double>")
    at = lambda values, k: F.element_at(F.array(*[F.lit(int(x)) for x in values]), k + 1)
    left = index.withColumn("shard", at(shard, F.floor(F.col("cell") / width).cast("int"))).select(
        "shard", F.pmod(F.xxhash64("vec_id"), at(blocks, F.col("shard"))).cast("int").alias("block"), F.lit(0).alias("side"), F.array("cell").alias("cells"), F.col("vec_id").alias("id"), "v"
    )
    right = visits.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "cells", "id", "v")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in range(3)])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *new], [*new, b.num_rows], strict=True):
                if lo == hi:
                    continue
                part, here = b.slice(lo, hi - lo), tuple(keys[:2, lo])
                if here != key:
                    key, held, block = here, [], None
                if keys[2, lo] == 0:
                    held.append((part.column(3).flatten().to_numpy(), part.column(4).to_numpy(), matrix(part.column(5))))
                elif held or block:
                    block = block or Block(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                    found = []
                    for me, cells, v in zip(part.column(4).to_numpy(), part.column(3), matrix(part.column(5)), strict=True):
                        near, d = block.best(v, me, cells.values.to_numpy(), k)
                        found.append((np.full(len(near), me), near, d))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    dealt = left.unionByName(right).repartition("shard", "block").sortWithinPartitions("shard", "block", "side")
    near = dealt.mapInArrow(rerank, "query_id long, vec_id long, score double")
    per_vector = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return per_vector.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
