"""SimHash near-duplicate classes by a binary trie self-join.

1. Every document gets a 64-bit fingerprint in an Arrow map (no shuffle).
2. Equal fingerprints collapse to one class by a partially aggregated groupBy, so thousands of exact copies
   cost one row from here on.
3. The fingerprints form binary tries that are joined with themselves: pairs of nodes are expanded together, bit by
   bit, their differing bits are added up, and a pair over its error budget is dropped with everything below it, until
   both are single fingerprints, which are compared. There are ``budget + 1`` tries, one for each of as many blocks of
   bits moved to the front, because errors can be held to a tighter budget on the way down: of the rotations of a
   sequence of ``budget + 1`` block errors that sum to ``budget`` at most, one has at most l - 1 errors in its first
   l blocks, for every l (the cycle lemma). So every link is found in one of the tries, and near the root, where nodes are
   large, a node is paired with itself or with very few others.
4. Tasks hold node pairs. Nodes of a depth that follows from the number of classes are dealt out, each with itself, as
   no error is allowed there yet; a pair of nodes with more than ``most_rows`` classes is dealt again as the pairs of
   its descendants one block further down that are within budget, and so on, so a dense region is split as often as it takes.
   Links become a spanning forest in a task: a dense node of m classes emits fewer than m edges.
5. Connected components of those edges, in distributed rounds, give every class its smallest doc_id.

Nulls and odd rows: a null or wordless text has fingerprint zero and is linked like any other. Rows with a null
doc_id are kept; they count only for a component without any other id (its component_id is null). Rows that share a doc_id
are linked by their texts like any others. Equal fingerprints are one class, so repeated rows and ties cost nothing. A very
long text is hashed in pieces of 65,536 shingles. Extra columns are ignored (``near_duplicates``) or kept, whatever
their names (``keep_one``). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.operators.components import connected_components
from graphloom.scratch import materialise

BITS = 64
CELL = ["kind", "depth", "a", "b"]
_HASHES_AT_ONCE = 1 << 16
_PAIRS_AT_ONCE = 1 << 16
_FLIP = -(1 << 63)


def fingerprint(text: bytes | None, shingle_words: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: a bit is 1 if it is set in over half of the shingle hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    n = len(words) - shingle_words + 1
    for at in range(0, n, _HASHES_AT_ONCE):
        to = min(n, at + _HASHES_AT_ONCE)
        spans = zip(starts[at:to].tolist(), ends[at + shingle_words - 1 : to + shingle_words - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, to - at)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle_words) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def blocks(budget: int) -> list[int]:
    """The widths of the budget + 1 blocks that a fingerprint is cut into."""
    cuts = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return [b - a for a, b in zip(cuts, cuts[1:], strict=False)]


def rotated(budget: int) -> list[tuple[int, list[int]]]:
    """For each trie how far fingerprints are rotated left, and the widths of the blocks as they then stand."""
    widths = blocks(budget)
    return [(sum(widths[:k]), widths[k:] + widths[:k]) for k in range(budget + 1)]


class Forest:
    """Union-find over array positions, many unions at a time."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            up = self.parent[root]
            if np.array_equal(up, root):
                return root
            root = up

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.find(i), self.find(j)
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(self.parent, np.maximum(i, j), np.minimum(i, j))

    def flatten(self) -> np.ndarray:
        self.parent = self.find(np.arange(len(self.parent)))
        return self.parent


def trie_self_join(values: np.ndarray, pairs: np.ndarray, allowed: np.ndarray, budget: int) -> Forest:
    """Unite the positions of uint64 ``values`` that differ in at most ``budget`` bits, starting from node pairs.

    A trie node is a run [lo, hi) of ascending, distinct values with a common prefix. ``pairs`` has the columns (lo, hi, lo, hi,
    depth, differing bits so far); a node may be paired with itself. ``allowed`` holds for every bit how many bits may differ up to
    it. Pairs wait on a stack, those of nodes that are alike on top, so that siblings already united are dropped
    unseen. Memory is bounded by the chunks, whatever the data.
    """
    forest = Forest(len(values))
    stack = [_proper(pairs)]
    while stack:
        pairs = stack.pop()
        if pairs.shape[1] > _PAIRS_AT_ONCE:
            stack.append(pairs[:, :-_PAIRS_AT_ONCE])
            pairs = pairs[:, -_PAIRS_AT_ONCE:]
        pairs = _apart(pairs, forest)
        single = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
        i, j = pairs[0, single], pairs[2, single]
        near = np.bitwise_count(values[i] ^ values[j]) <= budget
        forest.unite(i[near], j[near])
        if not single.all():
            stack.append(_expand(values, pairs[:, ~single], allowed))
    return forest


def _proper(pairs: np.ndarray) -> np.ndarray:
    """Without empty nodes and without single values paired with themselves."""
    return pairs[:, (pairs[1] > pairs[0]) & (pairs[3] > pairs[2]) & ((pairs[0] != pairs[2]) | (pairs[1] - pairs[0] > 1))]


def _apart(pairs: np.ndarray, forest: Forest) -> np.ndarray:
    """Without the pairs whose values are all united already; looked for where there is much to save."""
    if ((pairs[1] - pairs[0]) * (pairs[3] - pairs[2])).sum() < 4 * len(forest.parent):
        return pairs
    label = forest.flatten()
    breaks = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
    lo, hi, lo2, hi2 = pairs[:4]
    done = (breaks[hi - 1] == breaks[lo]) & (breaks[hi2 - 1] == breaks[lo2]) & (label[lo] == label[lo2])
    return pairs[:, ~done]


def _middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where in each run the values begin that have the bit set."""
    while (open_ := lo < hi).any():
        at = (lo + hi) >> 1
        up = (values[np.minimum(at, len(values) - 1)] >> bit) & np.uint64(1) == 1
        lo, hi = np.where(open_ & ~up, at + 1, lo), np.where(open_ & up, at, hi)
    return lo


def _expand(values: np.ndarray, pairs: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The children of node pairs that are within budget: those on differing bits, which cost one, and those on equal bits."""
    alo, ahi, blo, bhi, depth, err = pairs
    own = alo == blo
    bit = (BITS - 1 - depth).astype(np.uint64)
    amid = _middle(values, alo, ahi, bit)
    bmid = amid.copy()
    bmid[~own] = _middle(values, blo[~own], bhi[~own], bit[~own])
    crossed = np.concatenate([np.stack([alo, amid, bmid, bhi, depth + 1, err + 1]), np.stack([amid, ahi, blo, bmid, depth + 1, err + 1])[:, ~own]], axis=1)
    alike = np.concatenate([np.stack([alo, amid, blo, bmid, depth + 1, err]), np.stack([amid, ahi, bmid, bhi, depth + 1, err])], axis=1)
    found = _proper(np.concatenate([crossed, alike], axis=1))
    return found[:, found[5] <= allowed[found[4] - 1]]


def _in_cells(batches: Iterator[pa.RecordBatch], budget: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Trie-join whole cells of a sorted partition, about ``rows`` rows at a time."""
    tries = rotated(budget)

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        kind, depth, a, b, r = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in range(5))
        x = r.view(np.uint64) ^ np.uint64(1 << 63)
        src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        edge = np.flatnonzero(np.diff(kind, prepend=kind[0] - 1, append=kind[-1] + 1))
        for s, e in zip(edge, edge[1:], strict=False):
            by, widths = tries[kind[s]]
            values = x[s:e]
            pairs = _start(values, depth[s:e].astype(np.int64), a[s:e], b[s:e])
            root = trie_self_join(values, pairs, np.repeat(np.arange(budget + 1), widths), budget).flatten()
            linked = np.flatnonzero(root != np.arange(len(root)))
            back = np.uint64((BITS - by) % BITS)
            fp = ((values << back) | (values >> (np.uint64(BITS) - back)) if back else values).view(np.int64)
            src.append(fp[linked])
            dst.append(fp[root[linked]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(4)])
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        cut = int(new[-1]) if len(new) else 0
        if not cut and last is not None and (key[:, 0] != last).any():
            cut = -1  # the batch begins a cell
        if cut and n + max(cut, 0) >= rows:
            if cut > 0:
                held.append(batch.slice(0, cut))
            if held:
                yield joined(held)
            held, n, batch = [], 0, batch.slice(max(cut, 0))
        held.append(batch)
        n += batch.num_rows
        last = key[:, -1]
    if n:
        yield joined(held)


def _start(values: np.ndarray, depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The node pairs of the cells in sorted rows: a node with itself, or the two nodes that its rows fall in."""
    new = np.concatenate(([True], (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(values))
    left = (values >> (BITS - np.maximum(depth, 1)).astype(np.uint64)).astype(np.int64) == a
    middle = lo + np.add.reduceat(left, lo)
    own = a[lo] == b[lo]
    return np.stack([lo, np.where(own, hi, middle), np.where(own, lo, middle), hi, depth[lo], np.bitwise_count(a[lo] ^ b[lo])]).astype(np.int64)


def _masks(width: int, most: int) -> list[int]:
    """The numbers of ``width`` bits with at most ``most`` ones."""
    return [sum(1 << k for k in ones) for n in range(most + 1) for ones in combinations(range(width), n)]


def cells(classes: DataFrame, budget: int = 4, node_rows: int = 4096, most_rows: int = 16_384) -> DataFrame:
    """(kind, depth, a, b, r): the classes in their node pairs: the trie, the nodes' depth and prefixes, and the rotated
    fingerprint, with its top bit flipped, as signed numbers are sorted."""
    n = classes.count()
    tries = rotated(budget)
    top = min(min(blocks(budget)), max(0, (n // node_rows).bit_length()))
    most = max(most_rows, 8 * n >> top)
    fp = F.col("fp")
    turned = [F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by)) if by else fp for by, _ in tries]
    rows = classes.select(F.posexplode(F.array(*turned)).alias("kind", "x"))
    node = F.shiftrightunsigned("x", BITS - top) if top else F.lit(0).cast("long")
    rows = rows.select("kind", F.lit(top).alias("depth"), node.alias("a"), node.alias("b"), F.col("x").bitwiseXOR(F.lit(_FLIP)).alias("r"))
    for level in range(budget):
        large = materialise(rows.groupBy(*CELL).count().where(F.col("count") > most).select(*CELL, F.lit(True).alias("large")), "large-nodes")
        if large.isEmpty():
            break
        split = F.when(F.col("large").isNull(), F.array(F.struct("depth", "a", "b")))
        for kind, (_, widths) in enumerate(tries):
            for at in {top, *(sum(widths[:k]) for k in range(1, level + 1))}:
                k = next(k for k in range(budget + 1) if sum(widths[: k + 1]) > at)
                split = split.when((F.col("kind") == kind) & (F.col("depth") == at), _descendants(at, sum(widths[: k + 1]), k))
        rows = rows.join(large, CELL, "left").select("kind", F.inline(split), "r").select(*CELL, "r")
    return rows


def _descendants(depth: int, below: int, allowed: int):
    """The node pairs at depth ``below`` that a row of a node pair at ``depth`` belongs to, within the allowed errors."""
    width = below - depth
    raw = F.col("r").bitwiseXOR(F.lit(_FLIP))
    own = F.shiftrightunsigned(raw, BITS - below)
    left = F.shiftrightunsigned(raw, BITS - depth) == F.col("a") if depth else F.lit(True)
    spent = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    masks = F.filter(F.array(*[F.lit(m).cast("long") for m in _masks(width, allowed)]), lambda m: F.bit_count(m) + spent <= allowed)
    # the other node: the row's own bits with some flipped, below the other prefix
    bits = own.bitwiseAND(F.lit((1 << width) - 1))
    other = F.shiftleft(F.when(left, F.col("b")).otherwise(F.col("a")), width).bitwiseOR(bits)
    pair = lambda m: F.struct(
        F.lit(below).alias("depth"), F.least(own, other.bitwiseXOR(m)).alias("a"), F.greatest(own, other.bitwiseXOR(m)).alias("b")
    )
    return F.transform(masks, pair)


def links(classes: DataFrame, budget: int = 4, node_rows: int = 4096, most_rows: int = 16_384) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints ``fp``, a spanning forest of every node pair: their components are
    those of all links."""
    dealt = cells(classes, budget, node_rows, most_rows)
    in_order = dealt.repartition(*CELL).sortWithinPartitions(*CELL, "r")
    return in_order.mapInArrow(lambda it: _in_cells(it, budget, 1 << 17), "src long, dst long")


def assigned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, budget: int = 4) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row; ``root`` is a fingerprint that stands for the component."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = connected_components(links(classes.select("fp"), budget))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, budget: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; see the module."""
    return assigned(docs, id_col, text_col, shingle_words, budget).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, budget: int = 4) -> DataFrame:
    """The documents, all columns, one of each component: that of the smallest doc_id.

    Rows are told apart by their id. Those whose id is null or repeated, few in a sound table, are told apart by their
    fingerprint as well, and by the whole row written as JSON, of which the first in order stays."""
    own, mark = "_", "_fp"
    while any(c.lower().startswith(own) for c in docs.columns):
        own, mark = own + "_", f"{own}_fp"
    rows = materialise(assigned(docs, id_col, text_col, shingle_words, budget), "components")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp")
    winner = rows.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias(own), F.col("first.fp").alias(f"{own}w"))
    unclear = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias(own))
    key = F.col(f"`{id_col}`").cast("long")
    sound = docs.where(key.isNotNull()).join(unclear, key == F.col(own), "left_anti").join(winner, key == F.col(own), "left_semi")
    odd = docs.join(unclear, key.eqNullSafe(F.col(own)), "left_semi")
    k = docs.columns.index(text_col)

    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle_words) for t in b.column(k).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield b.append_column(mark, pa.array(fp.view(np.int64)))

    odd = odd.mapInArrow(fingerprinted, StructType([*docs.schema.fields, StructField(mark, LongType())]))
    chosen = odd.join(winner, key.eqNullSafe(F.col(own)) & (F.col(mark) == F.col(f"{own}w")), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = chosen.groupBy(key.alias(own), mark).agg(F.min_by(whole, F.to_json(whole)).alias(own + "row"))
    return sound.unionByName(first.select(f"{own}row.*"))
