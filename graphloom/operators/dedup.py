"""Exact and near duplicates of items.

Near duplicates are found by an inverted index over word shingles with a prefix filter that loses nothing: two sets
with Jaccard similarity t or more share one of the rarest n - ceil(t n) + 1 shingles of each. Items with equal shingle
sets collapse to one representative before the join, so copies never make pairs; clusters are the connected components
of the representatives' pairs, with the copies joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.components import connected_components
from graphloom.scratch import materialise


def exact_groups(items: DataFrame, key: str = "content_hash", id_col: str = "id", pos: str = "pos") -> DataFrame:
    """(key, canonical_id, n) of the keys that several items share. Members aren't listed, as a key may have a third of all items:
    ``exact_canonical`` has a row for each."""
    return items.groupBy(key).agg(F.min_by(id_col, pos).alias("canonical_id"), F.count("*").alias("n")).where("n > 1")


def exact_canonical(items: DataFrame, key: str = "content_hash", id_col: str = "id", pos: str = "pos") -> DataFrame:
    """(id, canonical_id) of every item that is a later copy. Only the key's first item is aggregated, so a key that
    very many items share is a partial aggregate and a skewed join, never a collected list."""
    first = exact_groups(items, key, id_col, pos)
    return items.join(first.drop("n"), key).where(F.col(id_col) != F.col("canonical_id")).select(F.col(id_col).alias("id"), "canonical_id")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def shingled(items: DataFrame, id_col: str, text_col: str, block: Column, k: int = 3, min_tokens: int = 8) -> DataFrame:
    """(id, block, sh) of the items with enough words; sh holds the hashes of their distinct shingles, sorted."""
    tokens = items.select(F.col(id_col).alias("id"), block.alias("block"), T.words(text_col).alias("tokens")).where(F.size("tokens") >= min_tokens)
    return tokens.select("id", "block", F.array_sort(F.array_distinct(F.transform(T.shingles(F.col("tokens"), k), lambda s: F.xxhash64(s)))).alias("sh"))


def representatives(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, block, sh) of the distinct shingle sets, and (id, rep) of all items. The sets are written once; both results read them."""
    keyed = materialise(sets.withColumn("same", F.xxhash64(F.array_join(F.transform("sh", lambda h: h.cast("string")), ","))), "shingles")
    named = keyed.groupBy("block", "same").agg(F.min("id").alias("rep"))
    chosen = named.select("block", F.col("rep").alias("id"))
    reps = keyed.join(chosen, ["block", "id"]).select(F.col("id").alias("rep"), "block", "sh")
    return materialise(reps, "representatives"), keyed.select("id", "block", "same").join(named, ["block", "same"]).select("id", "rep")


def near_pairs(reps: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(a, b, similarity), a < b, of representatives in one block with a Jaccard similarity from threshold on.

    Each set's shingles are ranked from the rarest on. Two sets can only be that similar if they share a shingle in the first places of
    both, and if what is left behind that place is enough (the first shared place always passes)."""
    sets = reps.select("rep", "block", "sh", F.size("sh").alias("n"))
    long = sets.select("rep", "block", "n", F.explode("sh").alias("h"))
    held_by = long.groupBy("block", "h").agg(F.count("*").alias("df")).where("df > 1")
    # a shingle of one set alone ranks first and meets nobody: only how many there are of them matters
    shared = long.join(held_by, ["block", "h"])
    ranked = shared.groupBy("rep", "block", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("by_df"))
    length = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    alone = F.col("n") - F.size("by_df")
    first = ranked.withColumn("alone", alone).select("rep", "block", "n", "alone", F.posexplode(F.slice("by_df", F.lit(1), F.greatest(F.lit(0), length - alone))).alias("at", "x"))
    place = materialise(first.select("rep", "block", "n", (F.col("alone") + F.col("at")).alias("place"), F.col("x.h").alias("h")), "prefixes")
    left = place.select("block", "h", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"))
    right = place.select("block", "h", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    longer, shorter = F.greatest("na", "nb"), F.least("na", "nb")
    enough = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9
    met = left.join(right, ["block", "h"]).where((F.col("a") < F.col("b")) & (shorter >= longer * threshold - 1e-9) & enough)
    pairs = met.select("a", "b").distinct()
    words = reps.select("rep", "sh")
    scored = (
        pairs.join(words.select(F.col("rep").alias("a"), F.col("sh").alias("sa")), "a")
        .join(words.select(F.col("rep").alias("b"), F.col("sh").alias("sb")), "b")
        .select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("similarity"))
    )
    return scored.where(F.col("similarity") >= threshold)


def near_clusters(items: DataFrame, id_col: str = "id", text_col: str = "body", pos: str = "pos", block: Column | None = None, threshold: float = 0.6, min_tokens: int = 8) -> DataFrame:
    """(id, canonical_id) of every item in a near-duplicate cluster of two or more; canonical is the first by pos."""
    sets = shingled(items, id_col, text_col, block if block is not None else F.col("source_type"), min_tokens=min_tokens)
    reps, members = representatives(sets)
    linked = connected_components(near_pairs(reps, threshold), "a", "b")
    cluster = members.join(linked, members["rep"] == linked["node"], "left").select("id", F.coalesce("component", "rep").alias("cluster"))
    placed = cluster.join(items.select(F.col(id_col).alias("id"), F.col(pos).alias("pos")), "id")
    first = placed.groupBy("cluster").agg(F.min_by("id", "pos").alias("canonical_id"), F.count("*").alias("n")).where("n > 1")
    return placed.join(first, "cluster").select("id", "canonical_id")


def canonical(items: DataFrame, threshold: float = 0.6, min_tokens: int = 8) -> DataFrame:
    """(id, canonical_id) of every duplicate: its first exact copy if it has one before it, else its cluster's first.
    One hop: a canonical item may itself be a near duplicate; ``root_of`` follows the hops."""
    exact = exact_canonical(items)
    near = near_clusters(items, threshold=threshold, min_tokens=min_tokens).where("id <> canonical_id")
    both = exact.withColumnRenamed("canonical_id", "exact_id").join(near.withColumnRenamed("canonical_id", "near_id"), "id", "full")
    return both.select("id", F.coalesce("exact_id", "near_id").alias("canonical_id"))


def root_of(canon: DataFrame) -> DataFrame:
    """(id, root_id): two hops suffice, as an exact copy's canonical item can only be a near duplicate."""
    up = canon.select(F.col("id").alias("canonical_id"), F.col("canonical_id").alias("next_id"))
    return canon.join(up, "canonical_id", "left").select("id", F.coalesce("next_id", "canonical_id").alias("root_id"))


def mark_duplicates(items: DataFrame, canon: DataFrame) -> DataFrame:
    """The items with duplicate_of set from the canonical map, null for canonical items."""
    found = canon.select(F.col("id").alias("__id"), F.col("canonical_id").alias("__to"))
    joined = items.drop("duplicate_of").join(found, items["id"] == found["__id"], "left")
    return joined.withColumn("duplicate_of", F.when(F.col("__to") != F.col("id"), F.col("__to"))).drop("__id", "__to")


def canonical_items(items: DataFrame) -> DataFrame:
    """P06."""
    return items.where(F.col("duplicate_of").isNull())


def copy_counts(items: DataFrame, near: DataFrame, canon: DataFrame) -> DataFrame:
    """Redundant copies: exact, near (an exact copy of a longer text counts in both), and marked items."""
    exact = items.groupBy("content_hash").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("exact_dupes"))
    close = near.agg(F.count_if(F.col("id") != F.col("canonical_id")).alias("near_dupes"))
    marked = canon.agg(F.count("*").alias("n_duplicates"))
    row = F.lit(1).alias("one")  # each side is a single row
    return exact.select("*", row).join(close.select("*", row), "one").join(marked.select("*", row), "one").drop("one")
