"""The graph's contract: rules as queries over its tables, and repair."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schema import EDGE_KINDS, ENTITY_TYPES, LABEL_LIMIT


class ContractError(ValueError):
    """A strict check found a violation."""


@dataclass
class Graph:
    """items (id ...), entities, mentions (entity_id, item_id, text, pos), edges and merges."""

    items: DataFrame
    entities: DataFrame
    mentions: DataFrame
    edges: DataFrame
    merges: DataFrame


def _said(rows: DataFrame, rule: str, id_: Column | str, detail: Column | str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), (F.col(id_) if isinstance(id_, str) else id_).alias("id"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def _numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _known(c: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


def violations(g: Graph, owner_confident: bool = False, kinds: tuple[str, ...] = EDGE_KINDS) -> DataFrame:
    """(rule, id, detail) of all breaches of R1 to R11. Rule names and details are fixed values of the contract. A null type, kind
    or evidence list is a breach like a wrong or an empty one."""
    items = g.items.select(F.col("id").alias("item_id"))
    ids = g.entities.select(F.col("id").alias("known")).distinct()
    e, ed = g.entities, g.edges
    out = [
        _said(_numbered(e, ["id"], ["place", "pos"]).where("__n > 1"), "R1_duplicate_id", "id", "duplicate entity ID"),
        _said(e.where(~_known("type", ENTITY_TYPES)), "R2_invalid_type", "id", F.concat(F.lit("unknown type "), F.coalesce("type", F.lit("null")))),
        _said(e.where(_blank("label")), "R3_empty_label", "id", "empty label"),
        _said(e.where(~_blank("label") & (F.length("label") > LABEL_LIMIT)), "R3_label_too_long", "id", F.concat(F.lit("label length "), F.length("label"), F.lit(f" > {LABEL_LIMIT}"))),
        _said(e.join(g.mentions, e["id"] == g.mentions["entity_id"], "left_anti"), "R4_no_mentions", "id", "entity has no mentions"),
    ]
    strange = g.mentions.join(items, "item_id", "left_anti").join(ids, F.col("entity_id") == F.col("known"), "left_semi")
    out.append(_said(strange.groupBy("entity_id").count(), "R4_unknown_mention_item", "entity_id", F.concat("count", F.lit(" mention item_ids not in corpus"))))
    owners = e.agg(F.count_if(F.coalesce("owner", F.lit(False))).alias("n"))
    out.append(_said(owners.where("n > 1"), "R5_multiple_owners", F.lit("graph"), F.concat("n", F.lit(" entities marked owner"))))
    out.append(_said(owners.where((F.col("n") == 0) & F.lit(owner_confident)), "R5_owner_missing", F.lit("graph"), "the owner is certain but no entity is marked"))
    for end in ("source", "target"):
        out.append(_said(ed.join(ids, F.col(end) == F.col("known"), "left_anti"), f"R6_dangling_{end}", "id", F.concat(F.lit(f"{end} "), F.coalesce(end, F.lit("null")), F.lit(" not in entities"))))
    out += [
        _said(ed.where("source = target"), "R6_self_loop", "id", "self-loop edge"),
        _said(ed.where(~_known("kind", kinds)), "R7_invalid_kind", "id", F.concat(F.lit("unknown edge kind "), F.coalesce("kind", F.lit("null")))),
        _said(ed.where(F.coalesce(F.size("evidence_item_ids"), F.lit(0)) <= 0), "R8_no_evidence", "id", "edge has no evidence items"),
    ]
    evidence = ed.select("id", F.explode("evidence_item_ids").alias("item_id")).join(items, "item_id", "left_anti")
    out.append(_said(evidence.groupBy("id").count(), "R8_unknown_evidence", "id", F.concat("count", F.lit(" evidence item_ids not in corpus"))))
    out.append(_said(_numbered(ed, ["source", "target", "kind"], ["id"]).where("__n > 1"), "R9_duplicate_edge", "id", "duplicate (source, target, kind)"))
    out.append(_said(g.merges.join(ids, F.col("canonical_id") == F.col("known"), "left_anti"), "R10_merge_bad_id", "canonical_id", "merge record references non-existent entity"))
    money = e.where("type = 'money'")
    out.append(_said(money.where("amount is null"), "R11_money_no_amount", "id", "money entity missing numeric amount"))
    unsure = (F.coalesce("currency", F.lit("")) == "") & ~F.coalesce("needs_review", F.lit(False))
    out.append(_said(money.where(unsure), "R11_money_no_currency", "id", "money entity has no currency and needs no review"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def check(g: Graph, strict: bool = False, **options) -> DataFrame:
    """The violations; strict raises on the first."""
    found = violations(g, **options)
    if strict and (first := found.orderBy("rule", "id").first()):
        raise ContractError(f"{first.rule} [{first.id}]: {first.detail}")
    return found


def repair(g: Graph, kinds: tuple[str, ...] = EDGE_KINDS) -> tuple[Graph, DataFrame]:
    """The graph without what breaks R1, R3, R4, R6 to R10, and (action, id) of what was done. Wrong types, several
    owners and incomplete amounts (R2, R5, R11) are left as they are."""
    items = g.items.select(F.col("id").alias("item_id"))
    ranked = _numbered(g.entities, ["id"], ["place", "pos", "label"])
    first = ranked.where("__n = 1").drop("__n")
    done = [ranked.where("__n > 1").select(F.lit("removed duplicate entity").alias("action"), "id")]
    long = F.length("label") > LABEL_LIMIT
    done.append(first.where(_blank("label")).select(F.lit("set empty label to its ID").alias("action"), "id"))
    done.append(first.where(~_blank("label") & long).select(F.lit("truncated label").alias("action"), "id"))
    if "full_label" not in first.columns:
        first = first.withColumn("full_label", F.lit(None).cast("string"))
    first = first.withColumn("full_label", F.when(~_blank("label") & long, F.col("label")).otherwise(F.col("full_label")))
    cut = F.concat(F.left("label", F.lit(LABEL_LIMIT - 1)), F.lit("…"))
    first = first.withColumn("label", F.when(_blank("label"), F.col("id")).when(long, cut).otherwise(F.col("label")))
    ids = first.select(F.col("id").alias("entity_id"))
    mentions = g.mentions.join(items, "item_id", "left_semi").join(ids, "entity_id", "left_semi").select(*g.mentions.columns)
    lost = g.mentions.join(items, "item_id", "left_anti").join(ids, "entity_id", "left_semi")
    done.append(lost.select(F.lit("dropped unknown-item mentions").alias("action"), F.col("entity_id").alias("id")).distinct())
    told = mentions.select(F.col("entity_id").alias("id")).distinct()
    entities = first.join(told, "id", "left_semi")
    done.append(first.join(told, "id", "left_anti").select(F.lit("removed entity with no valid mentions").alias("action"), "id"))

    valid = entities.select(F.col("id").alias("known"))
    tied = g.edges.join(valid, F.col("source") == F.col("known"), "left_semi").join(valid, F.col("target") == F.col("known"), "left_semi")
    done.append(g.edges.join(tied.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_anti").select(F.lit("removed edge with dangling endpoint").alias("action"), "id"))
    done.append(tied.where("source = target").select(F.lit("removed self-loop edge").alias("action"), "id"))
    proper = tied.where("source <> target")
    done.append(proper.where(~_known("kind", kinds)).select(F.lit("removed edge with unknown kind").alias("action"), "id"))
    proper = proper.where(_known("kind", kinds))
    real = proper.select("id", F.posexplode("evidence_item_ids").alias("k", "item_id")).join(items, "item_id", "left_semi")
    real = real.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item_id"))), lambda x: x["item_id"]).alias("__real"))
    grounded = proper.join(real, "id").withColumn("evidence_item_ids", F.col("__real")).drop("__real")
    done.append(proper.join(real, "id", "left_anti").select(F.lit("removed edge with no valid evidence").alias("action"), "id"))
    ranked_edges = _numbered(grounded, ["source", "target", "kind"], ["id"])
    done.append(ranked_edges.where("__n > 1").select(F.lit("removed duplicate edge").alias("action"), "id"))
    edges = ranked_edges.where("__n = 1").select(*g.edges.columns)
    merges = g.merges.join(valid, F.col("canonical_id") == F.col("known"), "left_semi")
    actions = done[0]
    for more in done[1:]:
        actions = actions.unionByName(more)
    return replace(g, entities=entities, mentions=mentions, edges=edges, merges=merges), actions
