"""Edges between entities, built from shared evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.entities import first_few
from graphloom.operators.identity import participant_rows
from graphloom.schema import EVIDENCE_LIMIT

EMAIL = "([a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,})"


def first_by(rows: DataFrame, key: str, order: list[str], *keep: str) -> DataFrame:
    """Of each key the first row in order, as an aggregate (no sort, no window)."""
    best = rows.groupBy(key).agg(F.min(F.struct(*order, *keep)).alias("x"))
    return best.select(key, *[F.col(f"x.{k}").alias(k) for k in keep])


def person_keys(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Surface -> person and address -> person, the first person in order for each."""
    persons = entities.where("type = 'person'").select("id", "pos", "aliases", "emails")
    surfaces = persons.select("pos", F.col("id").alias("person_id"), F.explode("aliases").alias("surface"))
    within = persons.select("pos", F.col("id").alias("person_id"), F.explode("aliases").alias("a")).select(
        "pos", "person_id", F.explode(F.regexp_extract_all("a", F.lit(EMAIL), F.lit(1))).alias("address")
    )
    addresses = persons.select("pos", F.col("id").alias("person_id"), F.explode("emails").alias("address")).unionByName(within)
    return first_by(surfaces, "surface", ["pos"], "person_id"), first_by(addresses.withColumn("address", F.lower("address")), "address", ["pos"], "person_id")


def resolved_participants(items: DataFrame, entities: DataFrame) -> DataFrame:
    """(item_id, role, person_id) of the people in each item: by address, else by surface."""
    surfaces, addresses = person_keys(entities)
    rows = participant_rows(items).where("kind = 'person'")
    address = F.when(F.col("id_type") == "email", F.nullif("id_value", F.lit("")))
    found = (
        rows.withColumn("address", address)
        .join(addresses.withColumnRenamed("person_id", "by_address"), "address", "left")
        .join(surfaces.withColumnRenamed("person_id", "by_surface"), F.col("raw") == F.col("surface"), "left")
    )
    return found.select("item_id", "role", F.coalesce("by_address", "by_surface").alias("person_id")).where("person_id is not null").distinct()


def weighed(pairs: DataFrame, kind: str, value: str = "item_id", weight: Column | None = None) -> DataFrame:
    """Edges from distinct (source, target, item_id) rows: weight is the number of items unless given."""
    distinct = pairs.select("source", "target", value).distinct()
    total = distinct.groupBy("source", "target").agg(F.count("*").cast("double").alias("n"))
    evidence = first_few(distinct, ["source", "target"], value, EVIDENCE_LIMIT).withColumnRenamed(value, "evidence_item_ids")
    return total.join(evidence, ["source", "target"]).select("source", "target", F.lit(kind).alias("kind"), (F.col("n") if weight is None else weight).alias("weight"), "evidence_item_ids")


def corresponded(found: DataFrame) -> DataFrame:
    """People who wrote to each other; the weight is the number of items."""
    senders = found.where("role = 'sender'").select("item_id", F.col("person_id").alias("s"))
    receivers = found.where("role in ('recipient', 'cc')").select("item_id", F.col("person_id").alias("t"))
    pairs = senders.join(receivers, "item_id").where("s <> t")
    return weighed(pairs.select(F.least("s", "t").alias("source"), F.greatest("s", "t").alias("target"), "item_id"), "corresponded_with")


def affiliated(members: DataFrame, mentions: DataFrame, n: int = 5) -> DataFrame:
    """Members of organisations; evidence is the organisation's first items."""
    first = first_few(mentions, ["entity_id"], "item_id", n).withColumnRenamed("item_id", "evidence_item_ids")
    return members.join(first, "entity_id").select(F.col("person_id").alias("source"), F.col("entity_id").alias("target"), F.lit("affiliated_with").alias("kind"), F.lit(1.0).alias("weight"), "evidence_item_ids")


def overlaps(mentions: DataFrame, entities: DataFrame, left: str, right: str) -> DataFrame:
    """(source, target, item_id, tpos) where an entity of the left kind and one of the right share an item."""
    typed = mentions.select("entity_id", "item_id").distinct().join(entities.select(F.col("id").alias("entity_id"), "type", "pos", "label"), "entity_id")
    a = typed.where(F.col("type") == left).select(F.col("entity_id").alias("source"), "item_id")
    b = typed.where(F.col("type") == right).select(F.col("entity_id").alias("target"), "item_id", F.struct("pos", "label").alias("tpos"))
    return a.join(b, "item_id")


def best_overlap(shared: DataFrame, kind: str) -> DataFrame:
    """Each source's target with most shared items, the first in order on ties."""
    counts = shared.groupBy("source", "target").agg(F.count("*").alias("n"), F.min("tpos").alias("tpos"))
    best = counts.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), "tpos", "target")).alias("x")).select("source", F.col("x.target").alias("target"))
    return weighed(shared.join(best, ["source", "target"]), kind, weight=F.lit(1.0))


def held_at(shared: DataFrame, least: int = 2) -> DataFrame:
    """Organisations and locations that share ``least`` items or more."""
    return weighed(shared, "held_at").where(F.col("weight") >= least)


def structural(items: DataFrame, entities: DataFrame, mentions: DataFrame, members: DataFrame) -> DataFrame:
    """All structural edges."""
    edges = corresponded(resolved_participants(items, entities)).unionByName(affiliated(members, mentions))
    edges = edges.unionByName(best_overlap(overlaps(mentions, entities, "money", "org"), "paid_to"))
    edges = edges.unionByName(held_at(overlaps(mentions, entities, "org", "location")))
    return edges.unionByName(best_overlap(overlaps(mentions, entities, "document", "subevent"), "document_for"))


def claimed(relations: DataFrame, entity_of: DataFrame) -> DataFrame:
    """Edges from verified claims (conversation_id, subject, object, type, item_id) whose ends are both
    known in (conversation_id, local_entity, entity_id); weight 1, evidence united."""
    end = lambda name, out: entity_of.select("conversation_id", F.col("local_entity").alias(name), F.col("entity_id").alias(out))
    found = relations.join(end("subject", "source"), ["conversation_id", "subject"]).join(end("object", "target"), ["conversation_id", "object"]).where("source <> target")
    edges = None
    keyed = found.select("source", "target", F.col("type").alias("kind"), "item_id").distinct()
    evidence = first_few(keyed.where("item_id <> ''"), ["source", "target", "kind"], "item_id", EVIDENCE_LIMIT).withColumnRenamed("item_id", "evidence_item_ids")
    edges = keyed.select("source", "target", "kind").distinct().join(evidence, ["source", "target", "kind"], "left")
    return edges.select("source", "target", "kind", F.lit(1.0).alias("weight"), F.coalesce("evidence_item_ids", F.array().cast("array<string>")).alias("evidence_item_ids"))


def numbered(edges: DataFrame) -> DataFrame:
    """Edges with an id that follows from their ends and kind, alike in every build."""
    return edges.withColumn("id", T.stable_id(F.lit("e"), F.concat_ws("|", "source", "target", "kind")))


def remapped(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Ends moved along (old_id, new_id); self-loops dropped; equal edges added up, evidence united and cut."""
    to = lambda c: remap.select(F.col("old_id").alias(c), F.col("new_id").alias(f"new_{c}"))
    moved = edges.join(to("source"), "source", "left").join(to("target"), "target", "left")
    moved = moved.select(F.coalesce("new_source", "source").alias("source"), F.coalesce("new_target", "target").alias("target"), "kind", "weight", "evidence_item_ids").where("source <> target")
    keys = ["source", "target", "kind"]
    total = moved.groupBy(*keys).agg(F.sum("weight").alias("weight"))
    evidence = first_few(moved.select(*keys, F.explode("evidence_item_ids").alias("e")), keys, "e", EVIDENCE_LIMIT).withColumnRenamed("e", "evidence_item_ids")
    return total.join(evidence, keys, "left").select(*keys, "weight", F.coalesce("evidence_item_ids", F.array().cast("array<string>")).alias("evidence_item_ids"))


def degree(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """(id, degree) over both ends."""
    ends = edges.select(F.col("source").alias("id"), "weight").unionAll(edges.select(F.col("target").alias("id"), "weight"))
    return ends.groupBy("id").agg((F.sum("weight") if weighted else F.count("*")).alias("degree"))


def ranked_neighbours(edges: DataFrame) -> DataFrame:
    """(id, neighbour, weight, rank), strongest first."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("neighbour"), "weight").unionAll(edges.select(F.col("target").alias("id"), F.col("source").alias("neighbour"), "weight"))
    best = both.groupBy("id", "neighbour").agg(F.max("weight").alias("weight"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "neighbour")))
