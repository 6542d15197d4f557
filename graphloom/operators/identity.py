"""Who is who by hard identifiers: shared mailboxes, identity clusters, and the archive's owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T

# Kinds of participant that never stand for one private person.
NO_IDENTITY = ("placeholder", "group", "system", "org")


def participant_rows(items: DataFrame) -> DataFrame:
    """A row per participant: item_id, item_pos, p_index, the item's place and the participant's fields."""
    return items.select(
        F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "conversation_id", "source_type", F.posexplode("participants").alias("p_index", "p")
    ).select("item_id", "item_pos", "conversation_id", "source_type", "p_index", "p.*")


def mark_shared_mailboxes(items: DataFrame, least: int = 3) -> DataFrame:
    """People who write from an address with ``least`` or more names become kind system."""
    named = participant_rows(items).where("id_type = 'email' and coalesce(id_value, '') <> '' and coalesce(display_name, '') <> ''")
    shared = named.groupBy("id_value").agg(F.count_distinct(F.lower("display_name")).alias("n")).where(F.col("n") >= least).select("id_value")
    # the shared addresses of each item; most items have none
    touched = (
        participant_rows(items).where("id_type = 'email'").join(shared, "id_value", "left_semi").groupBy("item_id").agg(F.collect_set("id_value").alias("__shared"))
    )
    joined = items.join(touched.withColumnRenamed("item_id", "__id"), F.col("id") == F.col("__id"), "left").drop("__id")
    downgraded = F.transform(
        "participants",
        lambda p: F.when(
            (p["id_type"] == "email") & (p["kind"] == "person") & F.coalesce(F.array_contains("__shared", p["id_value"]), F.lit(False)), p.withField("kind", F.lit("system"))
        ).otherwise(p),
    )
    return joined.withColumn("participants", F.when(F.col("__shared").isNull(), F.col("participants")).otherwise(downgraded)).drop("__shared")


def identity_members(items: DataFrame) -> DataFrame:
    """(key, item_id, p_index, ...) of participants with an address or number that may stand for a person."""
    rows = participant_rows(items).where(~F.col("kind").isin(*NO_IDENTITY) & F.col("id_type").isin("email", "phone") & (F.coalesce("id_value", F.lit("")) != ""))
    ident = F.when(F.col("id_type") == "email", F.lower(F.trim("id_value"))).otherwise(F.col("id_value"))
    return rows.withColumn("identifier", ident).withColumn("key", F.concat("id_type", F.lit(":"), "identifier"))


def identity_clusters(members: DataFrame) -> DataFrame:
    """A row per identifier: names, members, reach. The position is that of its first member."""
    return members.groupBy("key", "id_type", "identifier").agg(
        F.min(F.struct("item_pos", "p_index")).alias("first"),
        F.array_sort(F.collect_set(F.when(F.col("display_name") != "", F.col("display_name")))).alias("names"),
        F.count_distinct("conversation_id").alias("conversations"),
        F.count_distinct("source_type").alias("channels"),
        F.count_if(F.col("role").isin("recipient", "cc")).alias("received"),
        F.array_sort(F.collect_set("source_type")).alias("source_types"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    )


def owner_scores(clusters: DataFrame) -> DataFrame:
    """Conversations + 2 channels + a quarter of what was received."""
    score = F.col("conversations") + 2 * F.col("channels") + 0.25 * F.col("received")
    return clusters.select("key", "first", "names", "identifier", score.cast("double").alias("score"))


def owner_pick(scores: DataFrame, margin: float = 1.15) -> DataFrame:
    """The best score's key and label, and whether it leads by the margin; first seen wins ties. No row without clusters."""
    top = scores.orderBy(F.desc("score"), "first").limit(2)
    ranked = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "first"))).withColumn(
        "runner_up", F.lead("score", 1, 0.0).over(Window.orderBy(F.desc("score"), "first"))
    )
    real = F.filter("names", lambda n: ~n.contains("@"))
    label = F.when(F.size(real) > 0, F.when(F.size(F.filter(real, lambda n: F.length(n) > 1)) > 0, T.best_label(real, F.array().cast("array<string>"))).otherwise(real[0]))
    return ranked.where("place = 1").select(
        "key", "score", F.coalesce(label, F.get("names", F.lit(0))).alias("label"), (F.col("score") >= F.greatest(F.lit(1.0), F.col("runner_up") * margin)).alias("confident"), "identifier"
    )


def chat_owner(items: DataFrame, least: int = 2) -> DataFrame:
    """(item_id, p_index) of the chat sender who is in most conversations, if in ``least`` or more."""
    rows = participant_rows(items).where("source_type = 'whatsapp' and role = 'sender' and kind in ('person', 'unknown')")
    named = rows.withColumn("name", F.trim(F.coalesce(F.nullif("display_name", F.lit("")), "raw", F.lit("")))).where("name <> ''")
    reach = named.groupBy("name").agg(F.count_distinct("conversation_id").alias("n"), F.min(F.struct("item_pos", "p_index")).alias("first"))
    best = reach.orderBy(F.desc("n"), "first").limit(1).where(F.col("n") >= least).select("name")
    return named.join(F.broadcast(best), "name", "left_semi").select("item_id", "p_index")


def owner_refs(items: DataFrame, members: DataFrame, owner: DataFrame) -> DataFrame:
    """Distinct (item_id, p_index) that are the owner: the winning cluster, every self, and the chats' owner.
    Without any identity cluster there is no owner."""
    mine = members.join(F.broadcast(owner.select("key")), "key", "left_semi").select("item_id", "p_index")
    own = participant_rows(items).where("kind = 'self'").select("item_id", "p_index")
    extra = own.unionByName(chat_owner(items)).join(F.broadcast(owner.select(F.lit(1).alias("one"))), F.lit(True), "left_semi")
    return mine.unionByName(extra).distinct()


def seed_agrees(owner: DataFrame, seed: list[str]) -> DataFrame:
    """Whether the owner's identifier is one of the given ones; a cross-check only."""
    return owner.select("key", F.lower("identifier").isin(*[s.strip().lower() for s in seed if s.strip()] or [""]).alias("seed_agrees"))
