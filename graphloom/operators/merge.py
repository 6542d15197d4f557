"""Conservative merging of entities by name, and ids that follow from content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import currency as C
from graphloom.functions import text as T
from graphloom.operators.entities import Found
from graphloom.schema import FORMS_LIMIT, ROLE_MAILBOXES


def name_groups(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities with the key of their name, their number of mentions, and whether their group may be merged.

    A group is vetoed as a whole if one of its people has a role mailbox, or if two of them have different addresses in
    one domain. The second test needs no pairs: in each domain the members' address sets must be nested, so it is
    enough that each set contains the next smaller one.
    """
    counted = entities.join(mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n_mentions")), "id", "left").fillna(0, ["n_mentions"])
    key = F.when(F.col("type") == "person", T.person_key("label")).otherwise(T.label_key("label"))
    role = (F.col("type") == "person") & F.exists("emails", lambda e: T.is_role_mailbox(e, ROLE_MAILBOXES))
    keyed = counted.withColumns({"key": key, "role": role})
    by_domain = keyed.select("type", "key", "id", F.explode("emails").alias("email")).groupBy("type", "key", F.substring_index(F.lower("email"), "@", -1).alias("domain"), "id")
    sets = by_domain.agg(F.array_sort(F.collect_set("email")).alias("held")).withColumn("n", F.size("held"))
    smaller = F.lag("held").over(Window.partitionBy("type", "key", "domain").orderBy("n", "held", "id"))
    clash = sets.withColumn("smaller", smaller).where(F.size(F.array_except("smaller", "held")) > 0).select("type", "key", F.lit(True).alias("clash")).distinct()
    groups = keyed.groupBy("type", "key").agg(F.count("*").alias("members"), F.bool_or("role").alias("role_in_group"))
    able = groups.join(clash, ["type", "key"], "left").select(
        "type", "key", ((F.col("members") > 1) & ~F.col("role_in_group") & F.col("clash").isNull() & (F.size(F.split("key", " ")) >= 2)).alias("merge")
    )
    return keyed.drop("role").join(able, ["type", "key"])


def merge_by_name(found: Found) -> tuple[Found, DataFrame, DataFrame]:
    """The merged entities, (old_id, new_id) of what was merged away, and the merge rows.

    The entity with most mentions stays, then the longest label, then the first. It takes over mentions it doesn't have
    yet, all addresses and surfaces, and the owner's mark.
    """
    groups = name_groups(found.entities, found.mentions)
    going = groups.where("merge")
    order = F.struct((-F.col("n_mentions")).alias("m"), (-F.length("label")).alias("l"), "place", "pos", "id")
    kept = going.groupBy("type", "key").agg(
        F.min(order).getField("id").alias("new_id"),
        F.array_distinct(F.flatten(F.collect_list("emails"))).alias("all_emails"),
        F.array_distinct(F.concat(F.flatten(F.collect_list("aliases")), F.collect_list("label"))).alias("surfaces"),
        F.bool_or(F.coalesce("owner", F.lit(False))).alias("any_owner"),
    )
    remap = going.join(kept.select("type", "key", "new_id"), ["type", "key"]).where("id <> new_id").select(F.col("id").alias("old_id"), "new_id")
    joined = found.entities.join(remap, F.col("id") == F.col("old_id"), "left_anti").join(kept.drop("type", "key"), F.col("id") == F.col("new_id"), "left")
    hit = F.col("new_id").isNotNull()
    entities = joined.withColumns(
        {
            "emails": F.when(hit, F.array_sort("all_emails")).otherwise(F.col("emails")),
            "aliases": F.when(hit, F.array_sort(F.array_remove("surfaces", F.col("label")))).otherwise(F.col("aliases")),
            "owner": F.when(hit & F.col("any_owner"), F.lit(True)).otherwise(F.col("owner")),
        }
    ).select(*found.entities.columns)
    moved = found.mentions.join(remap, F.col("entity_id") == F.col("old_id"))
    stay = found.mentions.join(remap, F.col("entity_id") == F.col("old_id"), "left_anti")
    new = moved.groupBy(F.col("new_id").alias("entity_id"), "item_id", "text").agg(F.min("pos").alias("pos"))
    new = new.join(stay.select("entity_id", "item_id", "text").distinct(), ["entity_id", "item_id", "text"], "left_anti")
    merges = kept.select(F.col("new_id").alias("canonical_id"), F.slice(F.array_sort("surfaces"), 1, FORMS_LIMIT).alias("merged_forms"), F.lit("same full name, no conflicting identifiers").alias("rationale"))
    return Found(entities, stay.unionByName(new.select(*stay.columns))), remap, merges


def content_key(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities with what their id is made of."""
    first = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.min("item_id").alias("first_item"))
    named = F.concat(F.lit("name:"), T.label_key("label"), F.lit(":"), F.coalesce("first_item", F.lit("")))
    key = (
        F.when((F.col("type") == "person") & (F.size("emails") > 0), F.concat(F.lit("emails:"), F.array_join(F.array_sort("emails"), ",")))
        .when(F.col("type") == "person", named)
        .when(F.col("type") == "money", F.concat(F.lit("amount:"), C.float_text(F.col("amount"))))
        .otherwise(T.label_key("label"))
    )
    return entities.join(first, "id", "left").withColumn("content_key", key).drop("first_item")


def stable_ids(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(old_id, new_id); entities with the same key are told apart by _1, _2 ... in order."""
    keyed = content_key(entities, mentions).withColumn("candidate", T.stable_id("type", "content_key"))
    nth = F.row_number().over(Window.partitionBy("candidate").orderBy("place", "pos", "id")) - 1
    return keyed.withColumn("nth", nth).select(F.col("id").alias("old_id"), F.when(F.col("nth") == 0, F.col("candidate")).otherwise(F.concat_ws("_", "candidate", "nth")).alias("new_id"))


def renamed(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """A column of ids moved along (old_id, new_id); ids not in it stay."""
    at = rows.columns
    found = rows.join(ids.select(F.col("old_id").alias("__old"), F.col("new_id").alias("__new")), rows[column] == F.col("__old"), "left")
    return found.withColumn(column, F.coalesce("__new", column)).select(*at)


def renamed_list(rows: DataFrame, key: str, column: str, ids: DataFrame) -> DataFrame:
    """An array column of ids moved along, order kept."""
    long = rows.select(key, F.posexplode(column).alias("k", "__x"))
    back = renamed(long, "__x", ids).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "__x"))), lambda x: x["__x"]).alias("__l"))
    return rows.join(back, key, "left").withColumn(column, F.coalesce("__l", F.array().cast("array<string>"))).drop("__l")


def chained(first: DataFrame, second: DataFrame) -> DataFrame:
    """(old_id, new_id) of two moves, one after the other."""
    through = renamed(first, "new_id", second)
    rest = second.join(first.select(F.col("old_id").alias("__o")), F.col("old_id") == F.col("__o"), "left_anti")
    return through.unionByName(rest)


def corrected_currency(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """The entities with a user's decisions (entity_id, currency) laid over them; tables are never updated in place."""
    known: Column = F.col("__currency").isNotNull() & (F.col("type") == "money")
    joined = entities.join(decisions.select(F.col("entity_id").alias("id"), F.col("currency").alias("__currency")), "id", "left")
    yes, no = F.lit(True), F.lit(False)
    return joined.withColumns(
        {
            "currency": F.when(known, F.col("__currency")).otherwise(F.col("currency")),
            "currency_resolved": F.when(known, yes).otherwise(F.col("currency_resolved")),
            "currency_ambiguous": F.when(known, no).otherwise(F.col("currency_ambiguous")),
            "needs_review": F.when(known, no).otherwise(F.col("needs_review")),
            "label": F.when(known, C.money_label(F.col("amount"), F.col("__currency"), yes, no)).otherwise(F.col("label")),
        }
    ).select(*entities.columns)
