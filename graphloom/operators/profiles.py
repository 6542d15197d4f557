"""Profiles of what a name may stand for, the blocks in which they are compared, and what comparison decided."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.components import connected_components
from graphloom.operators.order import ranked
from graphloom.schema import FORMS_LIMIT, MENTION_TYPES

MOST = 12
_LIST = "array<string>"


def _listed(c: str):
    return F.array_sort(F.collect_set(c))


def conversation_profiles(mentions: DataFrame) -> DataFrame:
    """(conversation_id, local_entity, profile_id): numbered in order of conversation and local name; the type is
    that of the first mention."""
    first = mentions.groupBy("conversation_id", "local_entity").agg(F.min_by("type", "pos").alias("type"))
    known = F.when(F.lower("type").isin(*MENTION_TYPES), F.lower("type")).otherwise("unknown")
    return ranked(first, ["conversation_id", "local_entity"]).select("conversation_id", "local_entity", F.concat(known, F.lit(":"), F.col("n").cast("string")).alias("profile_id"), F.col("n").alias("pos"))


def from_mentions(mentions: DataFrame, items: DataFrame) -> DataFrame:
    """A profile per conversation and local name, from mentions (conversation_id, local_entity, pos, surface,
    type, item_id, clues). The last type names the profile; addresses and numbers among the clues are identifiers."""
    ids = conversation_profiles(mentions).withColumnRenamed("pos", "n")
    rows = mentions.join(ids, ["conversation_id", "local_entity"])
    counted = rows.groupBy("profile_id", "surface").agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    surfaces = counted.groupBy("profile_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("surface", "c")))).alias("surfaces"),
    )
    sampled = rows.withColumn("k", F.row_number().over(Window.partitionBy("profile_id").orderBy("pos"))).where("k <= 3 and surface <> ''")
    samples = sampled.groupBy("profile_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "surface"))), lambda x: x["surface"]).alias("sample_lines"))
    clues = rows.select("profile_id", F.explode(F.coalesce("clues", F.create_map().cast("map<string,string>"))).alias("kind", "value")).where("value <> ''")
    hard = F.col("kind").isin("email", "phone")
    identifiers = clues.where(hard).groupBy("profile_id").agg(F.array_sort(F.collect_set(F.lower(F.trim("value")))).alias("identifiers"))
    soft = clues.where(~hard).groupBy("profile_id", "kind").agg(_listed("value").alias("v")).groupBy("profile_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "v")))).alias("clues"))
    last = F.lower(F.max_by("type", "pos"))
    base = rows.groupBy("profile_id").agg(F.first("n").alias("pos"), last.alias("t"), _listed("item_id").alias("item_ids"))
    seen = rows.join(items.select(F.col("id").alias("item_id"), "source_type"), "item_id").groupBy("profile_id").agg(_listed("source_type").alias("channels"))
    for part in (surfaces, samples, identifiers, soft, seen):
        base = base.join(part, "profile_id", "left")
    none = F.array().cast(_LIST)
    return base.select(
        F.col("profile_id").alias("id"), F.col("pos").cast("long").alias("pos"), F.when(F.col("t").isin(*MENTION_TYPES), F.col("t")).otherwise("unknown").alias("type"), F.col("surfaces").cast("map<string,bigint>").alias("surfaces"),
        F.coalesce("identifiers", none).alias("identifiers"), F.coalesce("clues", F.create_map().cast("map<string,array<string>>")).alias("clues"), F.coalesce("channels", none).alias("channels"),
        "item_ids", F.coalesce("sample_lines", none).alias("sample_lines"), none.alias("co_profile_ids"),
    )


def co_occurring(mentions: DataFrame) -> DataFrame:
    """(id, other, items) of profiles that share items. Nothing in the build reads it, so it isn't part of a profile: a busy item
    has as many rows as pairs of profiles."""
    ids = conversation_profiles(mentions).select("conversation_id", "local_entity", F.col("profile_id").alias("id"))
    told = mentions.join(ids, ["conversation_id", "local_entity"]).select("item_id", "id").distinct()
    both = told.join(told.select("item_id", F.col("id").alias("other")), "item_id").where("id <> other")
    return both.groupBy("id", "other").agg(F.count("*").alias("items"))


def from_clusters(clusters: DataFrame) -> DataFrame:
    """A person's profile per identity cluster; names and identifier are its surfaces."""
    surfaces = F.array_distinct(F.concat("names", F.array("identifier")))
    return clusters.select(
        F.concat(F.lit("identity:"), "key").alias("id"), F.col("first.item_pos").alias("pos"), F.lit("person").alias("type"),
        F.map_from_arrays(surfaces, F.transform(surfaces, lambda s: F.lit(1).cast("long"))).alias("surfaces"), F.array("identifier").alias("identifiers"),
        F.create_map().cast("map<string,array<string>>").alias("clues"), F.col("source_types").alias("channels"), "item_ids", F.slice("names", 1, 3).alias("sample_lines"), F.array().cast(_LIST).alias("co_profile_ids"),
    )


def canonical_surface(surfaces: str = "surfaces"):
    """The most used surface, the longest of those, then the first."""
    ranked = F.transform(F.map_entries(surfaces), lambda e: F.struct((-e["value"]).alias("c"), (-F.length(e["key"])).alias("l"), e["key"].alias("s")))
    return F.get(F.array_sort(ranked), F.lit(0))["s"]


def serialised(profiles: DataFrame) -> DataFrame:
    """(id, json) as a client sees a profile."""
    body = F.struct("id", "type", "surfaces", F.array_sort("identifiers").alias("identifiers"), F.transform_values("clues", lambda k, v: F.array_sort(v)).alias("clues"), F.array_sort("channels").alias("channels"), F.size("item_ids").alias("item_count"), "sample_lines")
    return profiles.select("id", F.to_json(body).alias("json"))


# ---- blocking ----


def block_keys(profiles: DataFrame) -> DataFrame:
    """(type, kind, key, id): what may join profiles of a type. Rows are kept with repeats, as a profile listed
    twice under a key counts twice against the limit."""
    base = profiles.select("id", "type", "identifiers", "channels", "item_ids", F.map_keys("surfaces").alias("names"))
    ident = base.select("id", "type", F.explode("identifiers").alias("i"))
    surface = base.select("id", "type", F.when(F.size("channels") > 0, F.col("channels")).otherwise(F.array(F.lit("_"))).alias("channels"), F.explode("names").alias("s"))
    of = lambda rows, kind, key: rows.select("type", F.lit(kind).alias("kind"), key.alias("key"), "id")
    parts = [
        of(ident, "identifier", F.col("i")),
        of(ident.where(F.length(T.email_stem("i")) >= 6), "stem", T.email_stem("i")),
        of(ident.where((F.col("type") == "org") & F.col("i").contains("@")), "domain", T.email_domain("i")),
        of(surface.select("id", "type", F.explode(T.name_tokens("s")).alias("t")), "token", F.col("t")),
        of(surface.where("type = 'person'").select("id", "type", T.first_name("s").alias("f"), F.explode("channels").alias("c")).where("f is not null"), "first", F.concat_ws("|", "f", "c")),
        of(base.select("id", "type", F.explode("item_ids").alias("i")), "item", F.col("i")),
    ]
    keys = parts[0]
    for p in parts[1:]:
        keys = keys.unionByName(p)
    return keys


def containment_edges(profiles: DataFrame) -> DataFrame:
    """Locations one of whose names contains another's. Containment is word by word here in the index and exact in
    the test: names share their rarest four-letter piece, so no pair of all locations is formed."""
    names = profiles.where("type = 'location'").select("id", F.explode(F.map_keys("surfaces")).alias("s")).select("id", T.blocking_key("s").alias("name")).where("name <> ''").distinct()
    gram = 4
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("name") - (gram - 1))), lambda i: F.substr("name", i, F.lit(gram)))
    long = names.where(F.length("name") >= gram).select("id", "name", F.explode(F.array_distinct(grams)).alias("g"))
    rare = long.groupBy("g").agg(F.count("*").alias("n"))
    key = long.join(rare, "g").groupBy("id", "name").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    inner = key.select(F.col("id").alias("src"), F.col("name").alias("small"), "g")
    outer = long.select(F.col("id").alias("dst"), F.col("name").alias("large"), "g")
    found = inner.join(outer, "g").where((F.col("src") != F.col("dst")) & F.col("large").contains(F.col("small"))).select("src", "dst")
    # names shorter than a gram are few; they are looked up in a small, checked list
    tiny = names.where(F.length("name") < gram).select(F.col("id").alias("src"), F.col("name").alias("small"))
    pieces = names.select(F.col("id").alias("dst"), F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(gram - 1)), lambda w: F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr("name", i, w)))))).alias("small"))
    return found.unionByName(tiny.join(pieces, "small").where("src <> dst").select("src", "dst")).distinct()


def block_edges(profiles: DataFrame, most: int = MOST) -> DataFrame:
    """Edges within each key, as stars around its first profile. Keys by word, first name and item count only up
    to ``most`` rows."""
    keys = block_keys(profiles).where("key <> ''")
    sized = keys.groupBy("type", "kind", "key").agg(F.count("*").alias("n"), F.min("id").alias("dst"))
    used = sized.where(~F.col("kind").isin("token", "first", "item") | (F.col("n") <= most))
    stars = keys.join(used, ["type", "kind", "key"]).where("id <> dst").select(F.col("id").alias("src"), "dst")
    return stars.unionByName(containment_edges(profiles)).distinct()


def _components(profiles: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    linked = connected_components(edges)
    return profiles.select("id", "pos").join(linked, F.col("id") == F.col("node"), "left").select("id", "pos", F.coalesce("component", "id").alias(name))


def blocks(profiles: DataFrame, most: int = MOST) -> DataFrame:
    """(id, block). A block of more than ``most`` keeps groups joined by identifier, up to ``most`` members in
    order; the rest stand alone."""
    whole = _components(profiles, block_edges(profiles, most), "block")
    sizes = whole.groupBy("block").agg(F.count("*").alias("n"))
    keys = block_keys(profiles).where("kind = 'identifier'")
    star = keys.groupBy("type", "key").agg(F.min("id").alias("dst"))
    hard = _components(profiles, keys.join(star, ["type", "key"]).where("id <> dst").select(F.col("id").alias("src"), "dst").distinct(), "hard")
    both = whole.join(sizes, "block").join(hard.select("id", "hard"), "id")
    nth = F.row_number().over(Window.partitionBy("block", "hard").orderBy("pos", "id"))
    split = F.when(nth <= most, F.concat(F.lit("split:"), "hard")).otherwise(F.concat(F.lit("solo:"), "id"))
    return both.withColumn("split", split).select("id", F.when(F.col("n") <= most, F.concat(F.lit("block:"), "block")).otherwise(F.col("split")).alias("block"))


# ---- resolution ----


def valid_clusters(answers: DataFrame, members: DataFrame, profiles: DataFrame) -> DataFrame:
    """The proposed clusters (block, k, member_ids, canonical_name, confidence, evidence) that hold: every member is
    in the block, all are of one type, and the name is a surface of one of them, up to case. An unknown confidence is low."""
    long = answers.select("block", "k", F.explode("member_ids").alias("id"))
    inside = long.join(members, ["block", "id"]).join(profiles.select("id", "type", F.map_keys("surfaces").alias("names")), "id")
    facts = inside.groupBy("block", "k").agg(
        F.count("*").alias("found"), F.count_distinct("type").alias("types"), F.array_distinct(F.flatten(F.collect_list(F.transform("names", lambda s: F.lower(s))))).alias("names")
    )
    joined = answers.join(facts, ["block", "k"])
    named = (F.coalesce("canonical_name", F.lit("")) == "") | F.array_contains("names", F.lower("canonical_name")) | (F.size("member_ids") == 1)
    ok = joined.where((F.col("found") == F.size("member_ids")) & (F.col("types") == 1) & named)
    return ok.select("block", "k", "member_ids", "canonical_name", F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("low").alias("confidence"), F.coalesce("evidence", F.lit("")).alias("evidence"))


def settle(valid: DataFrame, members: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted clusters, with a singleton for every profile that no cluster covers, and those for review:
    merges of low confidence."""
    low = (F.col("confidence") == "low") & (F.size("member_ids") > 1)
    covered = valid.select("block", F.explode("member_ids").alias("id")).distinct()
    sizes = members.groupBy("block").agg(F.count("*").alias("n"))
    rest = members.join(covered, ["block", "id"], "left_anti").join(sizes, "block").join(profiles.select("id", canonical_surface().alias("canonical_name")), "id")
    why = F.when(F.col("n") == 1, "singleton block").otherwise("not mentioned in the answer")
    single = rest.select("block", F.lit(-1).alias("k"), F.array("id").alias("member_ids"), "canonical_name", F.lit("high").alias("confidence"), why.alias("evidence"))
    return valid.where(~low).unionByName(single), valid.where(low)


def roll_up(accepted: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, root) of the accepted clusters' components, and their merge rows."""
    merging = accepted.where(F.size("member_ids") > 1)
    edges = merging.select(F.col("member_ids")[0].alias("dst"), F.explode("member_ids").alias("src")).where("src <> dst").select("src", "dst")
    groups = _components(profiles, edges, "root")
    why = merging.select(F.col("member_ids")[0].alias("id"), "block", "k", F.concat(F.lit("["), "confidence", F.lit("] "), "evidence").alias("why"), "evidence").join(groups, "id")
    ranked = why.where("evidence <> ''").withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("block", "k"))).where("n <= 3")
    reasons = ranked.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "why"))), lambda x: x["why"]), "; ").alias("why"))
    forms = groups.join(profiles.select("id", F.explode(F.map_keys("surfaces")).alias("form")), "id").groupBy("root").agg(F.count_distinct("id").alias("members"), _listed("form").alias("forms"))
    merges = forms.where("members > 1").join(reasons, "root", "left").select(F.col("root").alias("canonical_id"), F.slice("forms", 1, FORMS_LIMIT).alias("merged_forms"), F.coalesce("why", F.lit("resolved by comparison")).alias("rationale"))
    return groups.select("id", "root"), merges


def derived_relations(answers: DataFrame, members: DataFrame) -> DataFrame:
    """Relations (block, subject_id, object_id, type, evidence) whose ends are both in the block."""
    found = answers.join(members.select("block", F.col("id").alias("subject_id")), ["block", "subject_id"]).join(members.select("block", F.col("id").alias("object_id")), ["block", "object_id"])
    return found.select("block", "subject_id", "object_id", F.coalesce("type", F.lit("related")).alias("type"), F.coalesce("evidence", F.lit("")).alias("evidence"))


def entities_of(profiles: DataFrame, groups: DataFrame) -> DataFrame:
    """(root, label, aliases, item_ids) of the profiles' groups; the label is the most used surface of all."""
    counts = profiles.join(groups, "id").select("root", F.explode("surfaces").alias("surface", "n")).groupBy("root", "surface").agg(F.sum("n").alias("n"))
    named = counts.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("c"), (-F.length("surface")).alias("l"), "surface")).getField("surface").alias("label"), _listed("surface").alias("aliases"))
    held = profiles.join(groups, "id").select("root", F.explode("item_ids").alias("item_id")).groupBy("root").agg(_listed("item_id").alias("item_ids"))
    return named.join(held, "root")


def entity_of(profiles: DataFrame, groups: DataFrame, kind: str) -> DataFrame:
    """(profile_id, entity_id) of the profiles of a kind other than persons, through the root of their group."""
    of = profiles.where(F.col("type") == kind).select(F.col("id").alias("profile_id"))
    return of.join(groups, F.col("profile_id") == F.col("id")).select("profile_id", F.concat(F.lit(f"{kind}:profile:"), "root").alias("entity_id"))


def person_of(profiles: DataFrame, entities: DataFrame) -> DataFrame:
    """(profile_id, entity_id) of persons by any identifier, else by any surface, the first in order."""
    persons = entities.where("type = 'person'").select(F.col("id").alias("entity_id"), "pos", "emails", F.concat("aliases", F.array("label")).alias("names"))
    by_email = persons.select("entity_id", "pos", F.explode("emails").alias("key")).select("entity_id", "pos", F.lower("key").alias("key"), F.lit(0).alias("rank"))
    by_name = persons.select("entity_id", "pos", F.explode("names").alias("key")).select("entity_id", "pos", F.lower("key").alias("key"), F.lit(1).alias("rank"))
    own = profiles.where("type = 'person'")
    keys = own.select("id", F.explode("identifiers").alias("key"), F.lit(0).alias("rank")).unionByName(own.select("id", F.explode(F.map_keys("surfaces")).alias("key"), F.lit(1).alias("rank")))
    found = keys.withColumn("key", F.lower("key")).join(by_email.unionByName(by_name), ["key", "rank"])
    return found.groupBy(F.col("id").alias("profile_id")).agg(F.min(F.struct("rank", "pos", "entity_id")).getField("entity_id").alias("entity_id"))


def merged_people(entities: DataFrame, mentions: DataFrame, person: DataFrame, groups: DataFrame) -> DataFrame:
    """(old_id, new_id) of persons whose profiles are in one group: the owner stays, else the most mentioned, then
    the first. Ids are those of the input."""
    inside = person.join(groups, F.col("profile_id") == F.col("id")).select("entity_id", "root").distinct()
    star = inside.groupBy("root").agg(F.min("entity_id").alias("dst"), F.count("*").alias("n")).where("n > 1")
    linked = connected_components(inside.join(star, "root").where("entity_id <> dst").select(F.col("entity_id").alias("src"), "dst"))
    count = mentions.groupBy("entity_id").agg(F.count("*").alias("n_mentions"))
    facts = linked.join(entities.select(F.col("id").alias("node"), "pos", F.coalesce("owner", F.lit(False)).alias("owner")), "node").join(count, F.col("node") == F.col("entity_id"), "left").fillna(0, ["n_mentions"])
    canon = facts.groupBy("component").agg(F.min(F.struct((~F.col("owner")).alias("o"), (-F.col("n_mentions")).alias("m"), "pos", "node")).getField("node").alias("new_id"))
    return facts.join(canon, "component").where("node <> new_id").select(F.col("node").alias("old_id"), "new_id")
