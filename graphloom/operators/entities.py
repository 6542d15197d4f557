"""Entities of the graph, each kind from its evidence.

Entities and their mentions are two tables: a person who is in a third of all items is one entity row and very many
mention rows, never one long list. ``place`` and ``pos`` give entities a total order: kind, then first appearance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import currency as C
from graphloom.functions import text as T
from graphloom.operators.identity import participant_rows
from graphloom.schema import FORMS_LIMIT, PERSONAL_DOMAINS, SUBEVENT_WORDS

#: The columns of entities, in order, with their types.
COLUMNS = {
    "id": "string", "place": "int", "pos": "long", "type": "string", "label": "string", "aliases": "array<string>", "emails": "array<string>",
    "owner": "boolean", "domain": "string", "amount": C.DECIMAL, "currency": "string", "currency_resolved": "boolean", "currency_ambiguous": "boolean",
    "currency_evidence": "array<string>", "needs_review": "boolean", "snippets": "array<string>",
}
PLACE = {"person": 0, "org": 1, "location": 2, "money": 3, "subevent": 4, "document": 5}


@dataclass
class Found:
    """Entities and mentions (entity_id, item_id, text, pos) of one kind or of all."""

    entities: DataFrame
    mentions: DataFrame

    def union(self, other: Found) -> Found:
        return Found(self.entities.unionByName(other.entities), self.mentions.unionByName(other.mentions))


def shaped(rows: DataFrame, kind: str) -> DataFrame:
    """Rows as entities of a kind, absent columns null (arrays empty)."""
    rows = rows.withColumns({"type": F.lit(kind), "place": F.lit(PLACE[kind])})
    have = set(rows.columns)

    def column(name: str, ddl: str) -> Column:
        if name in have:
            return F.col(name).cast(ddl).alias(name)
        return (F.array() if ddl.startswith("array") and name != "snippets" else F.lit(None)).cast(ddl).alias(name)

    return rows.select(*[column(n, t) for n, t in COLUMNS.items()])


def first_few(rows: DataFrame, keys: list[str], value: str, n: int, order: str | None = None) -> DataFrame:
    """(keys, value array) with the n first distinct values of each key; the limit is applied before the shuffle, so
    no key's values are ever collected whole."""
    by = order or value
    distinct = rows.groupBy(*keys, value).agg(F.min(by).alias("__by"))
    ranked = distinct.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__by", value))).where(F.col("__n") <= n)
    listed = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__by", value))).alias("__l"))
    return listed.select(*keys, F.transform("__l", lambda x: x[value]).alias(value))


def people_mentions(items: DataFrame, owner_refs: DataFrame) -> DataFrame:
    """A row per participant who is a person or the owner: name, email, surface, is_owner."""
    refs = owner_refs.select("item_id", "p_index", F.lit(True).alias("is_owner"))
    rows = participant_rows(items).join(refs, ["item_id", "p_index"], "left").withColumn("is_owner", F.coalesce("is_owner", F.lit(False)))
    email = F.when(F.col("id_type") == "email", F.coalesce("id_value", F.lit(""))).otherwise("")
    name = F.coalesce(F.nullif("display_name", F.lit("")), F.when(F.col("id_type") == "phone", F.col("id_value")), F.lit(""))
    return (
        rows.where("kind = 'person' or is_owner")
        .withColumns({"email": email, "name": name})
        .withColumn("surface", F.coalesce(F.nullif("raw", F.lit("")), F.nullif("name", F.lit("")), "email"))
        .select("item_id", "item_pos", "p_index", "email", "name", "surface", "is_owner")
    )


def people(mentions: DataFrame, owner: DataFrame) -> tuple[Found, DataFrame]:
    """Persons by address, the owner's surfaces as one, anyone without an address apart; and their merge rows.

    No graph is needed: the key is ``owner`` for mentions that are the owner or use one of the owner's addresses, else
    the address, else the mention itself.
    """
    own_emails = mentions.where("is_owner and email <> ''").select("email").distinct().withColumn("__own", F.lit(True))
    keyed = mentions.join(own_emails, "email", "left").withColumn(
        "id",
        F.when(F.col("is_owner") | F.coalesce("__own", F.lit(False)), "person:owner")
        .when(F.col("email") != "", F.concat(F.lit("person:"), "email"))
        .otherwise(F.concat_ws(":", F.lit("person:mention"), "item_id", "p_index")),
    )
    grouped = keyed.groupBy("id").agg(
        F.min("item_pos").alias("pos"),
        F.array_sort(F.collect_set(F.when(F.col("name") != "", F.col("name")))).alias("names"),
        F.array_sort(F.collect_set(F.when(F.col("email") != "", F.col("email")))).alias("emails"),
        F.array_sort(F.collect_set("surface")).alias("aliases"),
    )
    label_of = F.broadcast(owner.select(F.col("label").alias("owner_label"), F.lit("person:owner").alias("id")))
    rows = grouped.join(label_of, "id", "left").withColumn("label", F.coalesce(F.nullif("owner_label", F.lit("")), T.best_label(F.col("names"), F.col("emails"))))
    rows = rows.withColumn("owner", F.when(F.col("id") == "person:owner", F.lit(True)))
    stems = F.size(F.array_distinct(F.transform("emails", T.email_stem)))
    why = F.concat_ws(
        "; ",
        F.when(F.size("emails") > 1, F.concat(F.size("emails").cast("string"), F.when(stems < F.size("emails"), " emails share a name stem").otherwise(" emails co-occur with the same name"))),
        F.when(F.col("owner"), "owner surfaces across channels collapsed by structural inference"),
    )
    merges = rows.where(F.size("aliases") > 1).select(
        F.col("id").alias("canonical_id"), F.slice("aliases", 1, FORMS_LIMIT).alias("merged_forms"), F.coalesce(F.nullif(why, F.lit("")), F.lit("grouped by shared identifiers")).alias("rationale")
    )
    spoken = keyed.select(F.col("id").alias("entity_id"), "item_id", F.col("surface").alias("text"), F.col("item_pos").alias("pos"))
    return Found(shaped(rows, "person"), spoken), merges


def stem_links(mentions: DataFrame, least: int = 6) -> DataFrame:
    """Edges (src, dst) between addresses with the same stem of ``least`` letters or more; an option, off by default."""
    stems = mentions.where("email <> ''").select("email", T.email_stem("email").alias("stem")).where(F.length("stem") >= least).distinct()
    first = stems.groupBy("stem").agg(F.min("email").alias("dst"))
    return stems.join(first, "stem").where("email <> dst").select(F.col("email").alias("src"), "dst")


def domain_orgs(persons: Found) -> tuple[Found, DataFrame]:
    """An organisation per mail domain that isn't personal, and its members (entity_id, person_id). Its
    mentions are the first eight items of each member."""
    held = persons.entities.select(F.col("id").alias("person_id"), F.explode("emails").alias("email")).withColumn("domain", F.regexp_replace(T.email_domain("email"), ">", ""))
    held = held.where((F.col("domain") != "") & ~F.col("domain").isin(*PERSONAL_DOMAINS)).select("person_id", "domain").distinct()
    core = F.substring_index("domain", ".", 1)
    label = F.when(F.length(core) <= 4, F.upper(core)).otherwise(F.initcap(core))
    domains = held.groupBy("domain").agg(F.count("*").alias("n")).withColumns({"id": F.concat(F.lit("org:"), "domain"), "label": label, "pos": F.xxhash64("domain") * 0})
    first = first_few(persons.mentions, ["entity_id"], "item_id", 8, "pos").select(F.col("entity_id").alias("person_id"), F.posexplode("item_id").alias("pos", "item_id"))
    spoken = held.join(first, "person_id").select(F.concat(F.lit("org:"), "domain").alias("entity_id"), "item_id", F.col("domain").alias("text")).distinct()
    members = held.select(F.concat(F.lit("org:"), "domain").alias("entity_id"), "person_id")
    return Found(shaped(domains, "org"), spoken.withColumn("pos", F.lit(0).cast("long"))), members


def _whole_text() -> Column:
    return F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))


def amount_items(items: DataFrame) -> DataFrame:
    """A10: (amount, item_id, pos, body)."""
    return items.select(F.col("id").alias("item_id"), "pos", "body", F.explode(C.amounts(_whole_text())).alias("amount"))


def money(held: DataFrame, surfaces: DataFrame | None = None) -> Found:
    """An entity per amount, its currency by vote of the signs around its places (and in the given surfaces
    (amount, surface)). More than one currency is ambiguous; the most voted one is named all the same."""
    around = held.select("amount", "pos", F.posexplode(C.windows("body", C.amount_forms(F.col("amount")))).alias("k", "window"))
    if surfaces is not None:
        around = surfaces.select("amount", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("k"), F.col("surface").alias("window")).unionByName(around)
    signs = around.withColumn("hit", C.currency_hit(F.col("window"))).select("*", "hit.code", "hit.sign")
    votes = signs.where("code is not null").groupBy("amount", "code").agg(F.count("*").alias("n"), F.min(F.struct("pos", "k")).alias("first"))
    tally = votes.groupBy("amount").agg(F.max_by("code", F.struct("n", -F.col("first.pos"), -F.col("first.k"))).alias("currency"), F.count("*").alias("codes"))
    evidence = signs.where("code is not null").groupBy("amount").agg(F.array_sort(F.collect_set("sign")).alias("currency_evidence"))
    shown = signs.withColumn("snippet", F.left(F.regexp_replace(F.trim("window"), "\n", " "), F.lit(80)))
    ranked = shown.withColumn("n", F.row_number().over(Window.partitionBy("amount").orderBy("pos", "k"))).where("n <= 4")
    snippets = ranked.groupBy("amount").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "snippet"))), lambda x: x["snippet"]).alias("snippets"))
    rows = held.select("amount").distinct()
    for part in (tally, evidence, snippets):
        rows = rows.join(part, "amount", "left")
    rows = rows.withColumn("currency_ambiguous", F.coalesce(F.col("codes") > 1, F.lit(False))).withColumns(
        {"currency_resolved": F.col("currency").isNotNull() & ~F.col("currency_ambiguous"), "needs_review": F.col("currency").isNull() | F.col("currency_ambiguous")}
    )
    rows = rows.withColumns(
        {
            "id": F.concat(F.lit("money:"), C.float_text(F.col("amount"))),
            "label": C.money_label(F.col("amount"), F.col("currency"), F.col("currency_resolved"), F.col("currency_ambiguous")),
            "pos": (-F.col("amount") * 100).cast("long"),
            "snippets": F.coalesce("snippets", F.array().cast("array<string>")),
            "currency_evidence": F.coalesce("currency_evidence", F.array().cast("array<string>")),
        }
    )
    spoken = held.select("amount", "item_id", "pos").distinct().join(rows.select("amount", F.col("id").alias("entity_id"), F.col("label").alias("text")), "amount")
    return Found(shaped(rows, "money"), spoken.select("entity_id", "item_id", "text", "pos"))


def subevents(items: DataFrame) -> Found:
    """An entity per kind of subevent that any item names."""
    text = T.normalize(_whole_text())
    tests = [
        F.when(text.rlike("(?U)\\b(" + "|".join(words) + ")\\b"), F.struct(F.lit(k).cast("long").alias("k"), F.lit(name).alias("name"))) for k, (name, words) in enumerate(SUBEVENT_WORDS.items())
    ]
    hits = items.select(F.col("id").alias("item_id"), F.col("pos"), F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("x"))
    spoken = hits.select(F.concat(F.lit("subevent:"), F.col("x.k")).alias("entity_id"), "item_id", F.col("x.name").alias("text"), "pos")
    rows = hits.groupBy(F.col("x.k").alias("pos"), F.col("x.name").alias("label")).agg(F.count("*").alias("n")).withColumn("id", F.concat(F.lit("subevent:"), "pos"))
    return Found(shaped(rows, "subevent"), spoken)


def documents(items: DataFrame) -> Found:
    """An entity per document item."""
    label = F.regexp_replace(F.coalesce(F.nullif("subject", F.lit("")), F.nullif("channel", F.lit("")), F.lit("document")), "\\.pdf", "")
    rows = items.where("source_type = 'pdf'").select(F.concat(F.lit("document:"), "id").alias("id"), "pos", label.alias("label"), F.col("id").alias("item_id"))
    return Found(shaped(rows, "document"), rows.select(F.col("id").alias("entity_id"), "item_id", F.col("label").alias("text"), "pos"))
