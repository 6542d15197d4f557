"""Queries over participants, people and what they are part of, on items made of the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import dedup, entities, extraction, identity, relations

from graphloom.plans.catalogue import query
from graphloom.plans.tables import participant, table

# Every event is sent by its user, from one of two addresses, to a team; those of users divisible by 11 by someone without an address.
USERS = """
sent AS (SELECT event_id, user_id, user_id % 11 = 0 AS nameless, 'u' || user_id || CASE WHEN event_id % 2 = 0 THEN '@acme.example' ELSE '@gmail.com' END AS email,
         CASE WHEN event_id % 3 = 0 THEN 'User Number ' || user_id ELSE 'User ' || user_id END AS name, event_type, event_type || '-' || (user_id % 7) AS conv FROM events)"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    user = F.col("user_id").cast("string")
    nameless = F.col("user_id") % 11 == 0
    email = F.when(~nameless, F.concat(F.lit("u"), user, F.when(F.col("event_id") % 2 == 0, "@acme.example").otherwise("@gmail.com")))
    name = F.concat(F.when(F.col("event_id") % 3 == 0, "User Number ").otherwise("User "), user)
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("pos"), F.col("event_type").alias("source_type"), F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("conversation_id"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("subject"), F.col("props").alias("body"), F.lit("").alias("channel"),
        F.array(
            participant("sender", name, F.when(nameless, "none").otherwise("email"), email, raw=name),
            participant("recipient", F.lit(None).cast("string"), "email", F.concat(F.lit("team"), (F.col("event_id") % 5).cast("string"), F.lit("@acme.example")), kind="system"),
        ).alias("participants"),
    )


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    none = items.select(F.col("id").alias("item_id"), F.lit(0).alias("p_index")).where("item_id = 'none'")
    return entities.people_mentions(items, none)


def _people(spark: SparkSession, sf: str) -> tuple[entities.Found, DataFrame]:
    return entities.people(_mentions(spark, sf), spark.createDataFrame([], "label string"))


@query("SELECT event_id::VARCHAR AS id, 'User ' || CASE WHEN event_id % 3 = 0 THEN 'Number ' ELSE '' END || user_id AS sender, 'team' || (event_id % 5) || '@acme.example' AS recipients, 2 AS parties, CASE WHEN user_id % 11 = 0 THEN 1 ELSE 2 END AS emails FROM events")
def participant_labels(spark: SparkSession, sf: str) -> DataFrame:
    """P01-P04."""
    both = F.size(T.senders()) + F.size(T.addressees())
    return _items(spark, sf).select("id", T.sender_display().alias("sender"), T.recipients_display().alias("recipients"), both.alias("parties"), F.size(T.emails()).alias("emails"))


@query(f"WITH {USERS} SELECT event_id::VARCHAR AS item_id, CASE WHEN nameless THEN '' ELSE email END AS email, name, name AS surface FROM sent")
def people_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """P23."""
    return _mentions(spark, sf).select("item_id", "email", "name", "surface")


PERSONS = f"""{USERS},
p AS (SELECT CASE WHEN nameless THEN 'person:mention:' || event_id || ':0' ELSE 'person:' || email END AS id, min(event_id) AS pos, list_sort(list(DISTINCT name)) AS names,
      CASE WHEN bool_and(nameless) THEN [] ELSE [any_value(email)] END AS emails, count(*) AS n FROM sent GROUP BY 1),
l AS (SELECT *, list_sort(list_transform(names, lambda x: {{'w': -len(string_split(x, ' ')), 'l': -length(x), 'x': x}}))[1].x AS label FROM p)"""


@query(f"WITH {PERSONS} SELECT id, label, array_to_string(names, '|') AS aliases, array_to_string(emails, '|') AS emails, n AS mentions FROM l")
def person_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """One person an address; without one, each mention is a person of its own."""
    found = _people(spark, sf)[0]
    told = found.mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mentions"))
    return found.entities.join(told, "id").select("id", "label", F.array_join("aliases", "|").alias("aliases"), F.array_join("emails", "|").alias("emails"), "mentions")


@query(f"WITH {PERSONS} SELECT id AS canonical_id, array_to_string(names, '|') AS merged_forms, 'grouped by shared identifiers' AS rationale FROM l WHERE len(names) > 1")
def merge_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Why surfaces were taken for one person."""
    return _people(spark, sf)[1].select("canonical_id", F.array_join("merged_forms", "|").alias("merged_forms"), "rationale")


@query(
    f"""WITH {USERS}, m AS (SELECT DISTINCT user_id FROM sent WHERE NOT nameless AND user_id % 2 = 0), e AS (SELECT list_sort(list(DISTINCT email)) AS emails FROM sent JOIN m USING (user_id))
SELECT 'person:owner' AS id, 'The Owner' AS label, len(emails)::INT AS emails, 1.0 * (SELECT count(*) FROM sent WHERE NOT nameless AND email IN (SELECT unnest(emails) FROM e)) AS mentions FROM e"""
)
def owner_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """What the owner says and what comes from the owner's addresses is one person."""
    items = _items(spark, sf)
    refs = items.where("cast(regexp_extract(participants[0].id_value, '\\\\d+', 0) as long) % 2 = 0").select(F.col("id").alias("item_id"), F.lit(0).alias("p_index"))
    found, _ = entities.people(entities.people_mentions(items, refs), spark.createDataFrame([("The Owner",)], "label string"))
    own = found.mentions.where("entity_id = 'person:owner'").agg(F.count("*").cast("double").alias("mentions"))
    return found.entities.where("owner").select("id", "label", F.size("emails").alias("emails"), F.lit(1).alias("one")).join(own.withColumn("one", F.lit(1)), "one").drop("one")


@query("WITH e AS (SELECT DISTINCT 'segment.' || c_nationkey || lower(c_mktsegment) || (c_custkey % 3) || '@x.org' AS email, 'segment' || lower(c_mktsegment) AS stem FROM customer), f AS (SELECT stem, min(email) AS dst FROM e GROUP BY 1) SELECT email AS src, dst FROM e JOIN f USING (stem) WHERE email <> dst")
def stem_links(spark: SparkSession, sf: str) -> DataFrame:
    """E02b, F19."""
    c = table(spark, sf, "customer")
    email = F.concat(F.lit("segment."), F.col("c_nationkey").cast("string"), F.lower("c_mktsegment"), (F.col("c_custkey") % 3).cast("string"), F.lit("@x.org"))
    return entities.stem_links(c.select(email.alias("email")))


@query(
    f"""WITH {PERSONS}, o AS (SELECT DISTINCT 'org:' || split_part(emails[1], '@', 2) AS id, split_part(emails[1], '@', 2) AS domain FROM l WHERE len(emails) > 0 AND split_part(emails[1], '@', 2) <> 'gmail.com')
SELECT o.id, domain, 'ACME' AS label, count(*) AS members FROM o JOIN l ON split_part(emails[1], '@', 2) = domain GROUP BY 1, 2"""
)
def domain_orgs(spark: SparkSession, sf: str) -> DataFrame:
    """Personal mail domains are no organisations."""
    orgs, members = entities.domain_orgs(_people(spark, sf)[0])
    n = members.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("members"))
    return orgs.entities.join(n, "id").select("id", "domain", "label", "members")


@query(
    f"""WITH {PERSONS}, s AS (SELECT name AS surface, arg_min(id, pos) AS id FROM (SELECT id, pos, unnest(names) AS name FROM l) GROUP BY 1)
SELECT DISTINCT event_id::VARCHAR AS item_id, 'sender' AS role, CASE WHEN nameless THEN s.id ELSE 'person:' || email END AS person_id FROM sent JOIN s ON s.surface = sent.name"""
)
def participant_people(spark: SparkSession, sf: str) -> DataFrame:
    """A participant is who has the address, else who first had the surface."""
    return relations.resolved_participants(_items(spark, sf), _people(spark, sf)[0].entities).where("role = 'sender'")


@query(
    """WITH c AS (SELECT event_id, 'User ' || user_id AS name, event_type || '-' || (event_id % 13) AS conv FROM events),
best AS (SELECT name FROM c GROUP BY 1 HAVING count(DISTINCT conv) >= 2 ORDER BY count(DISTINCT conv) DESC, min(event_id) LIMIT 1) SELECT event_id::VARCHAR AS item_id, 0 AS p_index FROM c JOIN best USING (name)"""
)
def chat_owner(spark: SparkSession, sf: str) -> DataFrame:
    """The sender in most chats."""
    e = table(spark, sf, "events")
    items = e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("pos"), F.lit("whatsapp").alias("source_type"), F.concat_ws("-", "event_type", (F.col("event_id") % 13).cast("string")).alias("conversation_id"),
        F.array(participant("sender", F.concat(F.lit(" User "), F.col("user_id").cast("string")))).alias("participants"),
    )
    return identity.chat_owner(items)


@query(
    f"""WITH {USERS}, sc AS (SELECT 'email:' || email AS key, count(DISTINCT conv) + 2 * count(DISTINCT event_type) AS score, min(event_id) AS first FROM sent WHERE NOT nameless GROUP BY 1),
top AS (SELECT key FROM sc ORDER BY score DESC, first LIMIT 1) SELECT event_id::VARCHAR AS item_id, 0 AS p_index, true AS agrees FROM sent WHERE NOT nameless AND 'email:' || email = (SELECT key FROM top)"""
)
def owner_inference(spark: SparkSession, sf: str) -> DataFrame:
    """Every place where the owner is, and whether a given address agrees."""
    items = _items(spark, sf)
    members = identity.identity_members(items)
    owner = identity.owner_pick(identity.owner_scores(identity.identity_clusters(members)))
    seed = identity.seed_agrees(owner, [owner.first().identifier.upper(), ""]).select("seed_agrees")
    return identity.owner_refs(items, members, owner).crossJoin(F.broadcast(seed)).withColumnRenamed("seed_agrees", "agrees")


KEYWORDS = """
w AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'your Registration, with the notification' WHEN 'purchase' THEN 'the payment of a flight' WHEN 'view' THEN 'an acceptancy of posters' WHEN 'click' THEN 'HOTEL check-in' ELSE 'badge' END AS body FROM events),
k(name, p) AS (VALUES ('Acceptance', '\\b(accept|acceptance|submission|notification)\\b'), ('Registration & Payment', '\\b(registration|register|invoice|receipt|payment)\\b'),
('Travel', '\\b(flight|boarding|itinerary|airline|visa|passport)\\b'), ('Accommodation', '\\b(airbnb|accommodation|hotel|check-in|hostel)\\b'), ('Presentation', '\\b(presentation|poster|badge|session|workshop)\\b'))"""


@query(f"WITH {KEYWORDS} SELECT name AS label, event_id::VARCHAR AS item_id FROM w JOIN k ON regexp_matches(lower(body), p)")
def subevent_items(spark: SparkSession, sf: str) -> DataFrame:
    """Whole words only; an item can be of several kinds."""
    kind = F.col("event_type")
    body = F.when(kind == "signup", "your Registration, with the notification").when(kind == "purchase", "the payment of a flight").when(kind == "view", "an acceptancy of posters").when(kind == "click", "HOTEL check-in").otherwise("badge")
    items = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("pos"), F.lit("").alias("subject"), body.alias("body"))
    return entities.subevents(items).mentions.select(F.col("text").alias("label"), "item_id")


@query("SELECT 'document:' || page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'document' ELSE 'Page ' || page_id END AS label, page_id::VARCHAR AS item_id FROM pages WHERE page_id % 2 = 0")
def document_entities(spark: SparkSession, sf: str) -> DataFrame:
    """An entity for each document page; the kind of page stands for the format, so odd pages are none."""
    page = F.col("page_id").cast("string")
    items = table(spark, sf, "pages").select(page.alias("id"), F.col("page_id").alias("pos"), F.when(F.col("page_id") % 2 == 0, "pdf").otherwise("email").alias("source_type"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("Page "), page, F.lit(".pdf"))).alias("subject"), F.lit("").alias("channel"))
    found = entities.documents(items)
    return found.entities.select("id", "label").join(found.mentions.select(F.col("entity_id").alias("id"), "item_id"), "id")


@query("WITH a AS (SELECT DISTINCT round(o_totalprice, 2)::DECIMAL(18,2) AS amount FROM orders WHERE round(o_totalprice, 2) > 0) SELECT amount, CASE (amount * 100)::BIGINT % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'INR' END AS currency, (amount * 100)::BIGINT % 3 = 2 AS needs_review FROM a")
def claimed_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts that a client found; the currency is read from the words it quotes."""
    amount = F.round("o_totalprice", 2).cast("decimal(18,2)")
    held = table(spark, sf, "orders").select(amount.alias("amount"), F.col("o_orderkey").cast("string").alias("item_id"), F.col("o_orderkey").alias("pos"), F.lit("no sign here").alias("body")).where("amount > 0")
    word = F.element_at(F.array(F.lit(" euros"), F.lit(" Rs"), F.lit("")), ((F.col("amount") * 100).cast("long") % 3 + 1).cast("int"))
    surfaces = held.select("amount").distinct().select("amount", F.concat(F.format_number("amount", 2), word).alias("surface"))
    return entities.money(held, surfaces).entities.select("amount", "currency", "needs_review")


@query("SELECT event_id::VARCHAR AS item_id, true AS relevant, 1.0::DOUBLE AS score FROM events")
def all_relevant(spark: SparkSession, sf: str) -> DataFrame:
    """P08."""
    return extraction.relevance(_items(spark, sf)).select("item_id", "relevant", "score")


@query("SELECT doc_id, CASE WHEN doc_id = first THEN NULL ELSE first END AS root FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY doc_id // 3) AS first FROM documents)")
def duplicate_roots(spark: SparkSession, sf: str) -> DataFrame:
    """The roots of chains of copies, two hops at most."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    third = F.col("id") - F.col("id") % 3
    canon = docs.join(docs.select((F.col("id") - F.col("id") % 3).alias("__t")).distinct(), third == F.col("__t")).where("id % 3 > 0").select("id", F.when(F.col("id") % 3 == 1, third).otherwise(third + 1).alias("canonical_id"))
    root = dedup.root_of(canon)
    return docs.join(root, "id", "left").select(F.col("id").alias("doc_id"), F.col("root_id").alias("root"))


@query("SELECT c_custkey, 'User ' || c_custkey AS name, 'seen by: ' || c_mktsegment AS snippet FROM customer")
def citation_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What a citation shows of an item."""
    c = table(spark, sf, "customer")
    subject = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" seen by: "), "c_mktsegment"))
    body = F.concat(F.lit("seen by: "), "c_mktsegment", F.lit(" " * 100), F.lit("and much more"))
    name = T.shown(participant("sender", F.lit(""), raw=F.concat(F.lit("User "), F.col("c_custkey").cast("string"))))
    return c.select("c_custkey", name.alias("name"), T.snippet(subject, body).alias("snippet"))


