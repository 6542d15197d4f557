"""Queries over chunks, claims, profiles and their resolution, on rows made of the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import chunks, entities, extraction, identity, merge, profiles, prompts, relations
from graphloom.operators.entities import Found
from graphloom.plans import build
from graphloom.plans.catalogue import query
from graphloom.plans.tables import participant, table
from graphloom.schema import CHUNKS

_NONE = "array<string>"


def _of(prefix: str, c: Column | str) -> Column:
    return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


# ---- chunks and claims ----


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk for each conversation, its turns as messages."""
    c = table(spark, sf, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = c.withColumn("n", n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "text", "turn"))).alias("l"))
    line = lambda x: F.concat(F.lit("<m"), x["n"].cast("string"), F.lit("> "), x["text"])
    ids = lambda x: F.struct(_of("m", x["n"]), F.concat_ws("#", F.col("conv_id").cast("string"), x["turn"].cast("string")))
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    return rows.select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":0")).alias("chunk_id"), F.col("conv_id").cast("string").alias("conversation_id"), F.lit(0).alias("chunk_index"), F.lit("## Participants").alias("participant_table"),
        F.transform("l", line).alias("message_lines"), F.map_from_entries(F.transform("l", ids)).alias("id_map"),
    ).select(*names)


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer for each conversation about its first message: of three mentions and three relations one each holds; one message is unknown."""
    first = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    cut = F.substring("text", 3, 12)
    mention = lambda m, s, t: F.struct(F.lit(m).alias("message_id"), s.alias("surface"), F.lit(t).alias("type"), F.lit("x").alias("local_entity"))
    tie = lambda m, s, t: F.struct(F.lit(t).alias("type"), F.lit("x").alias("subject_local_entity"), F.lit("y").alias("object_local_entity"), F.lit(m).alias("message_id"), s.alias("evidence_span"))
    said = F.struct(
        F.array(F.struct(F.lit("m1").alias("id"), F.array(F.lit("t")).alias("topics")), F.struct(F.lit("m999").alias("id"), F.array(F.lit("t")).alias("topics"))).alias("messages"),
        F.array(mention("m1", cut, "person"), mention("m1", cut, "animal"), mention("m1", F.lit("zz§zz"), "org"), mention("m999", cut, "org")).alias("mentions"),
        F.array(tie("m1", cut, "paid"), tie("m1", cut, "likes"), tie("m1", F.lit("zz§zz"), "paid"), tie("m999", cut, "paid")).alias("relations"),
    )
    return first.select(F.concat(F.col("conv_id").cast("string"), F.lit(":0")).alias("chunk_id"), F.concat(F.lit("Here it is: "), F.to_json(said), F.lit(" as you asked.")).alias("answer"))


CLAIMED = "f AS (SELECT conv_id, arg_min(text, turn) AS text, min(turn) AS turn FROM conversations GROUP BY 1)"


@query(f"WITH {CLAIMED} SELECT 'message' AS part, conv_id || '#' || turn AS item_id, 't' AS what FROM f UNION ALL SELECT 'mention', conv_id || '#' || turn, substr(text, 3, 12) FROM f UNION ALL SELECT 'relation', conv_id || '#' || turn, substr(text, 3, 12) FROM f")
def verified_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims whose message exists, whose type is known and whose words stand in the message as given."""
    messages, mentions, ties, _ = extraction.verify(_chunks(spark, sf), extraction.parsed(_answers(spark, sf)))
    part = lambda name, rows, what: rows.select(F.lit(name).alias("part"), "item_id", what.alias("what"))
    return part("message", messages, F.col("topics")[0]).unionAll(part("mention", mentions, F.col("surface"))).unionAll(part("relation", ties, F.col("evidence_span")))


@query("WITH n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations) SELECT reason, n * k AS n FROM n, (VALUES ('bad_message_id', 3), ('bad_mention_type', 1), ('surface_not_found', 1), ('bad_relation_type', 1), ('evidence_not_found', 1)) v(reason, k)")
def claim_rejections(spark: SparkSession, sf: str) -> DataFrame:
    """Why claims were refused."""
    return extraction.verify(_chunks(spark, sf), extraction.parsed(_answers(spark, sf)))[3]


@query("SELECT event_id::VARCHAR AS item_id, CASE WHEN event_id % 2 = 0 THEN 'General|TOPIC ' ELSE 'TOPIC ' END || upper(event_type) || CASE WHEN event_id % 2 = 0 THEN '' ELSE '|General' END AS topics FROM events")
def item_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that are alike count as one, the first in order; an item has each once."""
    word = F.element_at(F.array(F.concat(F.lit("topic "), "event_type", F.lit("!")), F.concat(F.lit("Topic "), "event_type"), F.upper(F.concat(F.lit("topic "), "event_type"))), (F.col("event_id") % 3 + 1).cast("int"))
    said = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("General"), word, F.lit("General"))).otherwise(F.array(word, F.lit("General")))
    messages = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("item_id"), F.lit("c").alias("chunk_id"), F.lit(0).alias("k"), said.alias("topics"))
    return extraction.item_topics(messages).select("item_id", _joined("topics"))


@query("SELECT event_id::VARCHAR AS item_id, event_id % 3 = 1 AS relevant, CASE WHEN event_id % 3 < 2 THEN 'why ' || event_type END AS rationale, CASE WHEN event_id % 5 = 0 THEN 1 END AS entities FROM events")
def item_extractions(spark: SparkSession, sf: str) -> DataFrame:
    """Per item whether it has a topic, why, and what it mentions."""
    e = table(spark, sf, "events").withColumn("item_id", F.col("event_id").cast("string"))
    topics = F.when(F.col("event_id") % 3 == 1, F.array(F.lit("t"))).otherwise(F.array().cast(_NONE))
    messages = e.where("event_id % 3 < 2").select("item_id", topics.alias("topics"), F.concat(F.lit("why "), "event_type").alias("why"))
    mentions = e.where("event_id % 5 = 0").select("item_id", F.lit("org").alias("type"), F.lit("x").alias("local_entity"), F.lit("X").alias("surface"))
    return extraction.item_extractions(messages, mentions, e.select(F.col("item_id").alias("id"))).select("item_id", "relevant", "rationale", F.when(F.col("entities").isNotNull(), F.size("entities")).alias("entities"))


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    keyed = chunks.full_text(_chunks(spark, sf)).withColumn("key", chunks.cache_key("model", "v1"))
    return keyed.where("cast(conversation_id as long) % 2 = 0").select("key", F.lit("kept").alias("answer"))


FULL = "t AS (SELECT conv_id, '## Participants' || chr(10) || string_agg('<m' || n || '> ' || text, chr(10) ORDER BY n) AS full_text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1)"


@query(f"WITH {FULL} SELECT conv_id || ':0' AS chunk_id, left(sha256('modelv1' || full_text), 20) AS key, conv_id % 2 = 0 AS from_cache, CASE WHEN conv_id % 2 = 0 THEN 'kept' WHEN conv_id % 3 = 0 THEN '{{}}' ELSE 'new' END AS answer, conv_id % 6 = 3 AS failed FROM t")
def answers_asked(spark: SparkSession, sf: str) -> DataFrame:
    """Kept answers are joined, the others asked for; a client that fails twice gives an empty answer."""
    marked = _chunks(spark, sf).withColumn("chunk_index", F.col("conversation_id").cast("int"))

    class Client:
        def complete(self, system: str, user: str) -> str:
            if user in bad:
                raise ConnectionError("no answer")
            return "new"

    bad = {r.full_text for r in chunks.full_text(marked).where("chunk_index % 6 = 3").select("full_text").collect()}
    return extraction.asked(_chunks(spark, sf), _cache(spark, sf), Client, "system", "model", "v1").select("chunk_id", "key", "from_cache", "answer", "failed")


@query(f"WITH {FULL}, s AS (SELECT conv_id, greatest(1, floor(length(full_text) / 3.5))::BIGINT AS tokens FROM t) SELECT count(*) AS chunks, count(*) FILTER (conv_id % 2 = 0) AS cache_hits, sum(tokens)::BIGINT AS input_tokens, sum(tokens) FILTER (conv_id % 2 <> 0)::BIGINT AS uncached_tokens, 800 * count(*) FILTER (conv_id % 2 <> 0) AS output_tokens, round(sum(tokens) FILTER (conv_id % 2 <> 0) * 0.8 / 1e6 + 800 * count(*) FILTER (conv_id % 2 <> 0) * 4.0 / 1e6, 6)::DOUBLE AS cost FROM s")
def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """What asking for the rest would cost."""
    return chunks.dry_run(_chunks(spark, sf), _cache(spark, sf), "model", "v1").withColumn("cost", F.round("cost", 6))


@query(
    """WITH f AS (SELECT event_type || '-' || (user_id % 7) AS conv, user_id, min(event_id) AS first FROM events GROUP BY 1, 2), p AS (SELECT conv, user_id, 'p' || row_number() OVER (PARTITION BY conv ORDER BY first) AS pid FROM f)
SELECT conv AS conversation_id, '## Participants' || chr(10) || 'pid | display_name | kind | descriptors' || chr(10) || '----|--------------|------|------------' || chr(10) || string_agg(pid || ' | User ' || user_id || ' | person | ', chr(10) ORDER BY pid) AS participant_table FROM p GROUP BY 1"""
)
def participant_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Ids are sorted as texts, p10 before p2."""
    e = table(spark, sf, "events")
    items = e.select(
        F.col("event_id").alias("pos"), F.lit(None).cast("timestamp").alias("timestamp"), F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("conversation_id"),
        F.array(participant("sender", _of("User ", "user_id"))).alias("participants"),
    )
    return chunks.participant_tables(chunks.participants(items))


@query(
    """SELECT * FROM (VALUES ('clusters', 'array', ''), ('clusters[]', 'object', ''), ('clusters[].member_ids', 'array', ''), ('clusters[].member_ids[]', 'string', ''), ('clusters[].canonical_name', 'string', ''), ('clusters[].confidence', 'string', 'high|medium|low'), ('clusters[].evidence', 'string', ''),
('derived_relations', 'array', ''), ('derived_relations[]', 'object', ''), ('derived_relations[].subject_id', 'string', ''), ('derived_relations[].object_id', 'string', ''), ('derived_relations[].type', 'string', ''), ('derived_relations[].evidence', 'string', '')) v(path, type, allowed)"""
)
def answer_shape(spark: SparkSession, sf: str) -> DataFrame:
    """The shape in which a client answers about profiles."""
    return prompts.fields(spark, "resolve")


# ---- profiles ----


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions in conversations: a user has two surfaces, an address as a clue now and then, and a type that changes."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 4 == 0, "Person").when(F.col("event_id") % 4 == 1, "creature").otherwise("org")
    clue = F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("email"), F.concat(F.lit(" U"), (F.col("user_id") % 20).cast("string"), F.lit("@X.org")))).when(F.col("event_id") % 5 == 1, F.create_map(F.lit("role"), F.col("event_type")))
    surface = F.when(F.col("event_id") % 3 == 0, _of("Long name ", F.col("user_id") % 20)).otherwise(_of("N", F.col("user_id") % 20))
    return e.select(_of("c", F.col("event_id") % 8).alias("conversation_id"), _of("e", F.col("user_id") % 20).alias("local_entity"), F.col("event_id").alias("pos"), surface.alias("surface"), kind.alias("type"), F.col("event_id").cast("string").alias("item_id"), clue.alias("clues"))


def _held(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("source_type"))
    return profiles.from_mentions(_mentions(spark, sf), items)


MENTIONED = """
mn AS (SELECT 'c' || (event_id % 8) AS conv, 'e' || (user_id % 20) AS local, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN 'Long name ' ELSE 'N' END || (user_id % 20) AS surface, CASE event_id % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'unknown' ELSE 'org' END AS type,
       event_type, CASE WHEN event_id % 5 = 0 THEN 'u' || (user_id % 20) || '@x.org' END AS ident, CASE WHEN event_id % 5 = 1 THEN event_type END AS role FROM events),
ids AS (SELECT conv, local, row_number() OVER (ORDER BY conv, local) - 1 AS n, arg_min(type, pos) AS first_type, arg_max(type, pos) AS last_type FROM mn GROUP BY 1, 2),
sf AS (SELECT conv, local, surface, count(*) AS c FROM mn GROUP BY 1, 2, 3)"""


@query(f"WITH {MENTIONED} SELECT conv AS conversation_id, local AS local_entity, first_type || ':' || n AS profile_id FROM ids")
def conversation_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """E17, F27."""
    return profiles.conversation_profiles(_mentions(spark, sf)).select("conversation_id", "local_entity", "profile_id")


@query(
    f"""WITH {MENTIONED} SELECT first_type || ':' || n AS id, last_type AS type, (SELECT arg_min(surface, struct_pack(a := -c, b := -length(surface), s := surface)) FROM sf WHERE sf.conv = ids.conv AND sf.local = ids.local) AS label,
coalesce(string_agg(DISTINCT ident, '|'), '') AS identifiers, coalesce(array_to_string(list_sort(list(DISTINCT role) FILTER (role IS NOT NULL)), '|'), '') AS roles, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS channels, count(*) AS items, array_to_string(list(surface ORDER BY pos)[1:3], '|') AS samples
FROM ids JOIN mn USING (conv, local) GROUP BY conv, local, n, first_type, last_type"""
)
def mention_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """What is known of each local name; the last type names it."""
    return _held(spark, sf).select(
        "id", "type", profiles.canonical_surface().alias("label"), _joined("identifiers"), F.coalesce(F.array_join(F.try_element_at("clues", F.lit("role")), "|"), F.lit("")).alias("roles"), _joined("channels"),
        F.size("item_ids").cast("long").alias("items"), F.array_join("sample_lines", "|").alias("samples"),
    )


@query(f"WITH {MENTIONED}, m AS (SELECT mn.*, first_type || ':' || n AS id FROM mn JOIN ids USING (conv, local)), day AS (SELECT *, pos // 3 AS item FROM m) SELECT a.id, b.id AS other, count(DISTINCT a.item) AS items FROM day a JOIN day b ON a.item = b.item AND a.id <> b.id GROUP BY 1, 2")
def co_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles that share items, and how many."""
    told = _mentions(spark, sf).withColumn("item_id", F.floor(F.col("pos") / 3).cast("string"))
    return profiles.co_occurring(told)


@query(f"WITH {MENTIONED} SELECT first_type || ':' || n AS id, last_type AS type, count(*) AS item_count, coalesce(min(ident), '') AS identifier FROM ids JOIN mn USING (conv, local) GROUP BY 1, 2")
def profile_json(spark: SparkSession, sf: str) -> DataFrame:
    """A profile as a client sees it."""
    shown = profiles.serialised(_held(spark, sf))
    field = lambda path: F.get_json_object("json", path)
    return shown.select(field("$.id").alias("id"), field("$.type").alias("type"), field("$.item_count").cast("long").alias("item_count"), F.coalesce(field("$.identifiers[0]"), F.lit("")).alias("identifier"))


@query("WITH e AS (SELECT user_id % 30 AS u, event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'User ' ELSE 'Mr ' END || (user_id % 30) AS name FROM events) SELECT 'identity:email:u' || u || '@x.org' AS id, array_to_string(list_sort(list(DISTINCT name)), '|') || '|u' || u || '@x.org' AS surfaces, count(*) AS items, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS channels FROM e GROUP BY u")
def identity_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """A profile of each identity."""
    user = F.col("user_id") % 30
    items = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("pos"), F.lit("").alias("conversation_id"), F.col("event_type").alias("source_type"),
        F.array(participant("sender", F.concat(F.when(F.col("event_id") % 2 == 0, "User ").otherwise("Mr "), user.cast("string")), "email", F.concat(F.lit("U"), user.cast("string"), F.lit("@x.org")))).alias("participants"),
    )
    found = profiles.from_clusters(identity.identity_clusters(identity.identity_members(items)))
    return found.select("id", F.array_join(F.map_keys("surfaces"), "|").alias("surfaces"), F.size("item_ids").cast("long").alias("items"), _joined("channels"))


def _made(rows: DataFrame, id_: Column, pos: Column, kind: Column | str, names: Column, identifiers: Column | None = None, items: Column | None = None) -> DataFrame:
    """Profiles with the given names, each seen once."""
    none = F.array().cast(_NONE)
    return rows.select(
        id_.alias("id"), pos.cast("long").alias("pos"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.map_from_arrays(names, F.transform(names, lambda s: F.lit(1).cast("long"))).alias("surfaces"),
        (none if identifiers is None else identifiers).alias("identifiers"), F.create_map().cast("map<string,array<string>>").alias("clues"), none.alias("channels"), (none if items is None else items).alias("item_ids"), none.alias("sample_lines"), none.alias("co_profile_ids"),
    )


@query("WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT left(p_name, 2) FROM part), k AS (SELECT name, trim(regexp_replace(regexp_replace(lower(name), '[^a-z ]', '', 'g'), ' +', ' ', 'g')) AS key FROM w) SELECT a.name AS src, b.name AS dst FROM k a JOIN k b ON a.name <> b.name AND a.key <> '' AND contains(b.key, a.key)")
def place_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Places one of whose names is part of another's."""
    p = table(spark, sf, "part")
    names = p.select(F.explode(F.split("p_name", " ")).alias("n")).union(p.select("p_name")).union(p.select(F.left("p_name", F.lit(2)))).distinct()
    return profiles.containment_edges(_made(names, F.col("n"), F.lit(0), "location", F.array("n")))


@query(
    """WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey // 40 * 2 ELSE (c_custkey // 20) * 2 + 1 END AS grp FROM customer), s AS (SELECT *, 'c' || lpad(c_custkey::VARCHAR, 9, '0') AS id, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY c_custkey) AS nth, min('c' || lpad(c_custkey::VARCHAR, 9, '0')) OVER (PARTITION BY grp) AS first FROM g)
SELECT id, CASE WHEN n <= 12 THEN 'block:' || first WHEN nth <= 12 THEN 'split:' || first ELSE 'solo:' || id END AS block FROM s"""
)
def profile_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles joined by identifier; a block of more than twelve keeps the first twelve."""
    key = F.col("c_custkey")
    group = F.when(key % 2 == 0, F.floor(key / 40) * 2).otherwise(F.floor(key / 20) * 2 + 1)
    c = table(spark, sf, "customer")
    held = _made(c, F.concat(F.lit("c"), F.lpad(key.cast("string"), 9, "0")), key, "org", F.array(F.lit("abc")), F.array(_of("g", group)))
    return profiles.blocks(held).select("id", "block")


def _groups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of customers in blocks of four, and for each block a proposed cluster: of five kinds, two of which hold and one is unsure."""
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    id_ = F.concat(F.lit("c"), F.lpad(key.cast("string"), 9, "0"))
    block = F.floor(key / 4)
    held = _made(c, id_, key, F.when((block % 5 == 2) & (key % 4 == 1), "org").otherwise("person"), F.array("c_name", _of("Alias ", key)), F.array(_of("i", key)), F.array(_of("it", key)))
    members = c.select(_of("b", block).alias("block"), id_.alias("id"))
    first = members.groupBy("block").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("g", F.expr("cast(substring(block, 2) as long)"))
    g = F.col("g") % 5
    asked = F.when(g == 1, F.array(F.col("ids")[0], F.lit("stranger"))).otherwise(F.slice("ids", 1, 2))
    answers = first.where(F.size("ids") > 1).select(
        "block", F.lit(0).alias("k"), asked.alias("member_ids"), F.when(g == 3, "Somebody else").otherwise(F.concat(F.lit("ALIAS "), (F.col("g") * 4).cast("string"))).alias("canonical_name"),
        F.when(g == 4, "sure").otherwise("high").alias("confidence"), F.lit("same name").alias("evidence"),
    )
    return held, members, answers


RESOLVED = """
pr AS (SELECT c_custkey AS key, 'c' || lpad(c_custkey::VARCHAR, 9, '0') AS id, c_custkey // 4 AS g, c_name, 'Alias ' || c_custkey AS alias FROM customer),
bl AS (SELECT g, list_sort(list(id)) AS ids, count(*) AS n FROM pr GROUP BY 1),
ok AS (SELECT g, ids[1:2] AS member_ids, g % 5 = 4 AS low FROM bl WHERE n > 1 AND g % 5 IN (0, 4))"""


@query(f"WITH {RESOLVED} SELECT 'b' || g AS block, array_to_string(member_ids, '|') AS member_ids, CASE WHEN low THEN 'low' ELSE 'high' END AS confidence FROM ok")
def cluster_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown members, mixed types and invented names are refused; a strange confidence is low."""
    held, members, answers = _groups(spark, sf)
    return profiles.valid_clusters(answers, members, held).select("block", _joined("member_ids"), "confidence")


@query(
    f"""WITH {RESOLVED}, al AS (SELECT 'accepted' AS part, 'b' || g AS block, array_to_string(member_ids, '|') AS member_ids, 'same name' AS evidence FROM ok WHERE NOT low UNION ALL SELECT 'review', 'b' || g, array_to_string(member_ids, '|'), 'same name' FROM ok WHERE low)
SELECT * FROM al UNION ALL SELECT 'accepted', 'b' || g, id, CASE WHEN n = 1 THEN 'singleton block' ELSE 'not mentioned in the answer' END FROM pr JOIN bl USING (g) WHERE id NOT IN (SELECT unnest(member_ids) FROM ok)"""
)
def blocks_settled(spark: SparkSession, sf: str) -> DataFrame:
    """What is accepted, what goes to review, and a cluster of its own for every profile left."""
    held, members, answers = _groups(spark, sf)
    accepted, review = profiles.settle(profiles.valid_clusters(answers, members, held), members, held)
    part = lambda name, rows: rows.select(F.lit(name).alias("part"), "block", _joined("member_ids"), "evidence")
    return part("accepted", accepted).unionAll(part("review", review))


def _rolled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    held, members, answers = _groups(spark, sf)
    accepted, _ = profiles.settle(profiles.valid_clusters(answers, members, held), members, held)
    groups, merges = profiles.roll_up(accepted, held)
    return held, groups, merges


@query(f"WITH {RESOLVED}, r AS (SELECT ids[2] AS id, ids[1] AS root FROM bl JOIN ok USING (g) WHERE NOT low) SELECT pr.id, coalesce(root, pr.id) AS root FROM pr LEFT JOIN r USING (id)")
def groups_rolled_up(spark: SparkSession, sf: str) -> DataFrame:
    """The root of every profile."""
    return _rolled(spark, sf)[1]


@query(f"WITH {RESOLVED}, r AS (SELECT member_ids[1] AS canonical_id, unnest(member_ids) AS id FROM ok WHERE NOT low), n AS (SELECT canonical_id, c_name AS form FROM r JOIN pr USING (id) UNION ALL SELECT canonical_id, alias FROM r JOIN pr USING (id)) SELECT canonical_id, array_to_string(list_sort(list(form)), '|') AS merged_forms, '[high] same name' AS rationale FROM n GROUP BY 1")
def resolution_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Merge rows with up to three reasons."""
    return _rolled(spark, sf)[2].select("canonical_id", _joined("merged_forms"), "rationale")


@query(f"WITH {RESOLVED}, r AS (SELECT ids[2] AS id, ids[1] AS root FROM bl JOIN ok USING (g) WHERE NOT low), a AS (SELECT pr.*, coalesce(root, pr.id) AS root FROM pr LEFT JOIN r USING (id)) SELECT root, arg_min(form, struct_pack(l := -length(form), f := form)) AS label, array_to_string(list_sort(list(form)), '|') AS aliases, count(*) // 2 AS items FROM (SELECT root, c_name AS form FROM a UNION ALL SELECT root, alias FROM a) GROUP BY 1")
def group_entities(spark: SparkSession, sf: str) -> DataFrame:
    """An entity of each group, named by the most used surface of all."""
    held, groups, _ = _rolled(spark, sf)
    return profiles.entities_of(held, groups).select("root", "label", _joined("aliases"), F.size("item_ids").cast("long").alias("items"))


@query(f"WITH {RESOLVED} SELECT id AS profile_id, 'org:profile:' || id AS entity_id FROM pr WHERE g % 5 = 2 AND key % 4 = 1")
def profile_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The entity that an organisation's profile stands for."""
    held, groups, _ = _rolled(spark, sf)
    return profiles.entity_of(held, groups, "org")


def _persons(spark: SparkSession, sf: str) -> Found:
    """Persons of customers; every third has no address, and one is the owner."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    mails = F.when(key % 3 == 0, F.array().cast(_NONE)).otherwise(F.array(_of("I", key)))
    rows = c.select(_of("p", key).alias("id"), key.alias("pos"), F.lower("c_name").alias("label"), F.array(F.lower("c_name")).alias("aliases"), mails.alias("emails"), F.when(key == 1, True).alias("owner"))
    told = c.select(_of("p", key).alias("entity_id"), _of("it", key).alias("item_id"), F.lit("").alias("text"), key.alias("pos")).unionAll(c.where(key % 4 == 1).select(_of("p", key), _of("jt", key), F.lit(""), key))
    return Found(entities.shaped(rows, "person"), told)


@query(f"WITH {RESOLVED} SELECT id AS profile_id, 'p' || key AS entity_id FROM pr WHERE NOT (g % 5 = 2 AND key % 4 = 1)")
def profile_people(spark: SparkSession, sf: str) -> DataFrame:
    """A profile is the person with one of its identifiers, else with one of its names."""
    return profiles.person_of(_groups(spark, sf)[0], _persons(spark, sf).entities)


@query(f"WITH {RESOLVED} SELECT 'p' || (g * 4) AS old_id, 'p' || (g * 4 + 1) AS new_id FROM ok WHERE NOT low")
def people_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Of persons whose profiles are one group the most mentioned stays."""
    held, groups, _ = _rolled(spark, sf)
    found = _persons(spark, sf)
    return profiles.merged_people(found.entities, found.mentions, profiles.person_of(held, found.entities), groups)


@query("SELECT 'e' || o_custkey AS source, 'o' || (o_custkey % 9) AS target, 'paid' AS kind, 1.0::DOUBLE AS weight, array_to_string(list_sort(list(DISTINCT o_orderkey::VARCHAR))[1:20], '|') AS evidence FROM orders WHERE o_custkey % 5 <> 0 AND o_custkey % 9 <> 4 GROUP BY o_custkey")
def claimed_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Claimed relations whose ends are both known, united."""
    o = table(spark, sf, "orders")
    key, part = F.col("o_custkey"), F.col("o_custkey") % 9
    claims = o.select(F.lit("c").alias("conversation_id"), _of("s", key).alias("subject"), _of("t", part).alias("object"), F.lit("paid").alias("type"), F.col("o_orderkey").cast("string").alias("item_id"))
    known = o.where("o_custkey % 5 <> 0").select(F.lit("c").alias("conversation_id"), _of("s", key).alias("local_entity"), _of("e", key).alias("entity_id")).distinct()
    ends = o.where(part != 4).select(F.lit("c").alias("conversation_id"), _of("t", part).alias("local_entity"), _of("o", part).alias("entity_id")).distinct()
    return relations.claimed(claims, known.unionAll(ends)).select("source", "target", "kind", "weight", F.array_join("evidence_item_ids", "|").alias("evidence"))


@query(
    """WITH c AS (SELECT c_custkey AS k, c_custkey // 4 AS g FROM customer), s AS (SELECT g, count(*) AS n FROM c GROUP BY 1)
SELECT 'p' || k AS id, n > 1 AND g % 3 = 0 AS merge FROM c JOIN s USING (g)"""
)
def name_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Equal names aren't merged if two of them have different addresses in a domain, or one has a shared mailbox."""
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    group = F.floor(key / 4)
    letters = F.translate(group.cast("string"), "0123456789", "abcdefghij")
    own, common = F.array(F.concat(F.lit("x"), key.cast("string"), F.lit("@one.org"))), F.array(F.concat(F.lit("same"), group.cast("string"), F.lit("@one.org")))
    mails = F.when(group % 3 == 0, common).when(group % 3 == 1, own).otherwise(F.when(key % 4 == 0, F.array(F.lit("no.reply@two.org"))).otherwise(F.array().cast(_NONE)))
    rows = c.select(_of("p", key).alias("id"), key.alias("pos"), F.concat(F.lit("Family "), letters, F.lit("x Name")).alias("label"), mails.alias("emails"))
    told = c.select(_of("p", key).alias("entity_id"), F.lit("i").alias("item_id"))
    groups = merge.name_groups(entities.shaped(rows, "person"), told)
    return groups.select("id", "merge")


@query("WITH s AS (SELECT 'User ' || user_id AS key, 'u' || min(user_id) AS person_id FROM events GROUP BY user_id) SELECT 'surface' AS kind, key, person_id FROM s UNION ALL SELECT 'address', 'u' || user_id || '@x.org', 'u' || user_id FROM (SELECT DISTINCT user_id FROM events)")
def participant_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Which person a surface or an address stands for, the first in order."""
    users = table(spark, sf, "events").select("user_id").distinct()
    rows = users.select(_of("u", "user_id").alias("id"), F.col("user_id").alias("pos"), _of("User ", "user_id").alias("label"), F.array(_of("User ", "user_id")).alias("aliases"), F.array(F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("@x.org"))).alias("emails"))
    surfaces, addresses = relations.person_keys(entities.shaped(rows, "person"))
    return surfaces.select(F.lit("surface").alias("kind"), F.col("surface").alias("key"), "person_id").unionAll(addresses.select(F.lit("address"), F.col("address"), "person_id"))


@query(
    """WITH d AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 10 = 0) AS twice FROM customer)
SELECT n + twice AS items, n AS canonical_items, n AS relevant_items, twice AS exact_dupes, 0::BIGINT AS near_dupes, twice AS n_duplicates, n AS people, 'heuristic' AS mode, true AS has_owner, 0::BIGINT AS review_queue FROM d"""
)
def build_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A whole build, from items to the repaired graph, in figures."""
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    rows = c.select(key.alias("n"), "c_name").unionAll(c.where("c_custkey % 10 = 0").select((key + 100_000_000).alias("n"), "c_name"))
    base = F.col("n") % 100_000_000
    who = F.array(
        participant("sender", F.col("c_name"), "email", F.concat(F.lit("c"), base.cast("string"), F.lit("@gmail.com")), raw=F.col("c_name")), participant("recipient", F.lit("Desk"), "email", F.lit("support@acme.example"), "system"),
    )
    none = F.lit(None).cast("string")
    items = rows.select(
        _of("i", "n").alias("id"), F.col("n").alias("pos"), F.lit("email").alias("source_type"), F.lit("email").alias("channel"), _of("thread", base).alias("conversation_id"), F.lit("").alias("timestamp_raw"), F.timestamp_seconds(base * 60).alias("timestamp"),
        who.alias("participants"), F.lit("hi").alias("subject"), _of("see you ", base).alias("body"), F.lit("").alias("notes"), F.sha2(base.cast("string"), 256).alias("content_hash"), none.alias("duplicate_of"),
    )
    s = build.build(items).stats
    kept = {k: s[k] for k in ("items", "canonical_items", "relevant_items", "exact_dupes", "near_dupes", "n_duplicates", "people", "review_queue")}
    row = spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in kept.items()], F.lit(s["mode"]).alias("mode"), F.lit(s["owner"] is not None).alias("has_owner"))
    return row


@query("""WITH b AS (SELECT c_custkey // 4 AS g, '{"profiles": [' || string_agg('{"id":"c' || c_custkey || '"}', ', ' ORDER BY '{"id":"c' || c_custkey || '"}') || ']}' AS full_text FROM customer GROUP BY 1 HAVING count(*) > 1) SELECT 'b' || g AS block, full_text, left(sha256('modelv2' || full_text), 20) AS key FROM b""")
def resolution_keys(spark: SparkSession, sf: str) -> DataFrame:
    """What is asked about a block, and the key under which the answer is kept; profiles in a fixed order."""
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    shown = c.select(_of("c", key).alias("id"), F.to_json(F.struct(_of("c", key).alias("id"))).alias("json"))
    return extraction.block_prompts(shown, c.select(_of("b", F.floor(key / 4)).alias("block"), _of("c", key).alias("id")), "model", "v2").select("block", "full_text", "key")


@query("SELECT 'b' || (c_custkey // 4) AS block, 'c' || c_custkey AS subject_id, 'c' || (c_custkey + 1) AS object_id, CASE WHEN c_custkey % 3 = 0 THEN 'related' ELSE 'knows' END AS type, '' AS evidence FROM customer WHERE c_custkey % 4 < 3 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)")
def derived_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations that a client derives, if both ends are in the block."""
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    block = _of("b", F.floor(key / 4)).alias("block")
    asked = c.select(block, _of("c", key).alias("subject_id"), _of("c", key + 1).alias("object_id"), F.when(key % 3 != 0, "knows").alias("type"), F.lit(None).cast("string").alias("evidence"))
    return profiles.derived_relations(asked, c.select(block, _of("c", key).alias("id")))
