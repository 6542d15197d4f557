"""Queries over what a bundle answers: a graph made of the events of the driver's tables, and each view of it beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import entities, extraction, graph, merge, relations
from graphloom.plans import views
from graphloom.plans.build import REVIEW, Bundle
from graphloom.plans.catalogue import query
from graphloom.plans.tables import participant, table
from graphloom.scratch import materialise
from graphloom.streaming import limits

# Events are items, of which every tenth is a copy of the one before it; users are persons, some of them shared mailboxes and one the owner;
# kinds of event are organisations; twenty amounts are paid by users.
BUNDLE = """
it AS (SELECT event_id::VARCHAR AS id, event_id AS pos, event_type AS source_type, event_type || '-' || (user_id % 7) AS conv, ts, user_id, value, event_type || ' of ' || user_id AS subject, 'body ' || props AS body,
       CASE WHEN event_id % 10 = 9 THEN (event_id - 1)::VARCHAR END AS dup FROM events),
us AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY 1),
person AS (SELECT 'u' || user_id AS id, 0 AS place, user_id AS pos, 'person' AS type, 'User ' || user_id AS label, [CASE WHEN user_id % 17 = 3 THEN 'no.reply@x.org' ELSE 'u' || user_id || '@x.org' END, 'z' || user_id || '@x.org'] AS emails,
           user_id = (SELECT min(user_id) FROM us) AS owner, user_id % 17 = 3 AS system FROM us),
money AS (SELECT 'm' || k AS id, 3 AS place, -k AS pos, 'money' AS type, 'Amount ' || k AS label, (k * 10 + 0.25)::DECIMAL(18,2) AS amount, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency, k % 4 = 3 AS ambiguous FROM range(20) r(k)),
org AS (SELECT DISTINCT 'o' || event_type AS id, 1 AS place, 0 AS pos, 'org' AS type, upper(event_type) AS label FROM events),
en AS (SELECT id, place, pos, type, label FROM person UNION ALL SELECT id, place, pos, type, label FROM money UNION ALL SELECT id, place, pos, type, label FROM org),
me AS (SELECT 'u' || user_id AS entity_id, id AS item_id, pos FROM it UNION ALL SELECT 'm' || (user_id % 20), id, pos FROM it WHERE source_type = 'purchase' UNION ALL SELECT 'o' || source_type, id, pos FROM it WHERE value >= 20),
raw AS (SELECT 'u' || least(a.user_id, b.user_id) AS source, 'u' || greatest(a.user_id, b.user_id) AS target, 'corresponded_with' AS kind, a.id AS item FROM it a JOIN us b ON b.user_id = a.user_id + 1 + a.pos % 2
        UNION SELECT 'u' || user_id, 'o' || source_type, 'affiliated_with', id FROM it WHERE value >= 50 UNION SELECT 'u' || user_id, 'm' || (user_id % 20), 'paid', id FROM it WHERE source_type = 'purchase' AND value < 40
        UNION SELECT 'm' || (user_id % 20), 'o' || source_type, 'paid_to', id FROM it WHERE source_type = 'purchase'),
ed AS (SELECT 'e:' || left(sha1(source || '|' || target || '|' || kind), 10) AS id, source, target, kind, count(*)::DOUBLE AS weight, list_sort(list(item))[1:20] AS evidence FROM raw GROUP BY source, target, kind),
deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ed UNION ALL SELECT target FROM ed) GROUP BY 1),
cnt AS (SELECT entity_id AS id, count(*) AS n FROM me GROUP BY 1)"""


_BUNDLES: dict[tuple[str, str], Bundle] = {}


def _bundle(spark: SparkSession, sf: str) -> Bundle:
    """The bundle that the views are asked of: written once in a session, as bundles are, and read by every query."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUNDLES:
        _BUNDLES[key] = _made(spark, sf)
    return _BUNDLES[key]


def _made(spark: SparkSession, sf: str) -> Bundle:
    e = table(spark, sf, "events")
    user, pos = F.col("user_id").cast("string"), F.col("event_id")
    item = pos.cast("string")
    of = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    items = e.select(
        item.alias("id"), pos.alias("pos"), F.col("event_type").alias("source_type"), F.lit("").alias("channel"), F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("conversation_id"),
        F.lit("").alias("timestamp_raw"), F.col("ts").cast("timestamp").alias("timestamp"), F.array(participant("sender", of("User ", F.col("user_id")))).alias("participants"),
        F.concat_ws(" of ", "event_type", user).alias("subject"), F.concat(F.lit("body "), "props").alias("body"), F.lit("").alias("notes"), F.when(pos % 10 == 9, (pos - 1).cast("string")).alias("duplicate_of"),
    )
    users = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    lowest = F.broadcast(users.agg(F.min("user_id").alias("lowest")))
    label, shared = of("User ", F.col("user_id")), F.col("user_id") % 17 == 3
    persons = users.join(lowest, F.lit(True)).select(
        of("u", F.col("user_id")).alias("id"), F.col("user_id").alias("pos"), label.alias("label"), F.array(label).alias("aliases"),
        F.array(F.when(shared, "no.reply@x.org").otherwise(F.concat(F.lit("u"), user, F.lit("@x.org"))), F.concat(F.lit("z"), user, F.lit("@x.org"))).alias("emails"), F.when(F.col("user_id") == F.col("lowest"), True).alias("owner"),
    )
    k = F.col("id")
    unsure = (k % 4 == 0) | (k % 4 == 3)
    money = spark.range(20).select(
        of("m", k).alias("id"), (-k).alias("pos"), of("Amount ", k).alias("label"), (k * 10 + F.lit(0.25)).cast("decimal(18,2)").alias("amount"), F.when(k % 4 == 1, "EUR").when(k % 4 != 0, "USD").alias("currency"),
        (k % 4 == 3).alias("currency_ambiguous"), unsure.alias("needs_review"), (~unsure).alias("currency_resolved"), F.array(of("around ", k)).alias("snippets"),
    )
    orgs = e.select(F.concat(F.lit("o"), "event_type").alias("id"), F.lit(0).alias("pos"), F.upper("event_type").alias("label")).distinct()
    found = entities.shaped(persons, "person").unionByName(entities.shaped(money, "money")).unionByName(entities.shaped(orgs, "org"))
    told = lambda rows, entity: rows.select(entity.alias("entity_id"), item.alias("item_id"), F.lit("said").alias("text"), pos.alias("pos"))
    paid, amount = e.where("event_type = 'purchase'"), of("m", F.col("user_id") % 20)
    mentions = told(e, of("u", F.col("user_id"))).unionAll(told(paid, amount)).unionAll(told(e.where("value >= 20"), F.concat(F.lit("o"), "event_type")))
    tie = lambda rows, source, target, kind: relations.weighed(rows.select(source.alias("source"), target.alias("target"), item.alias("item_id")), kind)
    other = e.withColumn("other", F.col("user_id") + 1 + F.col("event_id") % 2).join(users.select(F.col("user_id").alias("other")), "other", "left_semi")
    edges = (
        tie(other, of("u", F.least("user_id", "other")), of("u", F.greatest("user_id", "other")), "corresponded_with")
        .unionByName(tie(e.where("value >= 50"), of("u", F.col("user_id")), F.concat(F.lit("o"), "event_type"), "affiliated_with"))
        .unionByName(tie(paid.where("value < 40"), of("u", F.col("user_id")), amount, "paid"))
        .unionByName(tie(paid, amount, F.concat(F.lit("o"), "event_type"), "paid_to"))
    )
    topics = e.where("value >= 30").select(item.alias("item_id"), F.array(F.concat(F.lit("About "), "event_type")).alias("topics"))
    canonical = items.where("duplicate_of is null")
    relevance = extraction.relevance(canonical, topics)
    merges = persons.select(F.col("id").alias("canonical_id"), F.when(F.col("pos") % 3 == 0, F.array("label", "id")).otherwise(F.array("label")).alias("merged_forms"), F.lit("same").alias("rationale"))
    spans = canonical.groupBy(F.upper("source_type").alias("label"), F.concat(F.lit("o"), "source_type").alias("entity_id")).agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count("*").alias("count"))
    copies = items.where("duplicate_of is not null").select("id", F.col("duplicate_of").alias("canonical_id"))
    none = spark.createDataFrame([], REVIEW)
    return Bundle(
        materialise(items, "b-items"), materialise(copies, "b-copies"), materialise(found, "b-entities"), materialise(mentions, "b-mentions"), materialise(relations.numbered(edges), "b-edges"), materialise(merges, "b-merges"), spark.createDataFrame([], "entity_id string, person_id string"),
        materialise(relevance, "b-relevance"), materialise(spans, "b-timeline"), none, none,
    )


def _joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


def _row(spark: SparkSession, **columns) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


FIRST = """
lab AS (SELECT e.id AS edge, e.kind, e.source, e.target, s.label AS source_label, t.label AS target_label FROM ed e JOIN en s ON s.id = e.source JOIN en t ON t.id = e.target),
payers AS (SELECT target AS id, array_to_string(list(l ORDER BY edge)[1:3], '|') AS payers FROM (SELECT target, source_label AS l, min(edge) AS edge FROM lab WHERE kind = 'paid' GROUP BY 1, 2) GROUP BY 1),
payees AS (SELECT source AS id, array_to_string(list(l ORDER BY edge)[1:3], '|') AS payees FROM (SELECT source, target_label AS l, min(edge) AS edge FROM lab WHERE kind IN ('paid_to', 'paid') GROUP BY 1, 2) GROUP BY 1),
orgs AS (SELECT source AS id, array_to_string(list(l ORDER BY edge)[1:3], '|') AS orgs FROM (SELECT source, target_label AS l, min(edge) AS edge FROM lab WHERE kind = 'affiliated_with' GROUP BY 1, 2) GROUP BY 1)"""


@query(
    f"""WITH {BUNDLE}, {FIRST}, i AS (SELECT entity_id AS id, array_to_string(list_sort(list(DISTINCT item_id))[1:8], '|') AS item_ids FROM me GROUP BY 1)
SELECT m.id AS entity_id, amount, currency, label, coalesce(payers, '') AS payers, coalesce(payees, '') AS payees, currency IS NULL AS flagged, coalesce(item_ids, '') AS item_ids, 'around ' || substr(m.id, 2) AS context FROM money m LEFT JOIN payers USING (id) LEFT JOIN payees USING (id) LEFT JOIN i USING (id)"""
)
def money_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts with who paid and who was paid."""
    b = _bundle(spark, sf)
    return graph.money_rows(b.entities, b.mentions, b.edges).select("entity_id", "amount", "currency", "label", _joined("payers"), _joined("payees"), "flagged", _joined("item_ids"), "context")


@query(
    f"""WITH {BUNDLE}, {FIRST}, w AS (SELECT id, sum(weight) AS w FROM (SELECT source AS id, weight FROM ed WHERE kind = 'corresponded_with' UNION ALL SELECT target, weight FROM ed WHERE kind = 'corresponded_with') GROUP BY 1),
i AS (SELECT entity_id AS id, array_to_string(list_sort(list(DISTINCT item_id))[1:6], '|') AS item_ids, array_to_string(list_sort(list(DISTINCT source_type))[1:4], '|') AS channels FROM me JOIN it ON it.id = item_id GROUP BY 1)
SELECT p.id AS entity_id, label AS name, array_to_string(emails, '|') AS emails, n AS mentions, coalesce(w, 0)::DOUBLE AS correspondence_weight, coalesce(orgs, '') AS orgs, channels, item_ids
FROM person p JOIN cnt USING (id) LEFT JOIN w USING (id) LEFT JOIN orgs USING (id) LEFT JOIN i USING (id) WHERE NOT owner AND NOT system ORDER BY coalesce(w, 0) + n * 0.1 DESC, pos, p.id LIMIT 15"""
)
def who_rows(spark: SparkSession, sf: str) -> DataFrame:
    """People with organisations, channels and first items; owner and automated senders are left out."""
    b = _bundle(spark, sf)
    return graph.who_rows(b.items, b.entities, b.mentions, b.edges).select("entity_id", "name", _joined("emails"), "mentions", "correspondence_weight", _joined("orgs"), _joined("channels"), _joined("item_ids"))


EPISODES = f"""{BUNDLE},
tt AS (SELECT 'About ' || source_type AS label, id, pos, ts FROM it WHERE value >= 30 AND dup IS NULL),
late AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY label ORDER BY ts, pos)) >= 86400000000 THEN 1 ELSE 0 END AS late FROM tt),
ses AS (SELECT *, sum(late) OVER (PARTITION BY label ORDER BY ts, pos ROWS UNBOUNDED PRECEDING) AS session FROM late)"""


@query(f"""WITH {EPISODES} SELECT label, min(ts) AS start, max(ts) AS "end", count(*) AS count, array_to_string(list(id ORDER BY ts, pos)[1:5], '|') AS item_ids FROM ses GROUP BY label, session""")
def topic_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes of topics; a whole day without an item ends one."""
    b = _bundle(spark, sf)
    return graph.topic_episodes(b.items, b.relevance, gap_days=0).select("label", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "count", _joined("item_ids"))


SPANS = f"{BUNDLE}, sp AS (SELECT upper(source_type) AS label, min(ts) AS a, max(ts) AS z, count(*) AS n FROM it WHERE dup IS NULL GROUP BY 1)"


@query(f"WITH {SPANS}, al AS (SELECT min(a) AS lo, max(z) AS hi FROM sp) SELECT label, n AS count, round((epoch_us(a) - epoch_us(lo)) / (epoch_us(hi) - epoch_us(lo)), 9)::DOUBLE AS from_share, round((epoch_us(z) - epoch_us(lo)) / (epoch_us(hi) - epoch_us(lo)), 9)::DOUBLE AS to_share FROM sp, al")
def timeline_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Bars between the first start and the last end of all."""
    return graph.timeline_scale(_bundle(spark, sf).timeline).select("label", "count", F.round("from_share", 9).alias("from_share"), F.round("to_share", 9).alias("to_share"))


@query(
    f"""WITH {BUNDLE}, v AS (SELECT id, CASE WHEN value >= 30 THEN 'About ' || source_type ELSE 'no topics assigned' END AS rationale FROM it WHERE dup IS NULL)
SELECT it.id, v.rationale FROM it JOIN v ON v.id = coalesce(dup, it.id)"""
)
def verdict_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    """A copy has its canonical item's verdict."""
    return views.verdicts(_bundle(spark, sf)).select(F.col("item_id").alias("id"), "rationale")


@query(
    f"""WITH {BUNDLE}, f AS (SELECT * FROM it WHERE source_type = 'view' AND contains(lower(subject), 'of 1')), v AS (SELECT id, CASE WHEN value >= 30 THEN 'About ' || source_type ELSE 'no topics assigned' END AS rationale FROM it WHERE dup IS NULL)
SELECT f.id, subject, 'User ' || user_id AS sender, left(body, 140) AS preview, dup AS duplicate_of, v.rationale AS relevance_rationale, (SELECT count(*) FROM f) AS total FROM f JOIN v ON v.id = coalesce(dup, f.id) ORDER BY pos LIMIT 100 OFFSET 5"""
)
def items_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the items that fit, and how many fit."""
    page, total = views.items_page(_bundle(spark, sf), source_type="view", relevant=True, q="OF 1", offset=5)
    return page.select("id", "subject", "sender", "preview", "duplicate_of", "relevance_rationale", F.lit(total).cast("long").alias("total"))


@query(f"WITH {BUNDLE}, x AS (SELECT id FROM it WHERE source_type = 'purchase' AND value >= 20 ORDER BY pos LIMIT 1) SELECT me.item_id, e.id, e.label, e.type, it.subject FROM me JOIN x ON x.id = item_id JOIN en e ON e.id = entity_id JOIN it ON it.id = item_id")
def item_detail(spark: SparkSession, sf: str) -> DataFrame:
    """An item and the entities that it mentions."""
    b = _bundle(spark, sf)
    told = table(spark, sf, "events").where("value >= 20").select(F.col("event_id").cast("string").alias("id"))
    chosen = b.items.where("source_type = 'purchase'").join(told, "id", "left_semi").orderBy("pos").first().id
    row, named = views.item(b, chosen)
    return named.join(F.broadcast(row.select(F.col("id").alias("item_id"), "subject")), F.lit(True)).select("item_id", "id", "label", "type", "subject")


@query(f"WITH {BUNDLE}, x AS (SELECT user_id FROM it GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1) SELECT id AS item_id, 'said' AS text, source_type, left(body, 160) AS snippet FROM it WHERE user_id = (SELECT user_id FROM x) ORDER BY pos LIMIT 50")
def entity_detail(spark: SparkSession, sf: str) -> DataFrame:
    """An entity's first fifty mentions."""
    b = _bundle(spark, sf)
    chosen = b.mentions.where("entity_id like 'u%'").groupBy("entity_id").count().orderBy(F.desc("count"), F.substring("entity_id", 2, 20).cast("long")).first().entity_id
    return views.entity(b, chosen)[1]


@query(
    f"""WITH {BUNDLE}, t AS (SELECT * FROM ed WHERE source = 'opurchase' OR target = 'opurchase' ORDER BY id LIMIT 20), n AS (SELECT CASE WHEN source = 'opurchase' THEN target ELSE source END AS id FROM (SELECT * FROM t ORDER BY id LIMIT 10)),
c AS (SELECT item_id FROM me WHERE entity_id = 'opurchase' ORDER BY pos, item_id LIMIT 8)
SELECT 'edge' AS part, id FROM t UNION ALL SELECT 'neighbour', id FROM n UNION ALL SELECT 'citation', item_id FROM c UNION ALL SELECT 'answer', 'Entity: PURCHASE (org)'"""
)
def entity_answer(spark: SparkSession, sf: str) -> DataFrame:
    """An entity with its edges, neighbours and citations."""
    found = views.entity_answer(_bundle(spark, sf), "opurchase")
    part = lambda name, rows, c: rows.select(F.lit(name).alias("part"), F.col(c).alias("id"))
    rows = part("edge", found["edges"], "id").unionAll(part("neighbour", found["subgraph"], "entity_id")).unionAll(part("citation", found["citations"], "item_id"))
    return rows.unionAll(_row(spark, part="answer", id=found["answer"]))


@query(f"WITH {BUNDLE} SELECT id AS canonical_id, label || '|' || id AS merged_forms FROM person WHERE pos % 3 = 0")
def merge_list(spark: SparkSession, sf: str) -> DataFrame:
    """P15."""
    return views.merge_list(_bundle(spark, sf)).select("canonical_id", _joined("merged_forms"))


@query(f"WITH {BUNDLE}, n AS (SELECT en.id, label, coalesce(n, 0) AS mentions, coalesce(degree, 0) AS degree FROM en LEFT JOIN deg USING (id) LEFT JOIN cnt USING (id) WHERE type <> 'person' OR coalesce(degree, 0) >= 3) SELECT id, label, mentions, degree, (SELECT count(*) FROM ed WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)) AS links FROM n")
def graph_view(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes from a degree on, and the links between them."""
    nodes, links = views.graph_view(_bundle(spark, sf), 3)
    return nodes.select("id", "label", "mentions", "degree", F.lit(links.count()).cast("long").alias("links"))


@query(f"WITH {BUNDLE} SELECT id, degree FROM en JOIN deg USING (id) WHERE contains(lower(label), 'user 1') UNION ALL SELECT id, 0 FROM en WHERE contains(lower(label), 'user 1') AND id NOT IN (SELECT id FROM deg)")
def node_list(spark: SparkSession, sf: str) -> DataFrame:
    """T12."""
    return views.node_list(_bundle(spark, sf), "USER 1").select("id", "degree")


@query(
    f"""WITH {BUNDLE}, s AS (SELECT entity_id AS id, array_to_string(list(item_id ORDER BY pos)[1:4], '|') AS sources FROM (SELECT entity_id, item_id, min(pos) AS pos FROM me GROUP BY 1, 2) GROUP BY 1)
SELECT id AS entity_id, amount, CASE WHEN ambiguous THEN 'mixed-currency' ELSE 'no-currency-marker' END AS reason, coalesce(sources, '') AS sources FROM money LEFT JOIN s USING (id) WHERE currency IS NULL OR ambiguous"""
)
def currency_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts for review, why, and where they stand."""
    found = views.currency_flags(_bundle(spark, sf))
    return found.select("entity_id", "amount", "reason", F.coalesce(F.array_join(F.transform("sources", lambda s: s["item_id"]), "|"), F.lit("")).alias("sources"))


@query(f"WITH {BUNDLE} SELECT id, CASE WHEN id IN ('m0', 'm3') THEN 'GBP' ELSE currency END AS currency, CASE id WHEN 'm0' THEN '£0.25' WHEN 'm3' THEN '£30.25' ELSE label END AS label, CASE WHEN id IN ('m0', 'm3') THEN false ELSE currency IS NULL OR ambiguous END AS needs_review FROM money")
def currency_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A user's decisions over amounts, laid over the table."""
    b = _bundle(spark, sf)
    decided = spark.range(1).select(F.explode(F.array(F.lit("m0"), F.lit("m3"), F.lit("u1"))).alias("entity_id"), F.lit("GBP").alias("currency"))
    return merge.corrected_currency(b.entities, decided).where("type = 'money'").select("id", "currency", "label", "needs_review")


@query(
    f"""WITH {BUNDLE} SELECT * FROM (VALUES ('money', 'What are the financial amounts and costs?', NULL), ('timeline', 'Show the timeline of events in order.', NULL), ('who', 'Who are the key people involved?', NULL)) v(id, q, entity_id)
UNION ALL SELECT * FROM (SELECT 'who', 'What do we know about ' || label || '?', p.id FROM person p JOIN cnt USING (id) WHERE NOT owner ORDER BY n DESC, pos, p.id LIMIT 2)"""
)
def starter_questions(spark: SparkSession, sf: str) -> DataFrame:
    """T10, P26."""
    return views.starter_questions(_bundle(spark, sf))


@query(
    f"""WITH {EPISODES}, kn AS (SELECT currency, sum(amount) AS total FROM money WHERE currency IS NOT NULL GROUP BY 1), n15 AS (SELECT least(15, count(*)) AS n FROM person WHERE NOT owner AND NOT system),
far AS (SELECT label, CASE WHEN date_diff('day', lag(ts) OVER w, ts) > 15 OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 15 * 86400000000 THEN 1 ELSE 0 END AS late FROM tt WINDOW w AS (PARTITION BY label ORDER BY ts, pos))
SELECT 'money' AS id, '15 amount(s) resolved; 5 flagged (no currency marker — excluded from totals). Total: ' || string_agg(replace(format('{{:,.2f}}', total::DOUBLE), ' ', '') || ' ' || currency, ', ' ORDER BY currency) AS answer FROM kn
UNION ALL SELECT 'who', n || ' key people identified (owner excluded).' FROM n15 UNION ALL SELECT 'timeline', 'Timeline: ' || (SELECT count(DISTINCT label) + sum(late) FROM far)::BIGINT || ' episode(s) in order.'"""
)
def preset_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences in which the preset questions are answered."""
    b = _bundle(spark, sf)
    rows = [_row(spark, id=name, answer=views.run(name, b)["answer"]) for name in ("money", "who", "timeline")]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


@query("SELECT c_custkey AS question, c_custkey::VARCHAR AS item_id, 1 AS rank FROM customer WHERE c_custkey IN (SELECT event_id FROM events) UNION ALL SELECT c_custkey, (c_custkey + 1)::VARCHAR, CASE WHEN c_custkey IN (SELECT event_id FROM events) THEN 2 ELSE 1 END FROM customer WHERE c_custkey + 1 IN (SELECT event_id FROM events)")
def cited_items(spark: SparkSession, sf: str) -> DataFrame:
    """The ids in an answer that are items, first seen first."""
    said = F.concat(F.lit("It was ["), F.col("c_custkey").cast("string"), F.lit("], not [nobody], and ["), (F.col("c_custkey") + 1).cast("string"), F.lit("]; see ["), F.col("c_custkey").cast("string"), F.lit("]."))
    answers = table(spark, sf, "customer").select(F.col("c_custkey").alias("question"), said.alias("answer"))
    return graph.cited(answers, table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id")))


CONTEXT = f"""{BUNDLE}, seed AS (SELECT id FROM person WHERE NOT owner UNION ALL SELECT id FROM money),
adj AS (SELECT source AS a, target AS b, id FROM ed UNION ALL SELECT target, source, id FROM ed), one AS (SELECT DISTINCT b AS id FROM adj WHERE a IN (SELECT id FROM seed)),
near AS (SELECT id FROM seed UNION SELECT id FROM one), two AS (SELECT id FROM near UNION SELECT b FROM adj WHERE a IN (SELECT id FROM one)), tied AS (SELECT DISTINCT id FROM adj WHERE a IN (SELECT id FROM near)),
rel AS (SELECT e.id, '  ' || s.label || ' —[' || kind || ']→ ' || t.label AS line FROM ed e JOIN tied USING (id) JOIN en s ON s.id = source JOIN en t ON t.id = target ORDER BY e.id LIMIT 20),
oth AS (SELECT place, pos, id, '  ' || upper(type) || ' ' || label AS line FROM en WHERE id IN (SELECT id FROM two) AND id NOT IN (SELECT id FROM seed) ORDER BY place, pos, id LIMIT 12)"""


@query(
    f"""WITH {CONTEXT}, hit AS (SELECT evidence AS x FROM ed WHERE id IN (SELECT id FROM tied)), held AS (SELECT DISTINCT unnest(x) AS id FROM hit UNION SELECT item_id FROM me WHERE entity_id IN (SELECT id FROM two)),
top AS (SELECT it.id, it.pos FROM it JOIN held USING (id) ORDER BY pos LIMIT 16)
SELECT 'RELATIONS:' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY id) FROM rel) || chr(10) || 'RELATED ENTITIES:' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY place, pos, id) FROM oth) AS text, (SELECT string_agg(id, '|' ORDER BY pos) FROM top) AS retrieved"""
)
def ask_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A question that names nothing starts from all amounts and people."""
    found = views.ask(_bundle(spark, sf), "zzz")
    return _row(spark, text=found["subgraph_text"], retrieved="|".join(found["retrieved"]))


@query(
    f"""WITH {BUNDLE}, seed AS (SELECT 'oview' AS id), adj AS (SELECT source AS a, target AS b, id FROM ed UNION ALL SELECT target, source, id FROM ed),
near AS (SELECT id FROM seed UNION SELECT b FROM adj WHERE a = 'oview'), two AS (SELECT id FROM near UNION SELECT b FROM adj WHERE a IN (SELECT id FROM near)), tied AS (SELECT DISTINCT id FROM adj WHERE a IN (SELECT id FROM near)),
rel AS (SELECT e.id, '  ' || s.label || ' —[' || kind || ']→ ' || t.label AS line FROM ed e JOIN tied USING (id) JOIN en s ON s.id = source JOIN en t ON t.id = target ORDER BY e.id LIMIT 20),
oth AS (SELECT place, pos, id, '  ' || upper(type) || ' ' || label AS line FROM en WHERE id IN (SELECT id FROM two) AND id <> 'oview' ORDER BY place, pos, id LIMIT 12),
held AS (SELECT DISTINCT unnest(evidence) AS id FROM ed WHERE id IN (SELECT id FROM tied) UNION SELECT item_id FROM me WHERE entity_id IN (SELECT id FROM two)),
top AS (SELECT it.*, (CASE WHEN held.id IS NULL THEN 0 ELSE 2 END) + (CASE WHEN source_type = 'view' THEN 1 ELSE 0 END) AS score FROM it LEFT JOIN held USING (id)), best AS (SELECT * FROM top WHERE score > 0 ORDER BY score DESC, pos LIMIT 16)
SELECT 'MATCHED ENTITIES:' || chr(10) || '  ORG VIEW' || chr(10) || 'RELATIONS:' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY id) FROM rel) || chr(10) || 'RELATED ENTITIES:' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY place, pos, id) FROM oth) AS text,
(SELECT string_agg('[' || id || '] (' || source_type || ', ' || strftime(ts, '%Y-%m-%dT%H:%M') || ') from User ' || user_id || ': ' || body, chr(10) || chr(10) ORDER BY score DESC, pos) FROM best) AS sources, (SELECT id FROM best ORDER BY score DESC, pos LIMIT 1) AS cited"""
)
def ask_question(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of a question, and the citation of its answer."""

    class Recorder:
        user = ""

        def complete(self, system: str, user: str) -> str:
            Recorder.user = user
            first = user.split("cite these ids):\n")[1].split("]")[0][1:]
            return f"See [{first}] and [none]."

    found = views.ask(_bundle(spark, sf), "Show me the view", Recorder())
    return _row(spark, text=found["subgraph_text"], sources=Recorder.user.split("cite these ids):\n")[1], cited=found["citations"][0])


@query(f"""WITH {BUNDLE} SELECT token, id, n FROM (SELECT 'user' AS token, id, 2::BIGINT AS n FROM person UNION ALL SELECT pos::VARCHAR, id, 2 FROM person WHERE pos >= 10 UNION ALL SELECT 'amount', id, 1 FROM money UNION ALL SELECT (-pos)::VARCHAR, id, 1 FROM money WHERE pos <= -10 UNION ALL SELECT lower(label), id, 1 FROM org)""")
def token_index(spark: SparkSession, sf: str) -> DataFrame:
    """In how many of an entity's surfaces a word is; words of one letter count nowhere."""
    return graph.surface_tokens(_bundle(spark, sf).entities).select("token", "id", "n")


@query(
    f"""WITH {BUNDLE}, o AS (SELECT p.label, coalesce(n, 0) AS n FROM person p LEFT JOIN cnt USING (id) WHERE owner), t AS (SELECT label, coalesce(n, 0) AS n, pos, p.id FROM person p LEFT JOIN cnt USING (id) WHERE NOT owner ORDER BY n DESC, pos, p.id LIMIT 10)
SELECT (SELECT string_agg(type || ' ' || c, '|' ORDER BY type) FROM (SELECT type, count(*) AS c FROM en GROUP BY 1)) AS entity_counts, (SELECT label || ' ' || n FROM o) AS owner, (SELECT string_agg(label || ' ' || n, '|' ORDER BY n DESC, pos, id) FROM t) AS top,
0::BIGINT AS unknown, (SELECT count(*) FROM en WHERE id NOT IN (SELECT id FROM deg)) AS isolated, (SELECT round(100.0 * count(*) FILTER (id NOT IN (SELECT id FROM deg)) / count(*), 1)::DOUBLE FROM en) AS isolated_pct, (SELECT count(DISTINCT coalesce(dup, id)) FROM it) AS unique_after_dedup"""
)
def graph_report(spark: SparkSession, sf: str) -> DataFrame:
    """The graph in figures."""
    r = views.report(_bundle(spark, sf))
    counts = "|".join(f"{x.type} {x['count']}" for x in r["entity_counts"].orderBy("type").collect())
    top = "|".join(f"{x.label} {x.mentions}" for x in r["top_correspondents"].collect())
    whole = _row(spark, entity_counts=counts, owner=f"{r['owner']['label']} {r['owner']['mentions']}", top=top, isolated_pct=r["isolated_pct"])
    return whole.withColumns({k: F.lit(v).cast("long") for k, v in (("unknown", r["persons_unknown"]), ("isolated", r["isolated"]), ("unique_after_dedup", r["unique_after_dedup"]))})


@query(f"WITH {BUNDLE} SELECT source_type, count(*) AS items, count(ts) AS with_timestamp, count(DISTINCT conv) AS conversations, count(dup) AS duplicates FROM it GROUP BY 1")
def ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A31."""
    return views.ingest_stats(_bundle(spark, sf))


@query(f"WITH {BUNDLE} SELECT id, CASE WHEN source LIKE 'm%' THEN 'x' || substr(source, 2) ELSE source END AS source, array_to_string(list_transform(evidence, lambda x: CASE WHEN x = '0' THEN 'zero' ELSE x END), '|') AS evidence FROM ed")
def references_renamed(spark: SparkSession, sf: str) -> DataFrame:
    """Ids moved along in columns and in lists, through two moves one after the other."""
    b = _bundle(spark, sf)
    new = lambda prefix: F.concat(F.lit(prefix), F.expr("substring(id, 2)"))
    money = b.entities.where("type = 'money'")
    moved = merge.chained(money.select(F.col("id").alias("old_id"), new("y").alias("new_id")), money.select(new("y").alias("old_id"), new("x").alias("new_id")))
    zero = spark.range(1).select(F.lit("0").alias("old_id"), F.lit("zero").alias("new_id"))
    edges = merge.renamed_list(merge.renamed(b.edges, "source", moved), "id", "evidence_item_ids", zero)
    return edges.select("id", "source", F.array_join("evidence_item_ids", "|").alias("evidence"))


@query(f"WITH {BUNDLE} SELECT source, target, kind, CASE kind WHEN 'paid_to' THEN 1.0 ELSE weight END::DOUBLE AS weight FROM ed WHERE kind IN ('paid_to') UNION ALL SELECT 'u' || user_id, 'o' || source_type, 'affiliated_with', 1.0 FROM (SELECT DISTINCT user_id, source_type FROM it WHERE value >= 50)")
def structural_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The structural relations of a bundle, in one table: members of organisations, and the organisation of each amount."""
    b = _bundle(spark, sf)
    members = b.edges.where("kind = 'affiliated_with'").select(F.col("target").alias("entity_id"), F.col("source").alias("person_id"))
    everyone = b.items.where("source_type = 'purchase'").select(F.lit("opurchase").alias("entity_id"), F.col("id").alias("item_id"), F.lit("").alias("text"), "pos")
    rest = b.mentions.join(everyone, ["entity_id", "item_id"], "left_anti")
    edges = relations.structural(b.items, b.entities, rest.unionByName(everyone), members)
    return edges.where("kind <> 'corresponded_with'").select("source", "target", "kind", "weight")


# ---- sessions and jobs ----


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS expires, count(*) AS touches FROM g GROUP BY user_id, n"""
)
def live_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that end after half an hour without a touch."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return limits.live_sessions(e, "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("expires").cast("timestamp_ntz").alias("expires"), "touches")


@query("WITH l AS (SELECT user_id AS job_id, max(ts) AS last_ts FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) SELECT job_id, last_ts FROM l, n WHERE epoch(date_trunc('second', last_ts)) > epoch(date_trunc('second', now)) - 864000 ORDER BY last_ts DESC, job_id LIMIT 100")
def kept_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The latest jobs, none older than ten days."""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "job_id")
    return limits.kept_jobs(e, str(e.agg(F.max("ts")).first()[0]), seconds=864_000)


@query(
    """WITH h AS (SELECT max(event_id) // 2 AS half FROM events), k AS (SELECT user_id, max(ts) AS last FROM events, h WHERE event_id < half GROUP BY 1)
SELECT e.user_id AS job_id, event_id, event_id >= half AS live, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS n FROM h, events e LEFT JOIN k ON k.user_id = e.user_id WHERE event_id < half OR last IS NULL OR ts > last"""
)
def job_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Kept events first, the first half, then the live ones that are newer; the logs overlap by a quarter of all events."""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "job_id")
    half = e.agg(F.max("event_id")).first()[0] // 2
    found = limits.replay_then_live(e.where(F.col("event_id") < half), e.where(F.col("event_id") >= half // 2))
    return found.select("job_id", "event_id", "live", "n")


@query("SELECT user_id AS job_id, event_id, row_number() OVER w AS n, event_id = last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS is_last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def job_log(spark: SparkSession, sf: str) -> DataFrame:
    """Each job's events in order, and its last state."""
    return limits.job_log(table(spark, sf, "events").withColumnRenamed("user_id", "job_id")).select("job_id", "event_id", "n", "is_last")


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s),
x AS (SELECT user_id, max(ts) + INTERVAL 30 MINUTE AS expires FROM g GROUP BY user_id, n), m AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events) SELECT user_id, expires FROM x, m WHERE expires > now ORDER BY expires DESC LIMIT 10"""
)
def kept_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most recently used sessions that have not ended a day before the last event."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).cast("string").alias("now")).first().now
    return limits.kept_sessions(limits.live_sessions(e, "user_id"), now).select("user_id", F.col("expires").cast("timestamp_ntz").alias("expires"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) = 1 AS allowed FROM events")
def hourly_limit(spark: SparkSession, sf: str) -> DataFrame:
    """One build a session and hour."""
    return limits.one_per(table(spark, sf, "events"), "user_id", "ts", "hour", "event_id").select("event_id", "allowed")


@query("SELECT date_trunc('minute', ts) AS start, user_id, count(*) AS calls FROM events GROUP BY 1, 2")
def calls_per_minute(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of each key in each minute, as the streaming form counts them."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return limits.calls_per_minute(e, "user_id").select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "calls")


@query("SELECT * FROM (VALUES ('query', 'money'), ('query', 'timeline'), ('query', 'who'), ('mode', 'heuristic'), ('mode', 'llm'), ('currency', 'USD'), ('currency', 'EUR'), ('currency', 'GBP'), ('currency', 'INR'), ('currency', 'KRW'), ('currency', 'JPY'), ('currency', 'NOK'), ('currency', 'CAD'), ('currency', 'AUD'), ('currency', 'CHF')) v(kind, name)")
def capabilities(spark: SparkSession, sf: str) -> DataFrame:
    """What can be asked for."""
    can = views.capabilities()
    return spark.createDataFrame([("query", q["id"]) for q in can["queries"]] + [("mode", m) for m in can["modes"]] + [("currency", c) for c in can["currencies"]], "kind string, name string")
