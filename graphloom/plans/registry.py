"""The queries over the library's own operators on the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import currency as C
from graphloom.functions import text as T
from graphloom.operators import chunks, contract, dedup, entities, extraction, graph, identity, merge, profiles, relations
from graphloom.operators.components import connected_components
from graphloom.plans import tables
from graphloom.plans.catalogue import QUERIES, SQL, Query, query
from graphloom.plans.tables import table
from graphloom.scratch import materialise
from graphloom.streaming import limits



def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- texts ----

NORM = r"lower(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{a0}]', '', 'g'), '\s+', ' ', 'g')))"
DOCS = rf"""
docs AS (SELECT doc_id, lang, text, sha256({NORM}) AS content_hash, regexp_extract_all({NORM}, '[\p{{L}}\p{{N}}_]+') AS tok FROM documents),
sh AS (SELECT doc_id, lang, CASE WHEN len(tok) = 0 THEN [] WHEN len(tok) < 3 THEN [array_to_string(tok, ' ')]
       ELSE list_distinct([array_to_string(tok[i:i+2], ' ') FOR i IN range(1, len(tok) - 1)]) END AS sh, len(tok) AS n FROM docs)"""
PAIRS = rf"""
{DOCS},
sets AS (SELECT lang, min(doc_id) AS rep, any_value(list_sort(sh)) AS sh FROM sh WHERE n >= 8 GROUP BY lang, list_sort(sh)),
long AS (SELECT lang, rep, len(sh) AS n, unnest(sh) AS s FROM sets),
pairs AS (SELECT a.rep AS a, b.rep AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity
          FROM long a JOIN long b ON a.lang = b.lang AND a.s = b.s AND a.rep < b.rep GROUP BY 1, 2
          HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.6)"""


@query(rf"SELECT doc_id, sha256({NORM}) AS content_hash FROM documents")
def item_hash(spark: SparkSession, sf: str) -> DataFrame:
    """F01, A02."""
    return tables.documents(spark, sf).select(F.col("id").alias("doc_id"), "content_hash")


@query(rf"WITH {DOCS} SELECT content_hash, min(doc_id) AS canonical_id, count(*) AS n FROM docs GROUP BY 1 HAVING count(*) > 1")
def dedup_exact(spark: SparkSession, sf: str) -> DataFrame:
    """A01."""
    return dedup.exact_groups(tables.documents(spark, sf))


@query(rf"WITH {DOCS}, f AS (SELECT content_hash, min(doc_id) AS first FROM docs GROUP BY 1) SELECT doc_id, nullif(first, doc_id) AS duplicate_of FROM docs JOIN f USING (content_hash)")
def mark_exact(spark: SparkSession, sf: str) -> DataFrame:
    """P07."""
    items = tables.documents(spark, sf)
    return dedup.mark_duplicates(items, dedup.exact_canonical(items)).select(F.col("id").alias("doc_id"), "duplicate_of")


@query(rf"WITH {DOCS} SELECT min(doc_id) AS doc_id FROM docs GROUP BY content_hash")
def canonical_items(spark: SparkSession, sf: str) -> DataFrame:
    """P06."""
    items = tables.documents(spark, sf)
    return dedup.canonical_items(dedup.mark_duplicates(items, dedup.exact_canonical(items))).select(F.col("id").alias("doc_id"))


@query(rf"WITH {DOCS} SELECT doc_id, len(tok)::BIGINT AS words, len(list_distinct(tok))::BIGINT AS distinct_words FROM docs")
def word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """F03."""
    held = tables.documents(spark, sf).select("id", T.words("body").alias("w"))
    return held.select(F.col("id").alias("doc_id"), F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"))


@query(rf"WITH {DOCS} SELECT doc_id, len(sh)::BIGINT AS shingles FROM sh WHERE n >= 8")
def shingle_counts(spark: SparkSession, sf: str) -> DataFrame:
    """F03, P25."""
    return dedup.shingled(tables.documents(spark, sf), "id", "body", F.col("source_type")).select(F.col("id").alias("doc_id"), F.size("sh").cast("long").alias("shingles"))


@query(rf"WITH {PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of distinct texts."""
    reps, _ = dedup.representatives(dedup.shingled(tables.documents(spark, sf), "id", "body", F.col("source_type")))
    return dedup.near_pairs(reps).select("a", "b", F.round("similarity", 6).alias("similarity"))


CLUSTERS = rf"""
WITH RECURSIVE {PAIRS},
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(node, root) AS (SELECT rep, rep FROM sets UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY 1),
member AS (SELECT s.doc_id, c.root FROM sh s JOIN sets t ON s.lang = t.lang AND list_sort(s.sh) = t.sh JOIN comp c ON c.node = t.rep WHERE s.n >= 8),
near AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS canonical_id, count(*) OVER (PARTITION BY root) AS n FROM member)"""


@query(f"{CLUSTERS} SELECT doc_id, canonical_id FROM near WHERE n > 1")
def near_dup_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """A03, E01."""
    return dedup.near_clusters(tables.documents(spark, sf)).select(F.col("id").alias("doc_id"), "canonical_id")


@query(
    f"""{CLUSTERS}, ex AS (SELECT content_hash, count(*) AS n, min(doc_id) AS first FROM docs GROUP BY 1),
marked AS (SELECT d.doc_id FROM docs d JOIN ex USING (content_hash) WHERE ex.first <> d.doc_id UNION SELECT doc_id FROM near WHERE n > 1 AND doc_id <> canonical_id)
SELECT (SELECT sum(n - 1) FROM ex)::BIGINT AS exact_dupes, (SELECT count(*) FROM near WHERE n > 1 AND doc_id <> canonical_id) AS near_dupes, (SELECT count(*) FROM marked) AS n_duplicates"""
)
def dup_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A04."""
    items = tables.documents(spark, sf)
    near = dedup.near_clusters(items)
    exact = dedup.exact_canonical(items).withColumnRenamed("canonical_id", "e")
    canon = exact.join(near.where("id <> canonical_id"), "id", "full")
    return dedup.copy_counts(items, near, canon)


LINES = """
lines AS (SELECT doc_id, i AS k, l AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(ls) AS l, generate_subscripts(ls, 1) AS i)),
boiler AS (SELECT trim(line) AS line, count(DISTINCT doc_id) AS items FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5)"""


@query(f"WITH {LINES} SELECT line, items FROM boiler")
def boilerplate_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A22."""
    return chunks.boilerplate(tables.documents(spark, sf))


@query(f"WITH {LINES} SELECT d.doc_id, coalesce(s.body, '') AS body FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS body FROM lines WHERE trim(line) NOT IN (SELECT line FROM boiler) GROUP BY 1) s ON s.doc_id = d.doc_id")
def strip_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    """F28."""
    items = tables.documents(spark, sf)
    return chunks.without_boilerplate(items, chunks.boilerplate(items)).select(F.col("id").alias("doc_id"), "body")


EMAILS = r"SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}')) AS email FROM documents"


@query(rf"WITH e AS ({EMAILS}) SELECT doc_id, email, regexp_replace(lower(split_part(email, '@', 1)), '[^a-z]', '', 'g') AS stem, lower(split_part(email, '@', 2)) AS domain FROM e")
def emails_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """F19, F20."""
    found = tables.documents(spark, sf).select(F.col("id").alias("doc_id"), F.explode(F.regexp_extract_all("body", F.lit(relations.EMAIL), F.lit(1))).alias("email"))
    return found.select("doc_id", "email", T.email_stem("email").alias("stem"), T.email_domain("email").alias("domain"))


KEY = "trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT p_partkey, {KEY} AS label_key, array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: length(x) > 1)), ' ') AS person_key, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z ]', '', 'g'), ' +', ' ', 'g')) AS blocking_key FROM part")
def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The normalisers of labels."""
    return table(spark, sf, "part").select("p_partkey", T.label_key("p_name").alias("label_key"), T.person_key("p_name").alias("person_key"), T.blocking_key("p_name").alias("blocking_key"))


@query(f"SELECT p_partkey, 'org:' || left(sha1({KEY}), 10) AS id FROM part")
def stable_keys(spark: SparkSession, sf: str) -> DataFrame:
    """F26."""
    return table(spark, sf, "part").select("p_partkey", T.stable_id(F.lit("org"), T.label_key("p_name")).alias("id"))


@query(f"WITH c AS (SELECT p_partkey, 'org:' || left(sha1({KEY}), 10) AS cand, row_number() OVER (PARTITION BY {KEY} ORDER BY p_partkey) - 1 AS nth FROM part) SELECT 'p' || p_partkey AS old_id, CASE WHEN nth = 0 THEN cand ELSE cand || '_' || nth END AS new_id FROM c")
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    """E05, W07."""
    rows = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("label"))
    shaped = entities.shaped(rows, "org")
    return merge.stable_ids(shaped, shaped.select(F.col("id").alias("entity_id"), F.lit("i").alias("item_id")))


# ---- people and correspondence ----

FOUND = """
found AS (SELECT o_orderkey::VARCHAR AS item_id, 'c' || o_custkey AS s, NULL AS t FROM orders),
pairs AS (SELECT DISTINCT least('c' || o_custkey, 's' || l_suppkey) AS source, greatest('c' || o_custkey, 's' || l_suppkey) AS target, o_orderkey::VARCHAR AS item_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
edges AS (SELECT source, target, 'corresponded_with' AS kind, count(*)::DOUBLE AS weight, array_to_string(list_sort(list(item_id))[1:20], '|') AS evidence FROM pairs GROUP BY 1, 2)"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of the orders, built once for all that reads them."""
    return materialise(relations.numbered(relations.corresponded(tables.orders(spark, sf))), "edges")


def _shown(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "kind", "weight", F.array_join("evidence_item_ids", "|").alias("evidence"))


@query(f"WITH {FOUND} SELECT * FROM edges")
def corresponded_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """J02, T06."""
    return _shown(relations.corresponded(tables.orders(spark, sf)))


DEGREE = f"{FOUND}, ends AS (SELECT source AS id, weight FROM edges UNION ALL SELECT target, weight FROM edges)"


@query(f"WITH {DEGREE} SELECT id, sum(weight) AS weighted, count(*) AS degree FROM ends GROUP BY 1")
def degrees(spark: SparkSession, sf: str) -> DataFrame:
    """A26, A27."""
    edges = _edges(spark, sf)
    return relations.degree(edges, True).withColumnRenamed("degree", "weighted").join(relations.degree(edges), "id")


@query(
    f"""WITH {DEGREE}, d AS (SELECT id, sum(weight) AS w FROM ends GROUP BY 1),
people AS (SELECT 'c' || c_custkey AS id, c_custkey AS pos, c_name AS name FROM customer UNION ALL SELECT 's' || s_suppkey, s_suppkey + 10000000, s_name FROM supplier),
m AS (SELECT id, count(DISTINCT item_id) AS mentions FROM (SELECT source AS id, item_id FROM pairs UNION ALL SELECT target, item_id FROM pairs UNION ALL SELECT s, item_id FROM found) GROUP BY 1)
SELECT p.id AS entity_id, name, coalesce(mentions, 0) AS mentions, coalesce(w, 0)::DOUBLE AS correspondence_weight FROM people p LEFT JOIN d USING (id) LEFT JOIN m USING (id)
ORDER BY coalesce(w, 0) + coalesce(mentions, 0) * 0.1 DESC, pos, p.id LIMIT 15"""
)
def who_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """E29, T01, A26."""
    found = tables.parties(spark, sf)
    items = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("source_type"))
    return graph.who_rows(items, found.entities, found.mentions, _edges(spark, sf)).select("entity_id", "name", "mentions", "correspondence_weight")


@query(
    f"""WITH {DEGREE}, b AS (SELECT source AS id, target AS neighbour, weight FROM edges UNION ALL SELECT target, source, weight FROM edges),
r AS (SELECT id, neighbour, max(weight) AS weight FROM b GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, neighbour)::INT AS rank FROM r) WHERE rank <= 3"""
)
def top_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """T13."""
    return relations.ranked_neighbours(_edges(spark, sf)).where("rank <= 3")


@query(
    f"""WITH RECURSIVE {FOUND}, adj AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges),
walk(id, depth) AS (SELECT 'c1', 0 UNION SELECT adj.b, depth + 1 FROM walk JOIN adj ON adj.a = walk.id WHERE depth < 2)
SELECT id, min(depth)::INT AS depth FROM walk GROUP BY 1"""
)
def bfs_neighborhood(spark: SparkSession, sf: str) -> DataFrame:
    """E27."""
    return graph.neighbourhood(_edges(spark, sf), spark.createDataFrame([("c1",)], "id string"))[0]


@query(f"WITH RECURSIVE {FOUND}, adj AS (SELECT source AS a, target AS b FROM edges WHERE weight >= 2 UNION SELECT target, source FROM edges WHERE weight >= 2), walk(node, root) AS (SELECT a, a FROM adj UNION SELECT adj.b, walk.root FROM walk JOIN adj ON adj.a = walk.node) SELECT node, min(root) AS component FROM walk GROUP BY 1")
def strong_components(spark: SparkSession, sf: str) -> DataFrame:
    """E01."""
    return connected_components(_edges(spark, sf).where("weight >= 2"), "source", "target")


@query("SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'affiliated_with' AS kind, 1.0::DOUBLE AS weight, e.evidence FROM customer JOIN (SELECT c_nationkey AS k, array_to_string(list_sort(list(c_custkey::VARCHAR))[1:5], '|') AS evidence FROM customer GROUP BY 1) e ON k = c_nationkey")
def affiliated_with(spark: SparkSession, sf: str) -> DataFrame:
    """J07."""
    c = table(spark, sf, "customer")
    org = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("entity_id")
    members = c.select(org, F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("person_id"))
    return _shown(relations.affiliated(members, c.select(org, F.col("c_custkey").cast("string").alias("item_id"))))


TYPED = """
money AS (SELECT DISTINCT 'm|' || o_orderpriority || '|' || o_orderstatus || '|' || (o_custkey % 9) AS id, o_orderkey AS item FROM orders),
org AS (SELECT DISTINCT 'o' || (l_suppkey % 40) AS id, l_orderkey AS item FROM lineitem),
place AS (SELECT DISTINCT 'l' || c_nationkey AS id, o_orderkey AS item FROM orders JOIN customer ON c_custkey = o_custkey),
doc AS (SELECT DISTINCT 'd' || (l_partkey % 150) AS id, l_orderkey AS item FROM lineitem),
sub AS (SELECT DISTINCT 'v|' || l_returnflag || '|' || l_linestatus AS id, l_orderkey AS item FROM lineitem)"""


def _best(left: str, right: str, kind: str) -> str:
    return f"""WITH {TYPED}, n AS (SELECT a.id AS source, b.id AS target, count(*) AS n, array_to_string(list_sort(list(a.item::VARCHAR))[1:20], '|') AS evidence FROM {left} a JOIN {right} b ON a.item = b.item GROUP BY 1, 2)
SELECT source, target, '{kind}' AS kind, 1.0::DOUBLE AS weight, evidence FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS r FROM n) WHERE r = 1"""


def _overlap(spark: SparkSession, sf: str, left: str, right: str) -> DataFrame:
    found = tables.typed_mentions(spark, sf)
    return relations.overlaps(found.mentions, found.entities, left, right)


@query(_best("money", "org", "paid_to"))
def paid_to(spark: SparkSession, sf: str) -> DataFrame:
    """J04, W08."""
    return _shown(relations.best_overlap(_overlap(spark, sf, "money", "org"), "paid_to"))


@query(_best("doc", "sub", "document_for"))
def document_for(spark: SparkSession, sf: str) -> DataFrame:
    """J06."""
    return _shown(relations.best_overlap(_overlap(spark, sf, "document", "subevent"), "document_for"))


@query(f"WITH {TYPED} SELECT a.id AS source, b.id AS target, 'held_at' AS kind, count(*)::DOUBLE AS weight, array_to_string(list_sort(list(a.item::VARCHAR))[1:20], '|') AS evidence FROM org a JOIN place b ON a.item = b.item GROUP BY 1, 2 HAVING count(*) >= 2")
def held_at(spark: SparkSession, sf: str) -> DataFrame:
    """J05."""
    return _shown(relations.held_at(_overlap(spark, sf, "org", "location")))


EVENT = "ev AS (SELECT event_id, 'email:u' || user_id || '@example.com' AS key, event_type, event_type || '-' || (user_id % 7) AS conv FROM events UNION ALL SELECT event_id, 'email:team' || (event_id % 5) || '@example.org', event_type, event_type || '-' || (user_id % 7) FROM events)"
SCORES = f"{EVENT}, sc AS (SELECT key, count(DISTINCT conv) AS conversations, count(DISTINCT event_type) AS channels, count(*) FILTER (key LIKE 'email:team%') AS received, min(event_id) AS first FROM ev GROUP BY 1)"


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return identity.identity_clusters(identity.identity_members(tables.events(spark, sf)))


@query(f"WITH {SCORES} SELECT key, conversations, channels, received FROM sc")
def identity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """A07, P24."""
    return _clusters(spark, sf).select("key", "conversations", "channels", "received")


@query(f"WITH {SCORES} SELECT key, (conversations + 2 * channels + 0.25 * received)::DOUBLE AS score FROM sc")
def owner_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A08."""
    return identity.owner_scores(_clusters(spark, sf)).select("key", "score")


@query(f"WITH {SCORES}, s AS (SELECT key, (conversations + 2 * channels + 0.25 * received)::DOUBLE AS score, first FROM sc), r AS (SELECT *, lead(score, 1, 0) OVER w AS runner_up, row_number() OVER w AS n FROM s WINDOW w AS (ORDER BY score DESC, first)) SELECT key, score, score >= greatest(1.0, runner_up * 1.15) AS confident FROM r WHERE n = 1")
def owner_pick(spark: SparkSession, sf: str) -> DataFrame:
    """T11."""
    return identity.owner_pick(identity.owner_scores(_clusters(spark, sf))).select("key", "score", "confident")


@query("SELECT o_orderkey::VARCHAR AS id, CASE WHEN (o_custkey % 500) IN (SELECT o_custkey % 500 FROM orders GROUP BY 1 HAVING count(DISTINCT lower(o_orderpriority)) >= 5) THEN 'system' ELSE 'person' END AS kind FROM orders")
def shared_mailboxes(spark: SparkSession, sf: str) -> DataFrame:
    """A06."""
    o = table(spark, sf, "orders")
    box = F.concat(F.lit("box"), (F.col("o_custkey") % 500).cast("string"), F.lit("@example.com"))
    items = o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("pos"), F.lit("").alias("conversation_id"), F.lit("email").alias("source_type"),
        F.array(tables.participant("sender", F.col("o_orderpriority"), "email", box)).alias("participants"),
    )
    return identity.mark_shared_mailboxes(items, 5).select("id", F.col("participants")[0]["kind"].alias("kind"))


# ---- money, subevents, time ----

PRICES = """
p AS (SELECT o_orderkey::VARCHAR AS item_id, round(o_totalprice, 2)::DECIMAL(18,2) AS amount, CASE o_custkey % 4 WHEN 1 THEN 'EUR' WHEN 3 THEN 'USD' END AS word FROM orders WHERE round(o_totalprice, 2) > 0),
v AS (SELECT amount, 'USD' AS code, 1 AS n, item_id FROM p UNION ALL SELECT amount, word, 1, item_id FROM p WHERE word IS NOT NULL)"""


@query("SELECT round(o_totalprice, 2)::DECIMAL(18,2) AS amount, count(*) AS items FROM orders WHERE round(o_totalprice, 2) > 0 GROUP BY 1")
def money_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """A10."""
    return entities.amount_items(tables.order_items(spark, sf)).groupBy("amount").agg(F.count("*").alias("items"))


@query(f"WITH {PRICES}, c AS (SELECT amount, count(DISTINCT code) AS codes FROM v GROUP BY 1) SELECT codes > 1 AS ambiguous, count(*) AS amounts, sum(amount)::DECIMAL(38,2) AS total FROM c GROUP BY 1")
def currency_votes(spark: SparkSession, sf: str) -> DataFrame:
    """A12, F22-F24."""
    found = entities.money(entities.amount_items(tables.order_items(spark, sf))).entities
    return found.groupBy(F.col("currency_ambiguous").alias("ambiguous")).agg(F.count("*").alias("amounts"), F.sum("amount").cast("decimal(38,2)").alias("total"))


@query("SELECT n_name AS currency, sum(round(o_totalprice, 2)::DECIMAL(18,2))::DECIMAL(38,2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def money_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A13."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    held = rows.select(F.lit("money").alias("type"), F.col("n_name").alias("currency"), F.round("o_totalprice", 2).cast(C.DECIMAL).alias("amount"), F.lit(True).alias("currency_resolved"))
    return graph.money_totals(held).withColumn("total", F.col("total").cast("decimal(38,2)"))


@query("SELECT o_orderkey, printf('%.2f', o_totalprice) AS plain, CASE WHEN o_custkey % 2 = 0 THEN '$' ELSE '' END || replace(format('{:,.2f}', o_totalprice), ' ', '') || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE ' ⚠ currency?' END AS label FROM orders")
def money_labels(spark: SparkSession, sf: str) -> DataFrame:
    """F23, F25."""
    o = table(spark, sf, "orders")
    known = F.col("o_custkey") % 2 == 0
    label = C.money_label(F.col("o_totalprice"), F.when(known, F.lit("USD")), known, F.lit(False))
    return o.select("o_orderkey", F.regexp_replace(C.grouped(F.col("o_totalprice")), ",", "").alias("plain"), label.alias("label"))


@query("SELECT event_type AS label, min(ts) AS start, max(ts) AS \"end\", count(*) AS count FROM events GROUP BY 1")
def subevent_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """A28, T08."""
    items = tables.events(spark, sf)
    rows = items.select(F.col("source_type").alias("id"), F.col("source_type").alias("label"), F.lit("subevent").alias("type")).distinct()
    told = items.select(F.col("source_type").alias("entity_id"), F.col("id").alias("item_id"))
    return graph.subevent_timeline(rows, told, items).select("label", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "count")


@query(
    """WITH s AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 86400000000 THEN 1 ELSE 0 END AS late FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(late) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, session::BIGINT AS session, min(ts) AS start, max(ts) AS "end", count(*) AS count FROM g GROUP BY 1, 2"""
)
def topic_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """W01."""
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    cut = graph.sessions(e, ["user_id"], "at", 86_400, "event_id")
    return cut.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("count"))


@query("SELECT event_id, within, within < 3 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) - 1 AS within FROM events)")
def sliding_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The table has no two calls of a user at the same instant."""
    return limits.sliding_limit(table(spark, sf, "events"), "user_id", "ts", 6 * 3600, 3, "event_id").select("event_id", "within", "allowed")


@query("SELECT event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) <= 200 AS allowed FROM events")
def daily_cap(spark: SparkSession, sf: str) -> DataFrame:
    """R03."""
    return limits.daily_cap(table(spark, sf, "events"), "ts", 200, "event_id").select("event_id", "allowed")


# ---- conversations ----


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(
        F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), (F.col("conv_id") * 10_000 + F.col("turn")).alias("pos"), F.col("conv_id").cast("string").alias("conversation_id"),
        F.lit(None).cast("timestamp").alias("timestamp"), F.lit("").alias("timestamp_raw"), F.col("text").alias("body"), F.lit("other").alias("source_type"),
        F.array(tables.participant("sender", F.col("role"), raw=F.col("role"))).alias("participants"),
    )


@query("WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) SELECT conv_id::VARCHAR AS conversation_id, lower(role) AS key, 'p' || row_number() OVER (PARTITION BY conv_id ORDER BY t, role) AS pid FROM f")
def participant_ids(spark: SparkSession, sf: str) -> DataFrame:
    """W05, F37."""
    return chunks.participants(_turns(spark, sf)).select("conversation_id", "key", "pid")


@query(
    """WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2), p AS (SELECT conv_id, role, 'p' || row_number() OVER (PARTITION BY conv_id ORDER BY t, role) AS pid FROM f)
SELECT c.conv_id || '#' || turn AS id, '? ' || pid || ' -> -: ' || left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1200) AS line FROM conversations c JOIN p ON p.conv_id = c.conv_id AND p.role = c.role"""
)
def message_lines(spark: SparkSession, sf: str) -> DataFrame:
    """F31, F29."""
    turns = _turns(spark, sf)
    return chunks.message_lines(turns, chunks.participants(turns)).select("id", "line")


@query(
    r"""WITH RECURSIVE ln AS (SELECT conv_id, turn, i AS k, l AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations), LATERAL (SELECT unnest(ls) AS l, generate_subscripts(ls, 1) AS i)),
boiler AS (SELECT trim(line) AS line FROM ln WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT conv_id || '#' || turn) >= 5),
body AS (SELECT c.conv_id, c.turn, role, coalesce(b, '') AS body FROM conversations c LEFT JOIN (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY k) AS b FROM ln WHERE trim(line) NOT IN (SELECT line FROM boiler) GROUP BY 1, 2) x ON x.conv_id = c.conv_id AND x.turn = c.turn),
f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2), p AS (SELECT conv_id, role, 'p' || row_number() OVER (PARTITION BY conv_id ORDER BY t, role) AS pid FROM f),
tb AS (SELECT conv_id, length('## Participants' || chr(10) || 'pid | display_name | kind | descriptors' || chr(10) || '----|--------------|------|------------' || chr(10) || string_agg(pid || ' | ' || role || ' | person | ', chr(10) ORDER BY pid)) AS t FROM p GROUP BY 1),
ms AS (SELECT b.conv_id, row_number() OVER (PARTITION BY b.conv_id ORDER BY turn) AS i, length('? ' || pid || ' -> -: ' || left(trim(regexp_replace(body, '\s+', ' ', 'g')), 1200)) AS n FROM body b JOIN p ON p.conv_id = b.conv_id AND p.role = b.role),
su AS (SELECT conv_id, i, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto, count(*) OVER (PARTITION BY conv_id) AS total FROM ms UNION ALL SELECT DISTINCT conv_id, 0, 0, 0 FROM ms),
st AS (SELECT a.conv_id, a.i AS s, max(b.i) AS e FROM su a JOIN su b ON a.conv_id = b.conv_id AND b.i > a.i JOIN tb ON tb.conv_id = a.conv_id
       WHERE b.i = a.i + 1 OR t + 1 + b.upto - a.upto + 6 * (b.i - a.i) + greatest(b.i - a.i - 9, 0) + greatest(b.i - a.i - 99, 0) <= 1500 GROUP BY 1, 2),
ck(conv_id, idx, s, e) AS (SELECT conv_id, 0, s, e FROM st WHERE s = 0 UNION ALL SELECT ck.conv_id, idx + 1, st.s, st.e FROM ck JOIN st ON st.conv_id = ck.conv_id AND st.s = greatest(ck.s + 1, ck.e - 5) WHERE ck.e < (SELECT max(i) FROM su WHERE su.conv_id = ck.conv_id))
SELECT ck.conv_id || ':' || idx AS chunk_id, (ck.e - ck.s)::INT AS messages, greatest(1, floor((t + b.upto - a.upto + 6 * (ck.e - ck.s) + greatest(ck.e - ck.s - 9, 0) + greatest(ck.e - ck.s - 99, 0)) / 3.5))::INT AS tokens
FROM ck JOIN tb ON tb.conv_id = ck.conv_id JOIN su a ON a.conv_id = ck.conv_id AND a.i = ck.s JOIN su b ON b.conv_id = ck.conv_id AND b.i = ck.e"""
)
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Where a chunk ends depends on where it begins, and the next one begins five messages before that."""
    made = chunks.full_text(chunks.chunk_items(_turns(spark, sf), budget=1500))
    return made.select("chunk_id", F.size("message_lines").alias("messages"), "tokens")


# ---- merging, contract, search, blocking ----

MERGE = """
e AS (SELECT 'p' || p_partkey AS id, p_partkey AS pos, p_name AS label, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS key FROM part),
m AS (SELECT 'p' || l_partkey AS id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1),
r AS (SELECT e.id, key, first_value(e.id) OVER (PARTITION BY key ORDER BY coalesce(n, 0) DESC, length(label) DESC, pos, e.id) AS canon, count(*) OVER (PARTITION BY key) AS members FROM e LEFT JOIN m ON m.id = e.id),
remap AS (SELECT id AS old_id, canon AS new_id FROM r WHERE members > 1 AND id <> canon AND key LIKE '% %')"""


def _parts(spark: SparkSession, sf: str) -> entities.Found:
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("label"), F.array("p_name").alias("aliases"))
    told = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("entity_id"), F.col("l_orderkey").cast("string").alias("item_id")).distinct()
    return entities.Found(entities.shaped(p, "org"), told.select("entity_id", "item_id", F.lit("").alias("text"), F.col("item_id").cast("long").alias("pos")))


@query(f"WITH {MERGE} SELECT old_id, new_id FROM remap")
def name_merge(spark: SparkSession, sf: str) -> DataFrame:
    """E04, A23."""
    return merge.merge_by_name(_parts(spark, sf))[1]


@query(
    f"""WITH {MERGE}, raw AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_orderkey::VARCHAR AS item FROM lineitem),
ed AS (SELECT source, target, count(*)::DOUBLE AS weight, list_sort(list(item))[1:20] AS ev FROM raw GROUP BY 1, 2),
mv AS (SELECT source, coalesce(new_id, target) AS target, weight, ev FROM ed LEFT JOIN remap ON old_id = target)
SELECT source, target, 'paid_to' AS kind, sum(weight) AS weight, array_to_string(list_sort(list_distinct(flatten(list(ev))))[1:20], '|') AS evidence FROM mv GROUP BY 1, 2"""
)
def edge_remap(spark: SparkSession, sf: str) -> DataFrame:
    """A24, J14."""
    pairs = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.col("l_orderkey").cast("string").alias("item_id"))
    return _shown(relations.remapped(relations.weighed(pairs, "paid_to"), merge.merge_by_name(_parts(spark, sf))[1]))


def _broken(spark: SparkSession, sf: str) -> contract.Graph:
    """A graph with faults that leaves out no row: every customer is an entity (some blank, some twice), every order an item, a mention
    and an edge to a customer near its own, past the last one at the end; some customers are never mentioned, and order priorities say which sources, mentioned items and evidence items do not exist."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    base = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).otherwise("").alias("label"))
    people = entities.shaped(base.unionAll(base.where("pos % 100 = 0").withColumn("pos", -1 - F.col("pos"))), "person")
    o = o.join(F.broadcast(c.agg(F.max("c_custkey").alias("last"))), F.lit(True)).select(
        F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("item"), F.col("o_custkey").cast("string").alias("by"), F.substring("o_orderpriority", 1, 1).alias("fault"),
        ((F.col("o_custkey") + F.col("o_orderkey") % 5) % (F.col("last") + 2)).cast("string").alias("to"),
    )
    unless = lambda fault, good, bad: F.concat(F.when(F.col("fault") == fault, bad).otherwise(good), F.col("by" if good == "c" else "item"))
    told = o.select(F.concat(F.when(F.col("by") % 50 == 7, "x").otherwise("c"), "by").alias("entity_id"), unless("2", "", "x").alias("item_id"), F.lit("").alias("text"), "pos")
    edges = o.select(
        F.concat(F.lit("e"), "item").alias("id"), unless("5", "c", "x").alias("source"), F.concat(F.lit("c"), "to").alias("target"),
        F.when(F.col("fault") == "1", "unheard_of").otherwise("paid").alias("kind"), F.lit(1.0).alias("weight"), F.array(unless("3", "", "x")).alias("evidence_item_ids"),
    )
    merges = edges.select(F.col("source").alias("canonical_id"), F.array(F.lit("x")).alias("merged_forms"), F.lit("").alias("rationale")).distinct()
    return contract.Graph(o.select(F.col("item").alias("id")), people, told, edges, merges)


BROKEN = """
b AS (SELECT 'c' || c_custkey AS id, c_custkey AS pos, CASE WHEN c_custkey % 10 <> 0 THEN c_name ELSE '' END AS label FROM customer),
en AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE pos % 100 = 0),
me AS (SELECT CASE WHEN o_custkey % 50 = 7 THEN 'x' ELSE 'c' END || o_custkey AS id, o_orderpriority NOT LIKE '2%' AS known FROM orders),
ed AS (SELECT 'e' || o_orderkey AS id, CASE WHEN o_orderpriority LIKE '5%' THEN 'x' ELSE 'c' END || o_custkey AS source, 'c' || ((o_custkey + o_orderkey % 5) % ((SELECT max(c_custkey) FROM customer) + 2)) AS target,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'unheard_of' ELSE 'paid' END AS kind, o_orderpriority NOT LIKE '3%' AS known FROM orders)"""


@query(
    f"""WITH {BROKEN}
SELECT 'R1_duplicate_id' AS rule, id FROM b WHERE pos % 100 = 0
UNION ALL SELECT 'R3_empty_label', id FROM en WHERE label = ''
UNION ALL SELECT 'R4_no_mentions', id FROM en WHERE id NOT IN (SELECT id FROM me)
UNION ALL SELECT DISTINCT 'R4_unknown_mention_item', id FROM b WHERE id IN (SELECT id FROM me WHERE NOT known)
UNION ALL SELECT 'R6_dangling_source', id FROM ed WHERE source NOT IN (SELECT id FROM b)
UNION ALL SELECT 'R6_dangling_target', id FROM ed WHERE target NOT IN (SELECT id FROM b)
UNION ALL SELECT 'R6_self_loop', id FROM ed WHERE source = target
UNION ALL SELECT 'R7_invalid_kind', id FROM ed WHERE kind = 'unheard_of'
UNION ALL SELECT 'R8_unknown_evidence', id FROM ed WHERE NOT known
UNION ALL SELECT 'R9_duplicate_edge', id FROM (SELECT id, row_number() OVER (PARTITION BY source, target, kind ORDER BY id) AS n FROM ed) WHERE n > 1
UNION ALL SELECT 'R10_merge_bad_id', id FROM (SELECT DISTINCT source AS id FROM ed) WHERE id NOT IN (SELECT id FROM b)"""
)
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Over all customers and orders."""
    return contract.violations(_broken(spark, sf)).select("rule", "id")


@query(
    f"""WITH {BROKEN}, ok AS (SELECT id FROM b WHERE id IN (SELECT id FROM me WHERE known)),
k AS (SELECT * FROM ed WHERE source IN (SELECT id FROM ok) AND target IN (SELECT id FROM ok) AND source <> target AND kind = 'paid' AND known)
SELECT id, source, target FROM (SELECT *, row_number() OVER (PARTITION BY source, target, kind ORDER BY id) AS n FROM k) WHERE n = 1"""
)
def contract_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Over all customers and orders."""
    return contract.repair(_broken(spark, sf))[0].edges.select("id", "source", "target")


ASKED = "steel copper green small order brass"
TOKENS = f"t AS (SELECT 'p' || p_partkey AS id, p_partkey AS pos, unnest(list_distinct(list_filter(string_split({KEY}, ' '), lambda x: length(x) > 1))) AS token FROM part)"


@query(f"WITH {TOKENS} SELECT id, (2 * count(*))::BIGINT AS score FROM t WHERE token IN ('{ASKED.replace(' ', chr(39) + ', ' + chr(39))}') GROUP BY id, pos ORDER BY count(*) DESC, pos, id LIMIT 6")
def entity_match(spark: SparkSession, sf: str) -> DataFrame:
    """A part's label and its one alias both count."""
    return graph.match(graph.surface_tokens(_parts(spark, sf).entities), ASKED).select("id", "score")


@query(r"""WITH q AS (SELECT doc_id, list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' ')) AS tok FROM documents),
s AS (SELECT doc_id, len(list_intersect(tok, ['trash', 'idiot', 'tion', 'ingea', 'stion'])) + CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 0 END AS score FROM q) SELECT doc_id, score::BIGINT AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 16""")
def evidence_rank(spark: SparkSession, sf: str) -> DataFrame:
    """T04."""
    items = tables.documents(spark, sf)
    near = items.where("id % 10 = 0").select(F.col("id").alias("item_id"))
    return graph.evidence(items, near, "trash idiot tion ingea stion").select(F.col("id").alias("doc_id"), F.col("score").cast("long").alias("score"))


def _name_profiles(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    none = F.array().cast("array<string>")
    return p.select(
        F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("id"), F.col("p_partkey").alias("pos"), F.lit("org").alias("type"), F.create_map("p_name", F.lit(1).cast("long")).alias("surfaces"), none.alias("identifiers"),
        F.create_map().cast("map<string,array<string>>").alias("clues"), none.alias("channels"), none.alias("item_ids"), none.alias("sample_lines"), none.alias("co_profile_ids"),
    )


@query("WITH t AS (SELECT p_partkey, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z ]', '', 'g'), ' +', ' ', 'g')), ' '), lambda x: length(x) >= 4))) AS key FROM part) SELECT key, count(*) AS profiles, count(*) <= 12 AS used FROM t GROUP BY 1")
def blocking_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Name words and whether they join profiles."""
    keys = profiles.block_keys(_name_profiles(spark, sf)).where("kind = 'token'")
    return keys.groupBy("key").agg(F.count("*").alias("profiles")).withColumn("used", F.col("profiles") <= profiles.MOST)


@query("SELECT d.doc_id, true AS relevant, CASE WHEN l.quality = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS score, CASE WHEN l.quality = 1 THEN 'good' ELSE 'no topics assigned' END AS rationale FROM (SELECT doc_id FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def labels_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Quality stands for a topic."""
    topics = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("item_id"), F.array(F.lit("good")).alias("topics"))
    return extraction.relevance(tables.documents(spark, sf), topics).select(F.col("item_id").alias("doc_id"), "relevant", "score", "rationale")


# the queries of the other modules register themselves
from graphloom.plans import answer_queries, people_queries, resolution_queries, source_queries  # noqa: E402, F401
